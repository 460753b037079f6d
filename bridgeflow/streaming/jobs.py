"""Streaming jobs built from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.topology import Sink, fan_out_write
from ..sources.decode import decode_payload, message_id, payload_text
from . import stateful


def throughput(messages: DataFrame, key: str, event_time: str, size: Column, window: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """Messages and bytes per key and window; a window is final once the watermark passes it."""
    grouped = messages.withWatermark(event_time, delay).groupBy(key, F.window(event_time, window))
    return grouped.agg(F.count(F.lit(1)).alias("messages"), F.sum(size).alias("bytes"))


def fan_out(messages: DataFrame, sinks: list[Sink], on_results: Callable[[int, list[tuple[str, bool, str]]], None]) -> DataStreamWriter:
    """Deliver every micro-batch to all sinks; ``on_results`` receives (bridge_id, delivered, error) per sink."""
    return messages.writeStream.foreachBatch(lambda batch, batch_id: on_results(batch_id, fan_out_write(batch, sinks)))


def write_batches(df: DataFrame, path: str) -> DataStreamWriter:
    """Parquet folder per micro-batch: a batch that is run again replaces its own folder."""
    return df.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"))


def message_path(raw: DataFrame, bridge: str, time: str, tie: str, write_ok: Column, options, raw_column: str = "raw") -> DataFrame:
    """From raw bytes to outcomes: decode, message id, and the stateful path in one shuffle by bridge."""
    decoded = decode_payload(raw, raw_column)
    rows = decoded.select(
        bridge, time, tie, message_id(payload_text(F.col(raw_column))).alias("msg_id"),
        F.col("decode_ok").alias("transform_ok"), write_ok.alias("write_ok"))
    return stateful.process_messages(rows, bridge, time, tie, "msg_id", "transform_ok", "write_ok", options)


def follow_events(log: DataFrame, *types: str, column: str = "type") -> DataFrame:
    """Subscribe to an event stream by type."""
    return log.filter(F.col(column).isin(*types)) if types else log
