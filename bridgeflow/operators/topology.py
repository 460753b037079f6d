"""Fan-out of one stream to many sinks and fan-in of many streams to one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .records import run_plans

Mapping = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Sink:
    """A consumer with its mapping; ``write`` raises when delivery fails."""

    bridge_id: str
    mapping: Mapping
    write: Callable[[DataFrame], None] | None = None


def fan_out(messages: DataFrame, sinks: list[Sink], key: str) -> DataFrame:
    """Mapped rows of every sink: (key, bridge_id, payload JSON). A mapping may drop rows."""
    out = None
    for s in sinks:
        mapped = s.mapping(messages)
        fields = [F.col(f"`{c}`") for c in mapped.columns if c != key]
        rows = mapped.select(key, F.lit(s.bridge_id).alias("bridge_id"), F.to_json(F.struct(*fields)).alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fan_out_plans(messages: DataFrame, plans: DataFrame, key: str, record: str = "record") -> DataFrame:
    """Each message through the plans of all bridges of its producer: (key, bridge_id, payload JSON, delivered).

    ``messages`` hold a record per row, ``plans`` a row per bridge with the columns of
    ``plan_adapters``. One scan and one projection serve any number of bridges; where a plan gives
    nothing, the message is undelivered there and goes to the others all the same.
    """
    rows = messages.select(key, "producer_id", F.col(record).alias("__record")).join(
        plans.select("producer_id", "bridge_id", "envelope", "mappings", "normalize", "flatten"), "producer_id")
    made = run_plans(rows, "__record", "__output")
    return made.select(key, "bridge_id", F.to_json("__output").alias("payload"), F.col("__output").isNotNull().alias("delivered"))


def fan_out_write(messages: DataFrame, sinks: list[Sink]) -> list[tuple[str, bool, str]]:
    """Deliver a batch to every sink; a failing sink does not stop the others.

    Usable as the body of ``foreachBatch``. The batch is read once and kept for all sinks.
    Returns (bridge_id, delivered, error) per sink.
    """
    messages = messages.persist(StorageLevel.MEMORY_AND_DISK)
    results = []
    try:
        for s in sinks:
            try:
                s.write(s.mapping(messages))
                results.append((s.bridge_id, True, ""))
            except Exception as e:  # a sink may fail in any way; the outcome is reported
                results.append((s.bridge_id, False, str(e)))
    finally:
        messages.unpersist()
    return results


def fan_out_outcomes(messages: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Sinks reached per message; a message succeeds if any sink got it."""
    reached = delivered.groupBy(key).agg(F.count(F.lit(1)).alias("delivered"))
    out = messages.select(key).join(reached, key, "left")
    return out.withColumn("delivered", F.coalesce("delivered", F.lit(0))).withColumn("success", F.col("delivered") > 0)


def fan_in(sources: dict[str, tuple[DataFrame, Mapping]]) -> DataFrame:
    """Union of mapped streams, each row tagged with its producer; works for batches and streams."""
    out = None
    for producer_id, (df, mapping) in sources.items():
        rows = mapping(df).withColumn("_ic_source_producer", F.lit(producer_id))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _stats(kind: str, outcomes: DataFrame, bridge_ids: list[str], ends: str, n: int) -> DataFrame:
    return outcomes.agg(F.count_if("success").alias("messages"), F.count_if(~F.col("success")).alias("errors")).select(
        F.lit(kind).alias("type"), F.array(*[F.lit(b) for b in bridge_ids]).alias("bridge_ids"), F.lit(n).alias(ends), "messages", "errors")


def fanout_stats(outcomes: DataFrame, sinks: list[Sink]) -> DataFrame:
    return _stats("fan_out", outcomes, [s.bridge_id for s in sinks], "consumers", len(sinks))


def fanin_stats(outcomes: DataFrame, bridge_ids: list[str], producers: int) -> DataFrame:
    return _stats("fan_in", outcomes, bridge_ids, "producers", producers)


def active_fanout(active: DataFrame) -> DataFrame:
    """Producers with more than one active bridge."""
    pairs = active.select("producer_id", "consumer_id").distinct()
    return pairs.groupBy("producer_id").agg(F.count(F.lit(1)).alias("bridges")).filter("bridges > 1")
