"""Topic source and sink. The format is a parameter, so that any source with the same columns fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from .decode import decode_payload

TOPIC_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()),
])


def topic_source(
    spark: SparkSession, options: dict[str, str], fmt: str = "kafka", streaming: bool = True, path: str | None = None
) -> DataFrame:
    """Decoded messages of a topic; for Kafka pass ``kafka.bootstrap.servers`` and ``subscribe``."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if fmt != "kafka":
        reader = reader.schema(TOPIC_SCHEMA)
    rows = reader.load(path) if path else reader.load()
    return decode_payload(rows.withColumn("protocol", F.lit("kafka")), raw="value")


def topic_rows(df: DataFrame, value: str | None = None, key: str | None = None) -> DataFrame:
    """``key`` and ``value`` columns: bytes pass through, anything else becomes JSON."""
    if value and isinstance(df.schema[value].dataType, T.BinaryType):
        body = F.col(value)
    else:
        body = F.encode(F.to_json(F.col(value) if value else F.struct("*")), "UTF-8")
    k = F.col(key).cast("string").cast("binary") if key else F.lit(None).cast("binary")
    return df.select(k.alias("key"), body.alias("value"))


def topic_sink(df: DataFrame, options: dict[str, str], fmt: str = "kafka", **columns) -> DataStreamWriter:
    return topic_rows(df, **columns).writeStream.format(fmt).options(**options)
