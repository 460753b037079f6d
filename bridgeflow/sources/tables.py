"""Keyed state tables: bridges, nodes, edges, with upserts that touch a small part of the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import durable

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """Parquet in folders by the hash of the key; an upsert reads and rewrites the folders that its keys fall into.

    Rows of equal keys are in one folder, so a merge by key of the touched folders is a merge of the
    table. The merged rows are fixed before any folder is replaced, and folders are replaced one
    by one when all are written: a job that dies in between is repaired by running the batch again,
    if its merge, as all in this library, gives the same on rows that it was applied to before.
    ``buckets`` should let a folder hold some 100 MB; it is fixed for the life of the table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, touched: DataFrame) -> None:
        # a row that is no row in every touched folder, so that one left without rows is replaced as well
        marks = touched.withColumn("__row", F.lit(False))
        kept = rows.withColumns({"__bucket": self._bucket(), "__row": F.lit(True)})
        both = durable(kept.unionByName(marks, allowMissingColumns=True).repartition("__bucket"))
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> "BucketTable":
        self._write(rows, self.spark.range(self.buckets).select(F.col("id").cast("int").alias("__bucket")))
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path).filter("__row")

    def read(self) -> DataFrame:
        return self._stored().drop("__bucket", "__row")

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets that the keys of ``changes`` fall into, ``buckets`` at most."""
        return sorted(r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect())

    def part(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; other folders are not read."""
        return self._stored().filter(F.col("__bucket").isin(buckets)).drop("__bucket", "__row")

    def upsert(self, changes: DataFrame, merge: Merge) -> list[int]:
        """Replace the touched part by ``merge(stored part, changes)``, which must keep rows inside their keys; returns the touched buckets."""
        changes = durable(changes)
        buckets = self.touched(changes)
        if buckets:
            at = self.spark.createDataFrame([(b,) for b in buckets], "__bucket int")
            self._write(merge(self.part(buckets), changes), at)
        return buckets

    def delete(self, removed: DataFrame) -> list[int]:
        """Remove the rows whose keys are in ``removed``; null keys equal nothing."""
        return self.upsert(removed.select(*self.keys).distinct(), lambda stored, gone: stored.join(gone, self.keys, "left_anti"))
