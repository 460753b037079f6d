"""State tables in buckets: small upserts, deletes, repeats."""

import os

import pytest
from pyspark.sql import functions as F

from bridgeflow.operators import lifecycle as lc
from bridgeflow.operators import registry as rg
from bridgeflow.sources.tables import BucketTable


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def nodes(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("n"), "id").alias("node_id"), F.col("id").alias("v"), F.lit("old").alias("note"))
    return BucketTable(spark, str(tmp_path / "nodes"), ["node_id"], 32).create(rows)


def newest(stored, fresh):
    return rg.registry_upsert(stored, fresh, "v")


def content(table):
    return {r["node_id"]: (r["v"], r["note"]) for r in table.read().collect()}


def test_small_batch_touches_a_small_part(spark, nodes):
    assert nodes.read().count() == 500 and nodes.read().columns == ["node_id", "v", "note"]
    before, rows = files(nodes.path), content(nodes)
    batch = spark.createDataFrame([("n7", 1000, "new"), ("n9", -5, "stale"), ("other", 1, "first")], "node_id string, v long, note string")
    buckets = nodes.upsert(batch, newest)
    assert 1 <= len(buckets) <= 3
    # the read of the part sees the touched folders only, and the others keep their files
    plan = nodes.part(buckets)._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scanned = nodes.part(buckets).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("__bucket=")[1].split("/")[0]) for r in scanned} <= set(buckets)
    kept = {f for f in before if int(f.split("__bucket=")[1].split("/")[0]) not in buckets}
    assert len(kept) >= 29 and kept <= files(nodes.path)
    rows.update({"n7": (1000, "new"), "other": (1, "first")})
    assert content(nodes) == rows
    nodes.upsert(batch, newest)
    assert content(nodes) == rows


def test_deletes_empty_a_bucket(spark, nodes):
    removed = nodes.read().filter("v % 3 <> 0").select("node_id")
    assert len(nodes.delete(removed)) == 32
    assert set(content(nodes)) == {f"n{i}" for i in range(0, 500, 3)}
    nodes.delete(nodes.read())
    assert content(nodes) == {}
    nodes.upsert(spark.createDataFrame([("n1", 1, "again")], "node_id string, v long, note string"), newest)
    assert content(nodes) == {"n1": (1, "again")}


def test_empty_batch_and_null_keys(spark, nodes):
    none = nodes.read().limit(0)
    before = files(nodes.path)
    assert nodes.upsert(none, newest) == [] and files(nodes.path) == before
    nodes.upsert(spark.createDataFrame([(None, 3, "null"), (None, 4, "later")], "node_id string, v long, note string"), newest)
    assert content(nodes)[None] == (4, "later") and len(content(nodes)) == 501


def test_bridges_keep_what_they_were_born_with(spark, tmp_path):
    columns = "producer_id string, consumer_id string, bridge_id string, adapter string, score double, provenance string, created_at long, updated_at long"
    row = lambda i, mark, t: (f"p{i}", f"c{i}", mark + str(i), mark + "a", 0.5, mark + "key", t, t)
    table = BucketTable(spark, str(tmp_path / "bridges"), ["producer_id", "consumer_id"], 8).create(spark.createDataFrame([row(i, "o", 1) for i in range(40)], columns))
    for _ in range(2):
        table.upsert(spark.createDataFrame([row(3, "n", 2), row(99, "n", 2)], columns), lc.bridge_checkpoint)
        got = {r["producer_id"]: (r["bridge_id"], r["provenance"], r["created_at"], r["updated_at"]) for r in table.read().collect()}
        assert len(got) == 41 and got["p3"] == ("n3", "okey", 1, 2) and got["p99"] == ("n99", "nkey", 2, 2) and got["p4"] == ("o4", "okey", 1, 1)
