"""Streams give the rows of the batch form."""

import pytest
from pyspark.sql import functions as F

from bridgeflow.operators import registry as rg
from bridgeflow.operators import resilience as rs
from bridgeflow.operators import topology as tp
from bridgeflow.sources import files, kafka
from bridgeflow.streaming import jobs, stateful
from test_scale import SECOND, result, skewed


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Skewed rows in four files, in time order, read one per micro-batch."""
    data = skewed(400, seed=9).sort_values(["t", "id"], ignore_index=True)
    folder = str(tmp_path_factory.mktemp("rows"))
    for i in range(4):
        part = spark.createDataFrame(data.iloc[i * 100:(i + 1) * 100]).withColumn("ts", F.timestamp_micros("t"))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.read.parquet(folder)


def run(spark, df, tmp_path, mode="append"):
    name = "out_" + tmp_path.name.replace("-", "_")
    query = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return spark.table(name)


def stream(spark, parts):
    folder, batch = parts
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)


BREAKER = rs.BreakerOptions(window=20 * SECOND, half_open=15 * SECOND)


def test_dedupe(spark, parts, tmp_path):
    rows = stream(spark, parts).withWatermark("ts", "5 seconds")
    got = run(spark, stateful.dedupe_ttl(rows, "msg", "t", "id", 30 * SECOND), tmp_path)
    assert result(got, "is_duplicate") == result(rs.dedupe_ttl(parts[1], "msg", "t", "id", 30 * SECOND), "is_duplicate")


def test_breaker(spark, parts, tmp_path):
    got = run(spark, stateful.circuit_breaker(stream(spark, parts), "key", "t", "id", "bad", BREAKER), tmp_path)
    want = rs.circuit_breaker(parts[1], "key", "t", "id", "bad", BREAKER)
    for column in ("on_arrival", "state", "trip"):
        assert result(got, column) == result(want, column)


def test_token_bucket(spark, parts, tmp_path):
    rows = stream(spark, parts).withWatermark("ts", "5 seconds")
    got = run(spark, stateful.token_bucket(rows, "key", "t", "id", 0.4), tmp_path)
    assert result(got, "passed") == result(rs.token_bucket(parts[1], "key", "t", "id", 0.4), "passed")


def test_sliding_limit(spark, parts, tmp_path):
    rows = stream(spark, parts).withWatermark("ts", "5 seconds")
    got = run(spark, stateful.sliding_rate_limit(rows, "key", "t", "id", "cost", 10), tmp_path)
    assert result(got, "allowed") == result(rs.sliding_rate_limit(parts[1], "key", "t", "id", "cost", limit=10), "allowed")


def test_message_path(spark, parts, tmp_path):
    o = rs.PathOptions(breaker=BREAKER, ttl=20 * SECOND, capacity=3, rate_hz=0.8)
    flags = lambda d: d.withColumn("ok", F.col("cost") == 1).withColumn("wrote", ~F.col("bad"))
    got = run(spark, stateful.process_messages(flags(stream(spark, parts)), "key", "t", "id", "msg", "ok", "wrote", o), tmp_path)
    want = rs.process_messages(flags(parts[1]), "key", "t", "id", "msg", "ok", "wrote", o)
    assert result(got, "outcome") == result(want, "outcome")


def test_drift(spark, parts, tmp_path):
    shape = lambda d: d.select("id", F.col("key").alias("node_id"), F.array(F.col("key"), F.col("cost").cast("string")).alias("names"),
                               F.array(F.lit("t")).alias("tags"))
    got = run(spark, stateful.register_or_drift(shape(stream(spark, parts)), ["id"]), tmp_path)
    assert result(got, "action") == result(rg.register_or_drift(shape(parts[1]), ["id"]), "action")


def test_dedupe_at_least(spark, parts, tmp_path):
    got = run(spark, jobs.stateful.dedupe_at_least(stream(spark, parts).filter("msg IS NOT NULL"), "msg", "ts", "30 seconds"), tmp_path)
    exact = rs.dedupe_ttl(parts[1].filter("msg IS NOT NULL"), "msg", "t", "id", 30 * SECOND).filter("NOT is_duplicate")
    assert 0 < got.count() <= exact.count()


def test_throughput(spark, parts, tmp_path):
    got = run(spark, jobs.throughput(stream(spark, parts), "key", "ts", F.lit(2), "30 seconds"), tmp_path, "complete")
    want = parts[1].groupBy("key", F.window("ts", "30 seconds")).agg(F.count(F.lit(1)).alias("messages"))
    rows = lambda d: sorted((r["key"], r["window"]["start"], r["messages"]) for r in d.collect())
    assert rows(got) == rows(want)
    assert got.filter("bytes <> 2 * messages").count() == 0


def test_approvals(spark, parts, tmp_path):
    """One row per staged pair, the first decision counts; decisions that arrive before what they decide count too."""
    folder, batch = parts
    batch = batch.withColumn("ts", F.timestamp_micros("t"))
    end = batch.agg(F.max("t")).first()[0]
    # later rows move the watermark on, so that rows without a decision come out
    extra = spark.createDataFrame([(10_000 + c, "end", end + 3600 * SECOND, False, "x", c) for c in (1, 2)], batch.drop("ts").schema).withColumn("ts", F.timestamp_micros("t"))
    decisions_first = batch.orderBy(F.desc("cost"), F.desc("id"))
    for part in (decisions_first, extra, extra.withColumns({"t": F.col("t") + 3600 * SECOND, "ts": F.col("ts") + F.expr("INTERVAL 1 HOUR")})):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    staged = rows.filter("cost = 1").select("key", "id", "t", "msg", "ts")
    decisions = rows.filter("cost = 2").select("key", "id", "t", "ts", (~F.col("bad")).alias("approved"))
    got = run(spark, stateful.resolve_approvals(staged, decisions, ["key"], "t", "id", "ts", 20 * SECOND), tmp_path).filter("id < 10000")
    from bridgeflow.operators.policy import resolve_approvals

    want = resolve_approvals(batch.filter("cost = 1").select("key", "id", "t", "msg"), batch.filter("cost = 2").select("key", "id", "t", (~F.col("bad")).alias("approved")),
                             ["key"], "t", "id", 20 * SECOND)
    shape = lambda d: sorted((r["id"], r["key"], r["t"], r["msg"] or "", r["outcome"], r["decided_at"] or 0) for r in d.collect())
    assert shape(got) == shape(want)
    assert {r["outcome"] for r in got.collect()} == {"approved", "rejected", "timed_out"}


def test_fan_out_survives_a_failing_sink(spark, parts, tmp_path):
    def fail(_):
        raise RuntimeError("down")

    sinks = [tp.Sink("good", lambda d: d.select("id"), lambda d: d.write.mode("append").parquet(str(tmp_path / "good"))),
             tp.Sink("bad", lambda d: d, fail)]
    seen = []
    query = jobs.fan_out(stream(spark, parts), sinks, lambda i, results: seen.extend(results)).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 400
    assert {(b, ok) for b, ok, _ in seen} == {("good", True), ("bad", False)}


def test_rerun_batch_replaces_its_folder(spark, parts, tmp_path):
    jobs.write_batches(stream(spark, parts).select("id"), str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 400


def test_topic_source_and_sink(spark, tmp_path):
    rows = [(b"k", b'{"id": 7}', "t", 0, 0, None), (None, b"plain", "t", 0, 1, None)]
    spark.createDataFrame(rows, kafka.TOPIC_SCHEMA).write.parquet(str(tmp_path / "topic"))
    read = kafka.topic_source(spark, {}, fmt="parquet", path=str(tmp_path / "topic"))
    got = run(spark, read.select("offset", "decode_ok", F.to_json("payload").alias("p")), tmp_path)
    assert {(r["offset"], r["decode_ok"], r["p"]) for r in got.collect()} == {(0, True, '{"id":7}'), (1, False, '{"data":"plain"}')}
    out = read.select(F.lit("k").alias("key"), F.to_json("payload").alias("body"))
    kafka.topic_sink(out, {"path": str(tmp_path / "out"), "checkpointLocation": str(tmp_path / "c")}, fmt="parquet", key="key").trigger(
        availableNow=True).start().awaitTermination(60)
    values = {bytes(r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert values == {b'{"key":"k","body":"{\\"id\\":7}"}', b'{"key":"k","body":"{\\"data\\":\\"plain\\"}"}'}
    raw = kafka.topic_rows(spark.createDataFrame([(b"x",)], "v binary"), value="v").first()
    assert bytes(raw["value"]) == b"x"


def test_jsonl_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a": 1}\n\n  \nhello\n')
    got = run(spark, files.jsonl_stream(spark, str(tmp_path / "in")).select(F.to_json("payload").alias("p")), tmp_path)
    assert sorted(r["p"] for r in got.collect()) == ['{"a":1}', '{"line":"hello"}']
    assert files.jsonl_source(spark, str(tmp_path / "in")).count() == 2


def test_message_path_from_bytes(spark, tmp_path):
    rows = [(i, "b1", i * SECOND, b'{"id": 1}' if i < 2 else b"oops" if i == 2 else b'{"id": 9}') for i in range(4)]
    spark.createDataFrame(rows, "id long, bridge string, t long, raw binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("id long, bridge string, t long, raw binary").parquet(str(tmp_path / "in")).withColumn("protocol", F.lit("mqtt"))
    got = run(spark, jobs.message_path(raw, "bridge", "t", "id", F.lit(True), rs.PathOptions()), tmp_path)
    assert result(got, "outcome") == {0: "delivered", 1: "duplicate", 2: "transform_error", 3: "delivered"}
