"""Effects of a run of rows against the fold itself, from every state it may be entered with."""

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bridgeflow import scale
from bridgeflow.effects import BreakerEffect, Bucket, BucketEffect, DedupeEffect
from bridgeflow.operators import resilience as rs

GAPS = st.lists(st.integers(0, 12), min_size=1, max_size=60)


def times(gaps, start=100):
    out = []
    for g in gaps:
        start += g
        out.append(start)
    return out


def summed(effect, rows, cut):
    acc = effect.start()
    for part in (rows.iloc[:cut], rows.iloc[cut:]):
        if len(part):
            acc = effect.add(acc, part)
    return effect.finish(acc)


@given(GAPS, st.integers(0, 30), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_dedupe(gaps, ttl, cut):
    rows = pd.DataFrame({"t": times(gaps)})
    effect, fold = DedupeEffect("t", ttl), rs.dedupe_fold("t", ttl)
    made = summed(effect, rows, cut)
    for first in [None, *range(50, int(rows.t.iloc[0]) + 1)]:
        assert effect.apply(made, first) == fold(first, rows)[1]


@given(st.lists(st.tuples(st.integers(0, 9), st.booleans(), st.booleans()), min_size=1, max_size=60), st.integers(1, 30), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_breaker(steps, half_open, cut):
    rows = pd.DataFrame({"t": times([s[0] for s in steps]), "bad": [s[1] for s in steps], "__full": [s[2] for s in steps]})
    o = rs.BreakerOptions(half_open=half_open)
    effect, fold = BreakerEffect("t", "bad", half_open), rs.breaker_fold("t", "bad", o)
    made = summed(effect, rows, cut)
    for state in [("closed", 0), *(("open", x) for x in range(60, int(rows.t.iloc[0]) + 1))]:
        assert effect.apply(made, state) == fold(state, rows)[1]


@given(GAPS, st.sampled_from([(0.25, 1.0), (0.5, 1.0), (0.4, 2.5), (3.0, 3.0), (1.5, 4.0), (0.3, 0.3)]), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_bucket(gaps, kind, cut):
    rows = pd.DataFrame({"t": [t * 400_000 for t in times(gaps)]})
    bucket = Bucket(*kind)
    effect, fold = BucketEffect("t", bucket), rs.bucket_fold("t", bucket)
    made = summed(effect, rows, cut)
    first = int(rows.t.iloc[0])
    for credit in sorted({0, 1, bucket.full, bucket.full // 2, bucket.full // 3, *(bucket.full * i // 40 for i in range(41))}):
        for last in (None, first, first - 300_000, first - 5_000_000):
            assert effect.apply(made, (credit, last)) == fold((credit, last), rows)[1]


@pytest.mark.parametrize("rate", [1 / 43200, 0.1, 0.7, 2.0, 1e-9, 2.5, 1000.0])
def test_bucket_refills_at_its_rate(rate):
    bucket = Bucket(rate, max(rate, 1.0))
    assert bucket.gain * 1e6 / bucket.cost == pytest.approx(rate, rel=1e-9)
    assert bucket.full / bucket.cost == pytest.approx(max(rate, 1.0))


@pytest.mark.parametrize("kind", ["bucket", "dedupe", "breaker"])
def test_jobs_do_not_grow_with_the_pieces(spark, kind, monkeypatch):
    """An overrun limiter, an id that never rests and a flapping breaker on one key, in many pieces."""
    n = 4_000
    rows = spark.range(n).select(F.col("id"), F.lit("k").alias("key"), (F.col("id") * 100_003).alias("t"), (F.col("id") % 3 != 0).alias("bad"))
    run = {"bucket": lambda p: rs.token_bucket(rows, "key", "t", "id", 0.7, partitions=p).select("id", F.col("passed").alias("x")),
           "dedupe": lambda p: rs.dedupe_ttl(rows, "key", "t", "id", 777_777, p).select("id", F.col("is_duplicate").alias("x")),
           "breaker": lambda p: rs.circuit_breaker(rows, "key", "t", "id", "bad", rs.BreakerOptions(half_open=1_234_567), partitions=p).select("id", F.col("state").alias("x"))}[kind]
    want = {r["id"]: r["x"] for r in run(1).collect()}
    assert len(set(want.values())) > 1
    monkeypatch.setattr(scale, "_border_states", None)  # the round by round way is not taken
    tracker = spark.sparkContext.statusTracker()
    used = {}
    for pieces in (5, 25):
        spark.sparkContext.setJobGroup(f"{kind}{pieces}", "")
        assert {r["id"]: r["x"] for r in run(pieces).collect()} == want
        used[pieces] = len(tracker.getJobIdsForGroup(f"{kind}{pieces}"))
    spark.sparkContext.setJobGroup("", "")
    assert used[25] <= used[5] + 2
