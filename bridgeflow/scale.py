"""Order-dependent work on keys of any size.

A single key may hold a large part of all rows, so nothing here gathers a key into one task:

* ``ordered_fold`` range-partitions rows by (key, time, id), which splits a hot key over many
  partitions, folds each partition as a stream of Arrow batches and carries a small state over
  the partition borders inside a key.
* ``running_sum`` and ``ranked`` add up the rows of a key from bucket totals plus a sum inside each bucket.
* ``previous_value`` is ``lag`` by one row with the same bucketing.
* ``trailing`` and ``next_match`` look back or ahead over a time range, one time bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .session import durable

Fold = Callable[[object, pd.DataFrame], tuple[dict, object]]


def _key_runs(keys: pd.Series) -> Iterator[tuple[str, int, int]]:
    values = keys.to_numpy()
    if len(values) == 0:
        return
    starts = [0] + [int(i) + 1 for i in (values[1:] != values[:-1]).nonzero()[0]]
    for a, b in zip(starts, starts[1:] + [len(values)]):
        yield values[a], a, b


def ordered_fold(
    df: DataFrame,
    key: Column,
    order: list[str],
    fold: Fold,
    init: Callable[[], object],
    out: T.StructType,
    partitions: int | None = None,
    effect=None,
) -> DataFrame:
    """Run ``outputs, state = fold(state, rows)`` over the rows of each key in ``order``.

    ``fold`` gets consecutive rows of one key and may be called several times per key; its
    outputs are appended to the input columns. States must compare with ``==`` and should keep
    nothing but what later decisions need: no totals, no entries that have run out. The border
    states are found by repeating the fold on the straddling pieces until none changes, so the
    result is exact; pieces whose state forgets its past settle in the first rounds. With an
    ``effect`` of the fold (see ``effects``) the border states are found in one job.

    Without ``partitions`` the rows are cut into as many pieces as the shuffle setting says, of
    which adaptive execution joins small ones by their real sizes.
    """
    # never null, so that a null key is one like any other
    keyed = df.withColumn("__k", F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")))
    fixed = durable(
        keyed.repartitionByRange(*([partitions] if partitions else []), "__k", *order)
        .sortWithinPartitions("__k", *order)
        .withColumn("__p", F.spark_partition_id())
    )

    # one row per partition: the only thing the driver sees besides border states
    spans = sorted(
        fixed.groupBy("__p").agg(F.min("__k").alias("lo"), F.max("__k").alias("hi")).collect(),
        key=lambda r: r["__p"],
    )
    feeds = {}  # partition -> partition whose last key continues in it
    for a, b in zip(spans, spans[1:]):
        if a["hi"] == b["lo"]:
            feeds[b["__p"]] = a["__p"]
    entry = {}
    if feeds:
        entry = _border_states(fixed, spans, feeds, fold, init) if effect is None else _relayed_states(fixed, spans, feeds, fold, init, effect)

    fields = [f for f in fixed.schema.fields if f.name not in ("__k", "__p")]
    schema = T.StructType(fields + out.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            made: dict[str, list] = {f.name: [] for f in out.fields}
            for k, a, b in _key_runs(pdf["__k"]):
                if k != current:
                    first = current is None
                    current = k
                    p = int(pdf["__p"].iat[a])
                    state = entry[p] if first and p in entry else init()
                cols, state = fold(state, pdf.iloc[a:b])
                for name, values in made.items():
                    values.extend(cols[name])
            # the outputs of all keys join the batch at once
            yield pdf.drop(columns=["__k", "__p"]).assign(**{n: pd.Series(v, dtype=object, index=pdf.index) for n, v in made.items()})

    return fixed.mapInPandas(run, schema)


def _border_states(fixed, spans, feeds, fold, init) -> dict:
    """State of each straddling key on entering each partition it continues in."""
    import pickle

    lo = {r["__p"]: r["lo"] for r in spans}
    hi = {r["__p"]: r["hi"] for r in spans}
    sources = sorted(set(feeds.values()))
    exits = dict.fromkeys(sources)
    used: dict[int, bytes] = {}
    todo = sources
    while todo:
        start = {}
        for p in todo:
            through = p in feeds and lo[p] == hi[p]
            known = exits.get(feeds[p]) if through else None
            start[p] = known if known is not None else pickle.dumps(init())
            used[p] = start[p]
        wanted = {p: hi[p] for p in todo}

        def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, seen = None, None
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                p = int(pdf["__p"].iloc[0])
                part = pdf[pdf["__k"] == wanted[p]]
                if len(part) == 0:
                    continue
                if seen is None:
                    seen, state = p, pickle.loads(start[p])
                _, state = fold(state, part)
            if seen is not None:
                yield pd.DataFrame({"p": [seen], "state": [pickle.dumps(state)]})

        pieces = fixed.filter(F.col("__p").isin(todo) & F.col("__k").isin(sorted(set(wanted.values()))))
        rows = pieces.mapInPandas(tail, "p int, state binary").collect()
        for r in rows:
            exits[r["p"]] = bytes(r["state"])
        todo = [
            p for p in sources
            if p in feeds and lo[p] == hi[p] and exits[feeds[p]] != used[p]
            and pickle.loads(exits[feeds[p]]) != pickle.loads(used[p])
        ]
    return {p: pickle.loads(exits[src]) for p, src in feeds.items()}


def _relayed_states(fixed, spans, feeds, fold, init, effect) -> dict:
    """As ``_border_states``: all pieces are summed up at once, then their summaries applied key by key, in order."""
    import pickle

    lo = {r["__p"]: r["lo"] for r in spans}
    hi = {r["__p"]: r["hi"] for r in spans}
    sources = sorted(set(feeds.values()))
    wanted = {p: hi[p] for p in sources}
    through = {p for p in sources if p in feeds and lo[p] == hi[p]}

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, seen = None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            p = int(pdf["__p"].iloc[0])
            part = pdf[pdf["__k"] == wanted[p]]
            if len(part) == 0:
                continue
            if seen is None:
                seen, acc = p, effect.start() if p in through else init()
            acc = effect.add(acc, part) if p in through else fold(acc, part)[1]
        if seen is not None:
            yield pd.DataFrame({"k": [wanted[seen]], "p": [seen], "made": [pickle.dumps(effect.finish(acc) if seen in through else acc)]})

    def relay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            states = []
            for p, made in zip(pdf["p"].tolist(), pdf["made"].tolist()):
                state = effect.apply(pickle.loads(made), state) if p in through else pickle.loads(made)
                states.append(pickle.dumps(state))
            yield pd.DataFrame({"p": pdf["p"], "state": states})

    pieces = fixed.filter(F.col("__p").isin(sources) & F.col("__k").isin(sorted(set(wanted.values()))))
    # a row per piece; those of a key follow one another
    summed = pieces.mapInPandas(sum_up, "k string, p int, made binary").repartition("k").sortWithinPartitions("k", "p")
    exits = {r["p"]: pickle.loads(bytes(r["state"])) for r in summed.mapInPandas(relay, "p int, state binary").collect()}
    return {p: exits[src] for p, src in feeds.items()}


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` whose keys are equal, null to null."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, same).drop(*[f"__r_{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to each row of its key; ``bucket`` must grow with the first order column.

    Bucket totals give the sum before each bucket, a window inside the bucket the rest, so a key
    of any size is spread over its buckets.
    """
    local = df.withColumn("__b", bucket).withColumn("__v", value.cast("long"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = local.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    offsets = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        join_same(local.withColumn("__s", F.sum("__v").over(inside)), offsets, keys + ["__b"])
        .withColumn(name, F.col("__o") + F.col("__s")).drop("__b", "__v", "__s", "__o")
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """1-based position of each row in its key."""
    return running_sum(df, keys, order, bucket, F.lit(1), name)


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str
) -> DataFrame:
    """Value of the preceding row of the same key, null for the first row."""
    local = df.withColumn("__b", bucket)
    last = local.groupBy(*keys, "__b").agg(F.max_by(F.col(value), F.struct(*order)).alias("__v"))
    over = W.partitionBy(*keys).orderBy("__b")
    carry = last.select(*keys, "__b", F.lag("__v").over(over).alias("__c"))
    inside = W.partitionBy(*keys, "__b").orderBy(*order)
    return (
        join_same(local.withColumn("__f", F.row_number().over(inside)).withColumn("__l", F.lag(value).over(inside)), carry, keys + ["__b"])
        .withColumn(name, F.when(F.col("__f") == 1, F.col("__c")).otherwise(F.col("__l")))
        .drop("__b", "__f", "__l", "__c")
    )


def trailing(df: DataFrame, keys: list[str], time: str, length: int, sums: dict[str, Column]) -> DataFrame:
    """Integer sums over rows of the key with time in [t - length, t]; ``time`` is a bigint column.

    Each row adds its values at t and takes them back after t + length, so one running sum per
    (key, time bucket) gives every window; a bucket also gets the rows of the one before it.
    """
    b = F.floor(F.col(time) / length)
    copy = lambda bucket, at, sign, out: F.struct(
        bucket.alias("__b"), at.alias("__at"), F.lit(sign).alias("__sign"), F.lit(out).alias("__out"))
    t = F.col(time)
    copies = df.withColumn("__c", F.explode(F.array(
        copy(b, t, 1, True), copy(b + 1, t, 1, False), copy(b + 1, t + length + 1, -1, False))))
    # plain columns, so that all sums share one window and one shuffle
    copies = copies.select("*", "__c.*").drop("__c")
    over = W.partitionBy(*keys, "__b").orderBy("__at").rangeBetween(W.unboundedPreceding, 0)
    made = copies.withColumns({name: F.sum(value * F.col("__sign")).over(over) for name, value in sums.items()})
    return made.filter("__out").drop("__b", "__at", "__sign", "__out")


def next_match(
    df: DataFrame, keys: list[str], time: str, tie: str, length: int, found: Column, name: str
) -> DataFrame:
    """The nearest later non-null ``found`` of the same key no more than ``length`` after the row.

    ``found`` must be a struct holding its own time as ``at``.
    """
    b = F.floor(F.col(time) / length)
    copies = (
        df.withColumn("__f", found)
        .withColumn("__c", F.explode(F.when(F.col("__f").isNull(), F.array(F.struct(b.alias("b"), F.lit(True).alias("out"))))
                                     .otherwise(F.array(F.struct(b.alias("b"), F.lit(True).alias("out")),
                                                        F.struct((b - 1).alias("b"), F.lit(False).alias("out"))))))
    )
    later = W.partitionBy(*keys, "__c.b").orderBy(F.desc(time), F.desc(tie)).rowsBetween(W.unboundedPreceding, -1)
    near = F.last("__f", ignorenulls=True).over(later)
    return (
        copies.withColumn(name, near).filter("__c.out")
        .withColumn(name, F.when(F.col(name)["at"] - F.col(time) <= length, F.col(name)))
        .drop("__c", "__f")
    )
