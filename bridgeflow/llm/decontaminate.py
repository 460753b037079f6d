"""Benchmark decontamination by a broadcast hash set of word n-grams, in DataFrame operations only.

Words are runs of digits, letters and other characters beyond ASCII, with A-Z in lower case. Every
run of ten words of a benchmark item is a window; an item of fewer words is one window of its own
length. All windows of a text are hashed in place, looked up in the set of window hashes, and a
hit counts only if the words themselves are equal.

The hash set is broadcast in blocks of a bounded number of windows, one scan of the texts for each
block, so a benchmark of any size can be held; the usual one is a single block. The windows of a
text never leave its task: what is shuffled is one row per text and its hits.

Null and empty texts have no words and no hits; items without words hit nothing; an item whose id
is null hits words but is not listed. Repeated rows each get their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .common import small

WINDOW = 10
#: Windows that one broadcast holds at most, about 100 MB with their words.
BROADCAST_WINDOWS = 250_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Normalised words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, _GAP, -1), lambda w: w != "")


def _windows(words: Column, length: int) -> Column:
    """(place, hash) of every run of ``length`` words, places from 1; none in a shorter text."""
    places = F.sequence(F.lit(1), F.size(words) - length + 1)
    each = F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(length).alias("n"), F.xxhash64(F.slice(words, i, length)).alias("h")))
    return F.when(F.size(words) >= length, each).otherwise(F.expr("array()").cast("array<struct<at:int,n:int,h:bigint>>"))


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``h``, ``n``, ``gram`` (its words) and ``items``, the ids of the items that hold it."""
    items = benchmark.select(F.col(f"`{key}`").alias("item"), words_of(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    grams = items.select("item", length.alias("n"), F.explode(
        F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("gram"))
    return grams.groupBy("n", "gram").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("h", F.xxhash64("gram"))


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                  block: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: its key, ``text_id`` (MD5), ``n_words``, ``spans`` (hit words as from, past the end) and ``items`` (ids whose windows occur)."""
    grams = benchmark_windows(benchmark, window=window)
    sizes = {r["n"]: r["count"] for r in grams.groupBy("n").count().collect()}  # at most one row per length up to the window
    blocks = max(1, -(-sum(sizes.values()) // block))
    source = documents.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    # texts with the same key and words share a result, which is given back once per row
    source = source.select("__key", F.md5("__t").alias("__id"), words_of(F.col("__t")).alias("w"))
    found = None
    for b in range(blocks):
        mine = grams if blocks == 1 else grams.filter(F.pmod("h", F.lit(blocks)) == b)
        mark = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("h")))
        looked = [_windows(F.col("w"), n) for n in sorted(sizes)] + ([mark] if b == 0 else [])
        probes = source.select("__key", "__id", "w", F.inline(F.concat(*looked))) if looked else source.limit(0)
        set_ = mine.select(F.col("h").alias("__h"), F.col("n").alias("__n"), "gram", "items")
        same = (F.col("h") == F.col("__h")) & (F.col("n") == F.col("__n")) & (F.slice("w", F.greatest("at", F.lit(1)), F.col("n")) == F.col("gram"))
        hits = probes.join(F.broadcast(set_), same, "left").filter((F.col("n") == 0) | F.col("gram").isNotNull())
        hits = hits.select("__key", "__id", "at", "n", F.when(F.col("n") == 0, F.size("w")).alias("size"), "items")
        found = hits if found is None else found.unionByName(hits)
    grouped = found.groupBy("__key", "__id").agg(
        F.max("size").cast("long").alias("n_words"), F.count("size").cast("int").alias("__rows"),
        F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.struct("at", (F.col("at") + F.col("n")).alias("end"))))).alias("__hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    merged = grouped.withColumn("spans", merge_spans(F.col("__hits"))).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__rows"))))
    return merged.select(F.col("__key").alias(key), F.col("__id").alias("text_id"), "n_words", "spans", F.filter("items", lambda x: x.isNotNull()).alias("items"))


def merge_spans(hits: Column) -> Column:
    """Union of overlapping or touching stretches, given in order."""
    kind = "array<struct<at:int,end:int>>"
    start = F.struct(F.expr("array()").cast(kind).alias("done"), F.lit(None).cast("struct<at:int,end:int>").alias("now"))

    def step(state, hit):
        joins = state["now"].isNotNull() & (hit["at"] <= state["now"]["end"])
        longer = F.struct(state["now"]["at"].alias("at"), F.greatest(state["now"]["end"], hit["end"]).alias("end"))
        closed = F.when(state["now"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["now"])))
        return F.struct(F.when(joins, state["done"]).otherwise(closed).alias("done"), F.when(joins, longer).otherwise(F.struct(hit["at"].alias("at"), hit["end"].alias("end"))).alias("now"))

    return F.aggregate(hits, start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["at"])


def without_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark window; every clean row stays as it is."""
    hit = contamination(documents, benchmark, key, text).filter(F.size("spans") > 0).select("text_id").distinct()
    marked = documents.withColumn("__id", F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return marked.join(small(durable(hit)), F.col("__id") == F.col("text_id"), "left_anti").drop("__id")
