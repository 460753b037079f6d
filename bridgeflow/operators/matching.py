"""Embeddings, similarity, field alignment, pair scoring and the candidate queue."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import fixed
from ..functions.text import let, name_grams, string_map
from ..session import counted, durable, shuffled


# ---- contract text and embeddings -------------------------------------------------

def contract_text(encoding: Column, names: Column, tags: Column) -> Column:
    return F.concat(F.lit("encoding:"), encoding, F.lit(" fields:"), F.array_join(names, " "),
                    F.lit(" tags:"), F.array_join(tags, " "))


def gram_bucket(gram: Column, buckets: int = fixed.EMBED_BUCKETS) -> Column:
    return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") % buckets


#: Words and grams that a task remembers, and the longest word of them.
KNOWN_WORDS, KNOWN_GRAMS, LONGEST_KNOWN = 100_000, 300_000, 40
#: What Java's ``(?U)\s`` takes as white space.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Buckets(dict):
    """Bucket of each gram met (``gram_bucket``), a bounded number of them."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= KNOWN_GRAMS:
            self.clear()
        self[gram] = found = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big") % fixed.EMBED_BUCKETS
        return found


class GramCounter:
    """Counts the 1-3-grams of lower-case texts by bucket; grams lie inside words, so each distinct word of a text is cut up once."""

    def __init__(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.buckets = _Buckets()

    def of_word(self, word: str) -> np.ndarray:
        """Bucket of every gram of a word, with repeats."""
        found = self.words.get(word)
        if found is None:
            grams = [*word, *[word[i:i + 2] for i in range(len(word) - 1)], *[word[i:i + 3] for i in range(len(word) - 2)]]
            found = np.fromiter(map(self.buckets.__getitem__, grams), np.int64, len(grams))
            if len(word) <= LONGEST_KNOWN:
                if len(self.words) >= KNOWN_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def of_text(self, text: str) -> np.ndarray:
        words = Counter(_WORD.findall(text))
        if not words:
            return np.zeros(fixed.EMBED_BUCKETS, np.int64)
        found = [self.of_word(w) for w in words]
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(g) for g in found])
        return np.bincount(np.concatenate(found), times, fixed.EMBED_BUCKETS).astype(np.int64)


def ngram_embedding(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse embedding rows (key, dim, weight) from character 1-3-grams of the whole text.

    The rows are shuffled once, as texts, and read in the order of their keys: a task holds the
    buckets of one key, however many texts, words and grams it has.
    """
    stride = fixed.EMBED_BUCKETS // fixed.EMBED_DIM
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("dim", T.LongType()), T.StructField("weight", T.DoubleType())])

    def rows(done: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, dims, weights = [], [], []
        for one, counts in done:
            total = counts[:fixed.EMBED_DIM * stride].reshape(-1, stride).sum(axis=1)
            at = np.flatnonzero(total)
            if len(at):
                keys.append(one.take(pa.array(np.zeros(len(at), np.int64))))
                dims.append(at)
                weights.append(total[at] / math.sqrt(int((counts * counts).sum())) / stride)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(np.concatenate(dims)), pa.array(np.concatenate(weights))], names=["key", "dim", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter()
        one, value, counts, done = None, None, None, []
        for batch in batches:
            keys = batch.column(0)
            for i, (k, t) in enumerate(zip(keys.to_pylist(), batch.column(1))):
                if one is None or not (k == value or (k != k and value != value)):
                    if one is not None:
                        done.append((one, counts))
                    one, value, counts = keys.slice(i, 1), k, np.zeros(fixed.EMBED_BUCKETS, np.int64)
                    if len(done) >= 250:
                        yield from rows(done)
                        done = []
                counts += counter.of_text(t.as_py())
        if one is not None:
            yield from rows([*done, (one, counts)])

    source = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).filter(F.col("text").isNotNull())
    return source.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema).withColumnRenamed("key", key)


def dense(sparse: DataFrame, key: str, dims: int = fixed.EMBED_DIM) -> DataFrame:
    """One array of ``dims`` numbers per key; a key has at most ``dims`` rows."""
    entries = F.map_from_entries(F.collect_list(F.struct("dim", "weight")))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")),
                       lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return sparse.groupBy(key).agg(entries.alias("m")).select(key, full.alias("embedding"))


def model_embedding(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Embed with a model: ``load`` runs once per worker task and returns a batch encoder."""
    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in encoder(batch.tolist())])

    return df.withColumn("embedding", encode(F.col(text)))


def embed_by_fingerprint(nodes: DataFrame, fingerprint: str, text: str) -> DataFrame:
    """Each distinct fingerprint embedded once: (fingerprint, dim, weight)."""
    return ngram_embedding(nodes.dropDuplicates([fingerprint]), fingerprint, text)


def cosine_similarity(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    scale = norm(a) * norm(b)
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / scale)))


# ---- alignment -----------------------------------------------------------------------

def type_similarity(src: Column, dst: Column) -> Column:
    table = {f"{a}>{b}": s for a, row in fixed.TYPE_COMPAT.items() for b, s in zip(fixed.LOGICAL_TYPES, row)}
    return F.coalesce(F.try_element_at(string_map(table), F.concat_ws(">", src, dst)), F.lit(fixed.DEFAULT_COMPAT))


def field_score(src: Column, dst: Column) -> Column:
    """Score of two prepared fields, structs of name, type and name grams."""
    shared = F.size(F.array_intersect(src["grams"], dst["grams"]))
    names = shared / (F.size(src["grams"]) + F.size(dst["grams"]) - shared)
    return 0.6 * names + 0.4 * type_similarity(src["type"], dst["type"])


def align_fields(src: Column, dst: Column, threshold: float = fixed.ALIGN_THRESHOLD) -> Column:
    """Greedy alignment in source order: array<struct<src_field, dst_field, transform, confidence>>."""
    positions = F.when(F.size(dst) > 0, F.sequence(F.lit(0), F.size(dst) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(
        F.array().cast("array<int>").alias("used"),
        F.array().cast("array<struct<src_field:string,dst_field:string,transform:string,confidence:double>>").alias("maps"))

    def best(state: Column, field: Column) -> Column:
        none = F.struct(F.lit(-1).alias("at"), F.lit(threshold).alias("score"))

        def better(found: Column, i: Column) -> Column:
            score = field_score(field, F.get(dst, i))
            return F.when(~F.array_contains(state["used"], i) & (score > found["score"]),
                          F.struct(i.alias("at"), score.alias("score"))).otherwise(found)

        return F.aggregate(positions, none, better)

    def step(state: Column, field: Column) -> Column:
        def bind(found: Column) -> Column:
            target = F.get(dst, found["at"])
            how = F.when(field["type"] == target["type"], "direct").otherwise(F.concat(F.lit("cast:"), target["type"]))
            entry = F.struct(field["name"].alias("src_field"), target["name"].alias("dst_field"),
                             how.alias("transform"), found["score"].alias("confidence"))
            return F.when(found["at"] < 0, state).otherwise(F.struct(
                F.concat(state["used"], F.array(found["at"])).alias("used"),
                F.concat(state["maps"], F.array(entry)).alias("maps")))

        return let(best(state, field), bind)

    return F.aggregate(src, start, step, lambda s: s["maps"])


def prepared_fields(fields: Column) -> Column:
    return F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"), name_grams(f["name"]).alias("grams")))


#: Contract pairs up to which all are aligned, so that the node pairs need not be read for those that occur.
ALL_CONTRACT_PAIRS = 10_000


def align_contracts(key_pairs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Mappings for contract pairs ``(p_ck, c_ck)``; other contract columns come from the producer.

    ``key_pairs`` may hold a pair any number of times. If the contracts are few, every pair of
    them is aligned, else those of ``key_pairs``, each once.
    """
    ready = durable(contracts.withColumn("ready", prepared_fields(F.col("fields"))))
    p = ready.withColumnsRenamed({"ck": "p_ck", "fields": "p_fields", "ready": "p_ready"})
    c = ready.select(F.col("ck").alias("c_ck"), F.col("ready").alias("c_ready"))
    if ready.count() ** 2 <= ALL_CONTRACT_PAIRS:
        joined = p.filter(F.col("p_ck").isNotNull()).crossJoin(F.broadcast(c.filter(F.col("c_ck").isNotNull())))
    else:
        joined = key_pairs.distinct().join(p, "p_ck").join(c, "c_ck")
    # few bytes and much work: not joined into one task
    joined = joined.repartition(int(contracts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_ck", "c_ck")
    return counted(joined.withColumn("mappings", align_fields(F.col("p_ready"), F.col("c_ready"))).drop("p_ready", "c_ready"))


# ---- pair components -------------------------------------------------------------------

def latency_score(producer_rate: Column, consumer_rate: Column) -> Column:
    """0.5 to 1 for how well two message rates match; a missing rate matches."""
    p = F.when(F.coalesce(producer_rate, F.lit(0.0)) == 0, 1.0).otherwise(producer_rate)
    c = F.when(F.coalesce(consumer_rate, F.lit(0.0)) == 0, p).otherwise(consumer_rate)
    ratio = F.least(p, c) / F.greatest(p, c)
    value = 0.5 + 0.5 * F.log10(F.greatest(ratio, F.lit(1e-4)) * 10000) / 4
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def quick_risk(p_listed: Column, c_listed: Column, p_protocol: Column, c_protocol: Column, p_conf: Column, c_conf: Column) -> Column:
    """Risk from blacklisting, unknown protocols and weak contracts, at most 1."""
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return F.least(F.lit(1.0), add(p_listed | c_listed, 1.0) + add((p_protocol == "unknown") | (c_protocol == "unknown"), 0.4)
                   + add((p_conf < 0.4) | (c_conf < 0.4), 0.3))


def protocol_compat(p_protocol: Column, c_protocol: Column) -> Column:
    table = {f"{a}>{b}": s for a, row in fixed.PROTOCOL_COMPAT.items() for b, s in zip(fixed.PROTOCOLS, row)}
    return F.coalesce(F.try_element_at(string_map(table), F.concat_ws(">", p_protocol, c_protocol)), F.lit(fixed.DEFAULT_COMPAT))


def bridge_history(outcomes: DataFrame) -> DataFrame:
    """Success rate per protocol pair."""
    return outcomes.groupBy("producer_protocol", "consumer_protocol").agg(
        F.avg(F.col("success").cast("double")).alias("history"), F.count(F.lit(1)).alias("n"))


def with_history(pairs: DataFrame, history: DataFrame, p: str, c: str) -> DataFrame:
    known = history.select(F.col("producer_protocol").alias(p), F.col("consumer_protocol").alias(c), "history")
    return pairs.join(known, [p, c], "left").withColumn("history", F.coalesce("history", F.lit(0.5)))


def tags_compatible(p_tags: Column, c_tags: Column) -> Column:
    """Tag sets that overlap, or one of which is empty or broad."""
    return F.arrays_overlap(p_tags, c_tags) | _broad(p_tags) | _broad(c_tags)


def _broad(tags: Column) -> Column:
    return (F.size(tags) == 0) | F.arrays_overlap(tags, F.array(*[F.lit(t) for t in fixed.BROAD_TAGS]))


# ---- pairs without a cross product --------------------------------------------------------
#
# Nodes fall into cells of equal protocol, tags and listing and of similar confidence and rate.
# Cells meet through their tag blocks; a cell pair whose best possible score is too low is
# dropped. Cells are then split by contract text into groups, texts are compared once per
# distinct pair and group pairs are dropped by the same bound. Only what is left is expanded to
# nodes and scored exactly, so the work follows the size of the result.

CELL = ["protocol", "tags", "listed", "conf_step", "rate_step"]
#: Taken consumers of one producer and group that come along in lists by bundle, tasks that share the consumers of a group,
#: and consumers, alike in all that is scored, that meet a producer as one row (about).
MOST_LISTED, SLICES, BUNDLE = 100_000, 8, 512


def _key(*names: str) -> Column:
    return F.sha2(F.to_json(F.struct(*names)), 256)


def node_profiles(nodes: DataFrame, blacklist: DataFrame | list[str] | None = None) -> DataFrame:
    """Nodes with contract text and the keys of their cell and group; unknown rates are null.

    ``blacklist`` is a table with ``node_id``, or a short list.
    """
    if isinstance(blacklist, DataFrame):
        flagged = blacklist.select("node_id", F.lit(True).alias("listed")).distinct()
        nodes = nodes.drop("listed").join(shuffled(flagged), "node_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        nodes = nodes.withColumn("listed", F.col("node_id").isin(blacklist or []))
    text = contract_text(F.col("encoding"), F.transform("fields", lambda f: f["name"]), F.col("tags"))
    rate = F.when(F.col("rate") != 0, F.col("rate"))
    return (
        nodes.withColumn("rate", rate)
        .withColumns({"text": text, "conf_step": F.floor(F.col("confidence") * 10), "rate_step": F.floor(F.log10("rate") * 2)})
        .withColumn("cell", _key(*CELL)).withColumn("grp", _key("cell", "text"))
    )


def _cells(profiles: DataFrame, roles: list[str], mark: str) -> DataFrame:
    """Cells of one side with their size, top confidence and rate range."""
    cells = profiles.filter(F.col("role").isin(roles)).groupBy("cell", "protocol", "tags", "listed").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    return cells.withColumnsRenamed({c: mark + c for c in cells.columns})


def cell_pairs(profiles: DataFrame) -> DataFrame:
    """Compatible cell pairs, met through tag blocks: each side offers its tags and asks for the other's wildcard."""
    block = lambda tags, own_any, broad_any: F.explode(F.array_distinct(F.concat(
        F.transform(tags, lambda x: F.concat(F.lit("tag:"), x)), F.array(F.lit(own_any)),
        F.when(_broad(tags), F.array(F.lit(broad_any))).otherwise(F.array().cast("array<string>")))))
    usable = profiles.filter(F.col("confidence") >= 0.2)
    p = _cells(usable, ["producer", "both"], "p_").withColumn("block", block(F.col("p_tags"), "any consumer", "any producer"))
    c = _cells(usable, ["consumer", "both"], "c_").withColumn("block", block(F.col("c_tags"), "any producer", "any consumer"))
    return p.join(c, "block").drop("block").dropDuplicates(["p_cell", "c_cell"])


def bounded_cells(cells: DataFrame, history: DataFrame, w: dict[str, float]) -> DataFrame:
    """Cell pairs with ``bound``, the best score any of their node pairs can reach."""
    col = F.col
    out = with_history(cells, history, "p_protocol", "c_protocol")
    p_low, p_high = F.coalesce("p_low", F.lit(1.0)), F.coalesce("p_high", F.lit(1.0))
    nearest = F.when(col("c_low") > p_high, latency_score(p_high, col("c_low"))).when(
        col("c_high") < p_low, latency_score(p_low, col("c_high"))).otherwise(1.0)
    risk = quick_risk(col("p_listed"), col("c_listed"), col("p_protocol"), col("c_protocol"), col("p_confidence"), col("c_confidence"))
    out = out.withColumns({"compat": protocol_compat(col("p_protocol"), col("c_protocol")),
                           "top_confidence": F.least("p_confidence", "c_confidence")})
    rest = w["protocol"] * col("compat") + w["latency"] * nearest + w["risk"] * (1.0 - risk) + w["history"] * col("history")
    out = out.withColumn("top_rest", rest)
    return out.withColumn("bound", col("top_confidence") * (w["semantic"] + col("top_rest")))


def reaches(score: Column, minimum: float) -> Column:
    """Compare at nine digits, so that the order of summation does not decide."""
    return F.round(score, 9) >= minimum


def candidate_pairs(profiles: DataFrame, taken: DataFrame, history: DataFrame, weights: dict | None = None,
                    min_score: float = fixed.MIN_SCORE) -> DataFrame:
    """Cell pairs that can reach ``min_score`` with the number of open node pairs in each.

    ``taken`` holds active and queued pairs, which are counted out.
    """
    w = weights or fixed.SCORE_WEIGHTS
    # all components are at most 1, so a weaker contract cannot reach the minimum
    strong = profiles.filter(F.col("confidence") >= min_score / sum(w.values()))
    cells = bounded_cells(cell_pairs(strong), history, w).filter(reaches(F.col("bound"), min_score))
    out = cells.join(_taken_per_cell(strong, taken), ["p_cell", "c_cell"], "left")
    return out.withColumn("n_pairs", F.col("p_n") * F.col("c_n") - F.coalesce("n_taken", F.lit(0)))


def _taken_per_cell(profiles: DataFrame, taken: DataFrame) -> DataFrame:
    """Active, queued and self pairs per cell pair."""
    made = lambda roles, mark: profiles.filter(F.col("role").isin(roles)).select(F.col("node_id").alias(mark + "id"), F.col("cell").alias(mark + "cell"))
    p, c = made(["producer", "both"], "p_"), made(["consumer", "both"], "c_")
    pairs = taken.select(F.col("producer_id").alias("p_id"), F.col("consumer_id").alias("c_id")).distinct().filter("p_id <> c_id")
    ended = pairs.join(p, "p_id").join(c, "c_id").groupBy("p_cell", "c_cell").agg(F.count(F.lit(1)).alias("m"))
    itself = profiles.filter("role = 'both'").groupBy(F.col("cell").alias("p_cell"), F.col("cell").alias("c_cell")).agg(F.count(F.lit(1)).alias("m"))
    return ended.unionByName(itself).groupBy("p_cell", "c_cell").agg(F.sum("m").alias("n_taken"))


def pair_prefilter(profiles: DataFrame, taken: DataFrame) -> DataFrame:
    """Scored and skipped pairs per protocol pair, counted without listing pairs."""
    profiles = profiles.withColumn("listed", F.lit(False)).withColumn("cell", _key("protocol", "tags"))
    total = lambda roles, mark: profiles.filter(F.col("role").isin(roles)).groupBy(F.col("protocol").alias(mark + "protocol")).agg(F.count(F.lit(1)).alias(mark + "n"))
    grid = profiles.sparkSession.createDataFrame([(a, b) for a in fixed.PROTOCOLS for b in fixed.PROTOCOLS], "p_protocol string, c_protocol string")
    all_pairs = grid.join(total(["producer", "both"], "p_"), "p_protocol").join(total(["consumer", "both"], "c_"), "c_protocol")
    taken_cells = _taken_per_cell(profiles, taken)
    protocol = lambda mark: profiles.select(F.col("cell").alias(mark + "cell"), F.col("protocol").alias(mark + "protocol")).distinct()
    excluded = taken_cells.join(protocol("p_"), "p_cell").join(protocol("c_"), "c_cell").groupBy("p_protocol", "c_protocol").agg(F.sum("n_taken").alias("excluded"))
    # a cell may hold nodes on both sides of the confidence rule, so taken pairs are counted among usable nodes
    usable = _taken_per_cell(profiles.filter(F.col("confidence") >= 0.2), taken)
    open_cells = cell_pairs(profiles).join(usable, ["p_cell", "c_cell"], "left")
    scored = open_cells.groupBy("p_protocol", "c_protocol").agg(
        F.sum(F.col("p_n") * F.col("c_n") - F.coalesce("n_taken", F.lit(0))).alias("scored"))
    out = all_pairs.join(excluded, ["p_protocol", "c_protocol"], "left").join(scored, ["p_protocol", "c_protocol"], "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return out.select(
        F.col("p_protocol").alias("producer_protocol"), F.col("c_protocol").alias("consumer_protocol"),
        (F.col("p_n") * F.col("c_n") - zero("excluded")).alias("open"), zero("scored").alias("scored"),
        (F.col("p_n") * F.col("c_n") - zero("excluded") - zero("scored")).alias("skipped"))


def score_pairs(nodes: DataFrame, taken: DataFrame, history: DataFrame, weights: dict | None = None,
                min_score: float = fixed.MIN_SCORE, blacklist: DataFrame | list[str] | None = None,
                embeddings: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Open node pairs whose score reaches ``min_score``, with all components.

    ``embeddings`` (text, embedding) replaces the built-in text embedding. ``digits`` rounds the
    score and its components but ``compat``, once for all pairs that share them.
    """
    w = weights or fixed.SCORE_WEIGHTS
    strong = strong_profiles(nodes, w, min_score, blacklist)
    return expand_pairs(strong, group_pairs(strong, history, w, min_score, embeddings), taken, w, min_score, digits=digits)


def strong_profiles(nodes: DataFrame, w: dict[str, float], min_score: float, blacklist: DataFrame | list[str] | None = None) -> DataFrame:
    """``node_profiles`` of the nodes whose contracts are not too weak for ``min_score``: all components are at most 1."""
    return node_profiles(nodes, blacklist).filter(F.col("confidence") >= min_score / sum(w.values()))


def group_pairs(strong: DataFrame, history: DataFrame, w: dict[str, float], min_score: float, embeddings: DataFrame | None = None) -> DataFrame:
    """Pairs of groups that can reach ``min_score``: p_grp, c_grp, semantic, compat and history."""
    col = F.col
    cells = bounded_cells(cell_pairs(strong), history, w).filter(reaches(col("bound"), min_score))
    cells = cells.select("p_cell", "c_cell", "compat", "history", "top_rest", "top_confidence")

    groups = strong.select("cell", "grp", "text").distinct()
    side = lambda mark: groups.withColumnsRenamed({c: mark + c for c in groups.columns})
    wanted = cells.join(side("p_"), "p_cell").join(side("c_"), "c_cell")
    if embeddings is None:
        embeddings = dense(ngram_embedding(groups.select("text", col("text").alias("body")).distinct(), "text", "body"), "text")
    vector = lambda mark: embeddings.select(col("text").alias(mark + "text"), col("embedding").alias(mark + "vector"))
    texts = (wanted.select("p_text", "c_text").distinct().join(vector("p_"), "p_text").join(vector("c_"), "c_text")
             .select("p_text", "c_text", cosine_similarity(col("p_vector"), col("c_vector")).alias("semantic")))
    return (wanted.join(texts, ["p_text", "c_text"])
            .filter(reaches(col("top_confidence") * (w["semantic"] * col("semantic") + col("top_rest")), min_score))
            .select("p_grp", "c_grp", "semantic", "compat", "history"))


#: Node columns that a score is made of, beside those of the groups.
SCORED = ("protocol", "rate", "confidence", "listed")


def with_score(pairs: DataFrame, w: dict[str, float], min_score: float) -> DataFrame:
    """``latency``, ``risk`` and ``composite`` from the components of the groups and the ``SCORED`` columns of both ends; rows that reach ``min_score``."""
    col = F.col
    risk = quick_risk(col("p_listed"), col("c_listed"), col("p_protocol"), col("c_protocol"), col("p_confidence"), col("c_confidence"))
    scored = pairs.withColumns({"latency": latency_score(col("p_rate"), col("c_rate")), "risk": 1.0 - risk}).withColumn(
        "composite", F.least(F.lit(1.0), F.least("p_confidence", "c_confidence") * (
            w["semantic"] * col("semantic") + w["protocol"] * col("compat") + w["latency"] * col("latency")
            + w["risk"] * col("risk") + w["history"] * col("history"))))
    return scored.filter(reaches(col("composite"), min_score))


def expand_pairs(strong: DataFrame, passed: DataFrame, taken: DataFrame, w: dict[str, float], min_score: float,
                 carry: tuple[str, ...] = (), marks: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The open node pairs of the group pairs ``passed`` that reach ``min_score``; no pair is shuffled.

    A producer is scored with bundles of consumers that are alike, which are then unfolded.
    ``carry`` names columns of ``strong`` that come along for both ends, as ``p_`` and ``c_``.
    ``marks`` (producer_id, consumer_id, mark) gives its pairs their ``mark``, the others null.
    """
    col = F.col
    end = lambda roles, mark, key: strong.filter(col("role").isin(roles)).select(
        col("grp").alias(mark + "grp"), col("node_id").alias(key), *[col(n).alias(mark + n) for n in dict.fromkeys(SCORED + carry)])
    p = end(["producer", "both"], "p_", "producer_id")
    dealt = _dealt(strong, carry)
    places = dealt.select(col("node_id").alias("consumer_id"), col("grp").alias("c_grp"), "lot")
    # a row per producer and group of consumers, with the consumers that are taken there, so that no pair is shuffled
    parts = int(strong.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offers = passed.join(p.repartition(parts, "producer_id"), "p_grp")

    def by_lot(pairs: DataFrame, made: Column, name: str) -> DataFrame:
        """What ``made`` collects from the pairs of a producer and a group, as a map from the lots of the consumers, and its size."""
        met = pairs.join(places, "consumer_id").join(p.select("producer_id").distinct(), "producer_id", "left_semi")
        lists = met.repartition(parts, "producer_id", "c_grp").groupBy("producer_id", "c_grp", "lot").agg(made.alias("of"))
        return durable(lists.groupBy("producer_id", "c_grp").agg(
            F.map_from_entries(F.collect_list(F.struct("lot", "of"))).alias(name), F.sum(F.size("of")).alias("n_" + name)))

    lists = {"gone": by_lot(taken.select("producer_id", "consumer_id"), F.collect_set("consumer_id"), "gone")}
    if marks is not None:
        lists["marked"] = by_lot(marks, F.map_from_entries(F.collect_list(F.struct("consumer_id", "mark"))), "marked")
    # what is too long for one row is met by a join
    too_long = lambda name: F.coalesce(col("n_" + name), F.lit(0)) > MOST_LISTED
    many, long_lists = F.lit(False), False
    for name, made in lists.items():
        offers = offers.join(made, ["producer_id", "c_grp"], "left")
        many, long_lists = many | too_long(name), long_lists or not made.filter(too_long(name)).isEmpty()
    offers = offers.withColumns({"many": many, "slice": F.pmod(F.xxhash64("producer_id"), F.lit(SLICES))}).withColumns(
        {name: F.when(~col("many"), col(name)) for name in lists})
    # the consumers of a group meet its producers in several tasks; few bytes and much work: not joined into fewer
    sliced = _bundles(dealt, carry).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    scored = with_score(offers.repartition(parts, "c_grp", "slice").join(sliced, ["c_grp", "slice"]), w, min_score)
    if digits is not None:
        scored = scored.withColumns({n: F.round(n, digits) for n in ("semantic", "latency", "risk", "history", "composite")})
    # of the lists, those of the bundle at hand
    scored = scored.withColumns({name: F.try_element_at(name, col("lot")) for name in lists})
    out = scored.withColumn("consumer_id", F.explode("consumers")).filter(
        (col("producer_id") != col("consumer_id")) & ~F.coalesce(F.array_contains("gone", col("consumer_id")), F.lit(False)))
    names = ["producer_id", "consumer_id", "semantic", "compat", "latency", "risk", "history", "composite"]
    names += [m + n for m in ("p_", "c_") for n in carry]
    short, last = list(names), list(names)
    if marks is not None:
        short.append(F.try_element_at("marked", col("consumer_id")).alias("mark"))
        last.append("mark")
    if not long_lists:
        return out.select(*short)
    keys = ["producer_id", "consumer_id"]
    rest = out.filter("many").join(taken.select(*keys), keys, "left_anti")
    if marks is not None:
        rest = rest.join(marks.select(*keys, "mark"), keys, "left")
    return out.filter("NOT many").select(*short).unionByName(rest.select(*last))


def _dealt(strong: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Consumers dealt to bundles of about ``BUNDLE`` that score alike and carry the same; ``lot`` is a number made from the bundle."""
    alike = node_classes(strong.filter(F.col("role").isin(["consumer", "both"])), tuple(n for n in carry if n not in SCORED))
    sizes = alike.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / BUNDLE).alias("bundles"))
    # dealt by a hash, so that no class is numbered in one task
    dealt = alike.join(sizes, "cls").withColumn("bundle", F.pmod(F.xxhash64("node_id"), F.col("bundles")))
    return dealt.withColumn("lot", F.xxhash64("cls", "bundle"))


def _bundles(dealt: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """A row per bundle: ``consumers``, lot, c_grp and the ``c_`` columns."""
    return dealt.groupBy("cls", "bundle", "lot").agg(
        F.collect_list("node_id").alias("consumers"), F.first("grp").alias("c_grp"),
        *[F.first(n).alias("c_" + n) for n in dict.fromkeys(SCORED + carry)]).drop("cls", "bundle")


# ---- the first pairs of each node, without listing the others --------------------------------

def node_classes(strong: DataFrame, facts: tuple[str, ...]) -> DataFrame:
    """``strong`` with ``cls``, the same for nodes of one group that score and, by ``facts``, are judged alike."""
    return strong.withColumn("cls", _key("grp", "rate", "confidence", *facts))


def class_pairs(classed: DataFrame, passed: DataFrame, w: dict[str, float], min_score: float, facts: tuple[str, ...]) -> DataFrame:
    """Pairs of node classes that reach ``min_score``: classes, numbers of nodes, ``rank`` (low is best) and the ``facts`` of both sides."""
    def side(roles: list[str], mark: str) -> DataFrame:
        columns = dict.fromkeys(SCORED + facts)
        out = classed.filter(F.col("role").isin(roles)).groupBy("cls", "grp").agg(
            F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in columns])
        return out.withColumnsRenamed({c: mark + c for c in out.columns})

    scored = with_score(passed.join(side(["producer", "both"], "p_"), "p_grp").join(side(["consumer", "both"], "c_"), "c_grp"), w, min_score)
    return scored.withColumn("rank", -F.round("composite", 9))


def first_pairs(classed: DataFrame, met: DataFrame, own: str, most: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first pairs of each class, best first and then by the other node, for the ``own`` side ('p' or 'c').

    ``met`` are rows of ``class_pairs``, ``most`` (cls, k) how many pairs a class wants. Returns the
    pairs (producer_id, consumer_id, rank) of all its nodes, those of a node with itself left out,
    and for each class that has more than these, its last one here: cls, rank and ``node``.
    """
    col = F.col
    other = "c" if own == "p" else "p"
    key = {"p": "producer_id", "c": "consumer_id"}
    roles = {"p": ["producer", "both"], "c": ["consumer", "both"]}
    over = W.partitionBy("cls")
    wanted = met.select(col(own + "_cls").alias("cls"), col(other + "_cls").alias("o_cls"), "rank", col(other + "_n").alias("n")).join(most, "cls")
    upto = F.sum("n").over(over.orderBy("rank").rangeBetween(W.unboundedPreceding, W.currentRow))
    wanted = wanted.withColumns({"here": F.sum("n").over(W.partitionBy("cls", "rank")), "upto": upto, "all": F.sum("n").over(over)})
    wanted = wanted.filter(col("upto") - col("here") < col("k"))
    # no class needs more of the other side than it wants in all
    deepest = most.agg(F.max("k")).first()[0] or 0
    others = classed.filter(col("role").isin(roles[other])).select(col("cls").alias("o_cls"), col("node_id").alias("node"))
    others = others.withColumn("r", F.row_number().over(W.partitionBy("o_cls").orderBy("node"))).filter(col("r") <= deepest)
    listed = wanted.join(others, "o_cls").filter(col("r") <= col("k"))
    listed = listed.withColumn("at", F.row_number().over(over.orderBy("rank", "node"))).filter(col("at") <= col("k"))
    listed = durable(listed.select("cls", "node", "rank", "at", "k", "all"))
    cut = listed.filter((col("at") == col("k")) & (col("all") > col("k"))).select("cls", "rank", "node")
    mine = classed.filter(col("role").isin(roles[own])).select("cls", col("node_id").alias("me"))
    pairs = listed.join(mine, "cls").filter(col("me") != col("node"))
    return pairs.select(col("me").alias(key[own]), col("node").alias(key[other]), "rank"), cut


# ---- queue -------------------------------------------------------------------------------

def queue_dedupe(candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """A queued pair is not queued again: the first candidate of each pair."""
    rest = [c for c in candidates.columns if c not in ("producer_id", "consumer_id")]
    first = F.min_by(F.struct(*rest), F.col(seq)).alias("first")
    return candidates.groupBy("producer_id", "consumer_id").agg(first).select("producer_id", "consumer_id", "first.*")


def queue_decay(queue: DataFrame, as_of: int, composite: str = "composite", created: str = "created",
                minute: int = 60_000_000) -> DataFrame:
    """Queue entries that survive their waiting time; ``as_of`` and ``created`` are microseconds."""
    waited = (F.lit(as_of) - F.col(created)) / float(minute)
    factor = F.pow(F.lit(fixed.DECAY_PER_MINUTE), waited)
    decayed = F.col(composite) * factor
    return (queue.withColumn("original", F.col(composite)).withColumn("factor", factor).withColumn("decayed", decayed)
            .filter(F.col("decayed") >= fixed.MIN_DECAYED)
            .withColumn(composite, F.when(F.col("factor") < 0.999, F.col("decayed")).otherwise(F.col(composite))).drop("factor"))


def queue_pop(queue: DataFrame, as_of: int, k: int, seq: str = "seq", **options) -> DataFrame:
    """The next ``k`` candidates: best original score first, then first in."""
    return queue_decay(queue, as_of, **options).orderBy(F.desc("original"), F.asc(seq)).limit(k)


def queue_repush(queue: DataFrame, torn: DataFrame, as_of: int, score: float = 0.5) -> DataFrame:
    """Queue after teardowns: torn pairs come back with a fixed score unless a node is gone."""
    again = (torn.filter(F.col("reason") != "node-gone").select("producer_id", "consumer_id").distinct()
             .withColumns({"composite": F.lit(score), "created": F.lit(as_of)}))
    kept = queue.select("producer_id", "consumer_id", "composite", "created").join(again.select("producer_id", "consumer_id"), ["producer_id", "consumer_id"], "left_anti")
    return kept.unionByName(again)


def fanout_opportunities(queue: DataFrame) -> DataFrame:
    """Producers with two or more queued consumers."""
    distinct = queue.select("producer_id", "consumer_id").distinct()
    return distinct.groupBy("producer_id").agg(F.count(F.lit(1)).alias("consumers")).filter("consumers >= 2")


def manual_candidates(requests: DataFrame, nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Operator requests with score 1 or the reason of their refusal."""
    known = lambda key: nodes.select(F.col("node_id").alias(key), F.lit(True).alias("has_" + key)).distinct()
    on = active.select("producer_id", "consumer_id", F.lit(True).alias("is_active")).distinct()
    out = (requests.join(known("producer_id"), "producer_id", "left").join(known("consumer_id"), "consumer_id", "left")
           .join(on, ["producer_id", "consumer_id"], "left"))
    error = (F.when(F.col("has_producer_id").isNull(), "producer not found").when(F.col("has_consumer_id").isNull(), "consumer not found")
             .when(F.col("is_active").isNotNull(), "bridge already active"))
    return (out.withColumn("error", error).withColumn("composite", F.when(F.col("error").isNull(), 1.0))
            .drop("has_producer_id", "has_consumer_id", "is_active"))
