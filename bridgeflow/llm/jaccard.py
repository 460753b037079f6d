"""N-gram Jaccard join: MinHash values compared step by step, hopeless pairs dropped early, the rest verified exactly.

Texts are sets of five-word shingles (a text of fewer words is one shingle). Equal texts are
collapsed first, so a group of exact copies is one text with a count. Then

1. every text gets 160 MinHash values; texts that agree in all five values of one of 32 bands share
   a bucket (a pair of similarity 0.8 misses all bands with probability 3e-6);
2. inside buckets pairs are compared 32 values at a time, and a pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold is below the
   tolerance; what is left ties texts into candidate groups;
3. inside candidate groups every pair passes the same comparison and then the exact count of
   shared shingles; verified links are counted per text and tie the final classes.

Buckets and groups of any size are cut into blocks of a few hundred texts; one unit of work is a
pair of blocks, which returns counts and a spanning forest, never the pairs. So no task holds a
group, and no table grows with the square of one. The work does, in vector operations, for groups
of near copies with different texts, as every link is counted.

Texts without a word (null, empty, blank) belong to a class of their own each and have no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import durable
from .common import hash64, list_array, map_text, small

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
BLOCK = 256
#: A block's incidence matrix may have so many cells; larger ones are verified pair by pair.
CELLS = 16_000_000

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 1 << 63, max(SHINGLE, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Matches among the first STEP, 2 STEP, ... values from which on a pair stays.

    After m matches in n values a uniform prior gives P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


LEAST = least_matches()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one after another, and their number in each text."""
    words = [t.encode().split() for t in texts]
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for ws in words for w in ws], np.int64)
    hashed = _mix(hash64(list(numbers))) if numbers else np.zeros(0, np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    per_word = hashed[codes] if len(codes) else hashed
    counts = np.where(lengths == 0, 0, np.maximum(lengths - SHINGLE + 1, 1))
    starts = np.cumsum(lengths) - lengths
    first = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.repeat(starts + lengths, counts)
    value = np.zeros(len(first), np.uint64)
    for j in range(SHINGLE):
        at = first + j
        inside = at < ends
        value[inside] += per_word[at[inside]] * _PLACES[j]
        value[~inside] += np.uint64(j + 1)
    return _mix(value), counts


def sketches(texts: list[str]) -> tuple[list, list]:
    """Band keys and the low 16 bits of the MinHash values of each text; both None without words."""
    values, counts = shingles(texts)
    full = np.flatnonzero(counts)
    if not len(full):
        return [None] * len(texts), [None] * len(texts)
    starts = (np.cumsum(counts) - counts)[full]
    lows = np.empty((len(full), HASHES), np.uint64)
    for k in range(HASHES):
        lows[:, k] = np.minimum.reduceat((values * _MULTIPLIERS[k]) >> np.uint64(20), starts)
    keys = np.zeros((len(full), BANDS), np.uint64)
    for r in range(ROWS):
        keys += _mix(lows[:, r::ROWS] + np.uint64(r)) * _PLACES[r]
    keys = _mix(keys + _BAND).view(np.int64)
    short = lows.astype(np.uint16)
    bands, signatures = [None] * len(texts), [None] * len(texts)
    for i, k, s in zip(full, keys, short):
        bands[i], signatures[i] = k, s.tobytes()
    return bands, signatures


SKETCH = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def survivors(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (within ``a``, or of ``a`` and ``b``) that no step drops."""
    same = b is None
    b = a if same else b
    matches = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        matches += a[:, k, None] == b[None, :, k]
    alive = matches >= LEAST[0]
    x, y = np.nonzero(np.triu(alive, 1) if same else alive)
    m = matches[x, y].astype(np.int64)
    for step, least in enumerate(LEAST[1:], 1):
        if not len(x):
            break
        part = slice(step * STEP, (step + 1) * STEP)
        for at in range(0, len(x), 65536):
            some = slice(at, at + 65536)
            m[some] += (a[x[some], part] == b[y[some], part]).sum(axis=1)
        stay = m >= least
        x, y, m = x[stay], y[stay], m[stay]
    return x, y


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes under the edges (x, y)."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def verified(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (x, y) of sorted sets have an exact Jaccard similarity of the threshold or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    used = np.unique(np.concatenate([x, y]))
    if len(x) > 64:
        vocabulary, place = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
        if len(vocabulary) * len(used) <= CELLS:
            row = np.full(len(sets), -1)
            row[used] = np.arange(len(used))
            cells = np.zeros((len(used), len(vocabulary)), np.float32)
            cells[np.repeat(np.arange(len(used)), sizes[used]), place] = 1
            shared = np.rint((cells @ cells.T)[row[x], row[y]]).astype(np.int64)
            return shared >= threshold * (sizes[x] + sizes[y] - shared) - 1e-9
    shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
    return shared >= threshold * (sizes[x] + sizes[y] - shared) - 1e-9


def _by_group(key: list[str], work: Callable[[pa.Table], list | None], names: list[str], schema: pa.Schema):
    """A mapInArrow function that hands each run of equal keys, whole, to ``work``; rows must come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        columns: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=names)
            for c in columns:
                c.clear()
            return out

        def done(group: pa.Table) -> None:
            for c, made in zip(columns, work(group) or []):
                c.extend(made)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if last is not None and (keys[0] != last).any():
                done(pa.concat_tables(held))
                held = []
            edges = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                held.append(whole.slice(a, b - a))
                if b < len(keys):
                    done(pa.concat_tables(held))
                    held = []
                if len(columns[0]) > 50_000:
                    yield flush()
            last = keys[-1]
        if held:
            done(pa.concat_tables(held))
        yield flush()

    return run


def _block_pairs(members: DataFrame, group: str, size: str) -> DataFrame:
    """Each member once for every pair of blocks that its block is in; blocks are dealt by hash.

    A group of at most BLOCK members is one block, paired with itself.
    """
    count = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.when(F.col(size) <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("n"), count).cast("int"))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", size)
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "n")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    n = group.column("n").to_numpy()
    own, i, j = (group.column(c).to_numpy() for c in ("own", "i", "j"))
    return n, np.flatnonzero(own == i), np.flatnonzero(own == j), None if i[0] == j[0] else own


def _surviving(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, left, right, apart = _sides(group)
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(n), HASHES)
    if apart is None:
        x, y = survivors(sig)
        return n, x, y
    if not len(left) or not len(right):
        return n, left[:0], right[:0]
    x, y = survivors(sig[left], sig[right])
    return n, left[x], right[y]


def _tie(group: pa.Table) -> list | None:
    if group.num_rows < 2:
        return None
    n, x, y = _surviving(group)
    root = roots(len(n), x, y)
    tied = np.flatnonzero(root != np.arange(len(n)))
    return [n[tied].tolist(), n[root[tied]].tolist()]


def _link(group: pa.Table) -> list | None:
    if group.num_rows < 2:
        return None
    # repeated rows of one text stand side by side
    n = group.column("n").to_numpy()
    group = group.take(np.concatenate([[0], np.flatnonzero(n[1:] != n[:-1]) + 1]))
    n, x, y = _surviving(group)
    if not len(x):
        return None
    values, counts = shingles(group.column("text").to_pylist())
    ends = np.cumsum(counts)
    sets = [np.unique(values[e - c:e]) for e, c in zip(ends, counts)]
    real = verified(sets, x, y)
    x, y = x[real], y[real]
    copies = group.column("copies").to_numpy()
    links = np.zeros(len(n), np.int64)
    np.add.at(links, x, copies[y])
    np.add.at(links, y, copies[x])
    root = roots(len(n), x, y)
    linked = np.flatnonzero(links)
    return [n[linked].tolist(), links[linked].tolist(), n[root[linked]].tolist()]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the edges (u, v).

    Alternating large and small stars: edges move towards smaller nodes until only stars are left.
    Every round is checkpointed in the shared folder; the driver sees a count and a sum.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now, seen = durable(edges.filter("u <> v").distinct()), None
    while True:
        wide = both(now)
        low = wide.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = wide.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        now = durable(small.filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its ``id`` (MD5), ``copies``, ``rep`` (least key of its rows), ``links`` to rows
    of other texts, ``class`` (least MD5 in its class, so that keys decide nothing) and ``class_id``
    (least key in its class; null if all keys are null)."""
    plain = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keyed = plain.withColumn("id", F.unhex(F.md5("text")))

    def make():
        def work(texts: list[str]) -> list:
            bands, sigs = sketches(texts)
            flat = [b for b in bands if b is not None]
            lists = list_array(np.concatenate(flat) if flat else np.zeros(0, np.int64), [0 if b is None else BANDS for b in bands], pa.int64())
            return [lists, pa.array(sigs, pa.binary())]

        return work

    texts = map_text(keyed, "text", make, SKETCH).groupBy("id").agg(
        F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # fixed by the checkpoint, so its numbers are the same in every use
    sketch = durable(texts).withColumn("n", F.monotonically_increasing_id())

    banded = sketch.select("n", F.explode("bands").alias("b"))
    shared = banded.groupBy("b").agg(F.count("*").alias("c"), F.sum(F.xxhash64("n").cast("decimal(38,0)")).alias("who")).filter("c > 1")
    # buckets with the same members count once
    buckets = shared.groupBy("c", "who").agg(F.min("b").alias("b")).select("b", "c")
    members = banded.join(buckets, "b").join(sketch.select("n", "sig"), "n")
    pairs = _block_pairs(members, "b", "c").mapInArrow(
        _by_group(["b", "i", "j"], _tie, ["u", "v"], pa.schema([("u", pa.int64()), ("v", pa.int64())])), "u long, v long")
    candidates = components(pairs)

    sizes = candidates.groupBy("root").agg(F.count("*").alias("c"))
    wanted = candidates.join(sizes, "root").join(sketch.select("n", "id", "rep", "copies", "sig"), F.col("node") == F.col("n"))
    wanted = durable(wanted.select("root", "c", "n", "id", "rep", "copies", "sig"))
    # the keys alone find the texts, what else is known of them follows
    found = keyed.join(small(wanted.select("id", "rep", "n")), "id").filter(F.col("key").eqNullSafe(F.col("rep"))).select("n", "text")
    chosen = found.join(wanted.drop("id", "rep"), "n")
    out = pa.schema([("n", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    blocks = _block_pairs(chosen.select("root", "c", "n", "copies", "sig", "text"), "root", "c")
    linked = durable(blocks.mapInArrow(_by_group(["root", "i", "j"], _link, ["n", "links", "root"], out), "n long, links long, root long"))

    links = linked.groupBy("n").agg(F.sum("links").alias("links"))
    ties = components(linked.select(F.col("n").alias("u"), F.col("root").alias("v")))
    tied = sketch.select("n", "id", "rep", "copies", F.col("sig").isNotNull().alias("worded")).join(links, "n", "left").join(ties.withColumnRenamed("node", "n"), "n", "left")
    tied = tied.withColumn("root", F.coalesce("root", "n"))
    least = tied.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("id").alias("class"))
    return tied.join(least, "root").select("id", "rep", "copies", "worded", F.coalesce("links", F.lit(0)).alias("links"), "class", "class_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``class_id``, ``n_links``, the number of other rows whose
    text has a similarity of the threshold or more, exact copies included, and ``class_md5``.

    ``class_id`` is the least key of the class. Where keys repeat on different texts or are null,
    only ``class_md5``, the least MD5 of the class's texts, tells classes apart; it is null for
    texts without a word, which are in no class.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("id"))
    found = rows.join(join(df, key, text), "id")
    return found.select(
        F.col("key").alias(key), F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("key")).alias("class_id"),
        F.when(F.col("worded"), F.col("links") + F.col("copies") - 1).otherwise(0).alias("n_links"),
        F.when(F.col("worded"), F.lower(F.hex("class"))).alias("class_md5"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class: that with the least key (equal keys: the least MD5; equal rows: any one).

    Rows without a word all stay. A null key comes last.
    """
    found = join(df, key, text).filter("worded")
    place = F.struct(F.col("rep").isNull().alias("none"), "rep", "id")
    classes = found.withColumn("place", place)
    least = classes.groupBy("class").agg(F.min("place").alias("least"))
    judged = durable(classes.join(least, "class").select("id", "rep", "copies", F.col("place").eqNullSafe(F.col("least")).alias("stays")))
    id_ = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    marked = df.withColumn("__id", id_)
    # texts that do not stay lose all rows, texts that stay with copies keep one of them
    gone = judged.filter(~F.col("stays")).select(F.col("id").alias("__gone"))
    copied = judged.filter(F.col("stays") & (F.col("copies") > 1)).select(F.col("id").alias("__several"), F.col("rep").alias("__rep"))
    left = marked.join(small(gone), F.col("__id") == F.col("__gone"), "left_anti").join(small(copied), F.col("__id") == F.col("__several"), "left")
    single = left.filter(F.col("__several").isNull())
    several = left.filter(F.col("__several").isNotNull() & F.col(f"`{key}`").eqNullSafe(F.col("__rep"))).dropDuplicates(["__id"])
    return single.unionByName(several).select(*[F.col(f"`{c}`") for c in df.columns])
