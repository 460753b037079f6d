"""Quality rules over counted line and word repeats, and n-gram perplexity in bands per language.

The language model is an interpolated modified Kneser-Ney model over the characters of words, one
per language, up to five characters. Spark counts the n-grams of every word of the corpus and works
out discounts, probabilities and back-off weights as DataFrames. Up to ``MOST_ROWS`` of them are kept
in arrays, sorted by keys that are the n-grams themselves; a larger model stays a DataFrame, and the
n-grams of the words are joined with it. Either way every n-gram has its own probability.

A text's perplexity is that of its words, ends included. Each language gets a lower and an upper
band from the quartiles of the logarithm over all its texts that pass the other rules.

Null and empty texts have no words: all counts are 0 and the rules reject them. A null language is
a language of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import durable
from .common import chunks, map_text, small

ORDER = 5
START, END = "\x02", "\x03"
#: Rows of the model, probabilities and weights, up to which it is sent to the tasks; below 100 MB in all.
MOST_ROWS = 8_000_000
#: Bits of a character in the key of an n-gram; a key holds up to three.
BITS = 21
#: Texts with fewer words, or with more of their words in repeated windows, fail the base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Width of the bands beyond the quartiles, in spreads between them, and the least spread in log10.
BELOW, ABOVE, LEAST_SPREAD = 6.0, 6.0, 0.01
NO_LANG = "und"
#: Distinct words and n-grams that a task holds before it passes them on.
HELD = 300_000
CACHED_WORDS = 800_000


def count_grams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``gram`` (five characters, padded at the front of a word) and ``c``, how often it occurs."""
    source = df.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("t"))

    def grams(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for name, counted in words.items():
            found: dict[str, int] = {}
            get = found.get
            for word, c in counted.items():
                s = START * (ORDER - 1) + word.decode() + END
                for i in range(len(s) - ORDER + 1):
                    g = s[i:i + ORDER]
                    found[g] = get(g, 0) + c
                if len(found) > HELD:
                    yield batch(name, found)
                    found.clear()
            yield batch(name, found)

    def batch(name: str, found: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for whole in batches:
            for piece in chunks(whole, "t"):
                for name, t in zip(piece.column("lang").to_pylist(), piece.column("t").to_pylist()):
                    words.setdefault(name, Counter()).update((t or "").encode().split())
                if sum(map(len, words.values())) > HELD:
                    yield from grams(words)
                    words = {}
        yield from grams(words)

    return source.mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def levels(counts: DataFrame) -> DataFrame:
    """``n``, ``lang``, ``gram``, ``c`` for every length: the longest as they occur, a shorter one by
    the number of different characters that come before it."""
    parts = [counts.select(F.lit(ORDER).alias("n"), "lang", "gram", "c")]
    for n in range(ORDER - 1, 0, -1):
        longer = counts.select("lang", F.substring("gram", ORDER - n, n + 1).alias("gram")).distinct()
        parts.append(longer.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))
                     .select(F.lit(n).alias("n"), "lang", "gram", "c"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def model_rows(level: DataFrame) -> DataFrame:
    """Rows of the model: ``n`` (length), ``kind`` ('p': discounted probability of an n-gram,
    'g': weight of the shorter order after a context of length n), ``lang``, ``gram`` and ``v``."""
    some = [F.sum(F.when(F.col("c") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    down = lambda k, a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.greatest(F.lit(0.1), k - (k + 1) * y * F.col(b) / F.col(a))).otherwise(0.1 + 0.4 * min(k, 2))
    discounts = level.groupBy("n", "lang").agg(*some).select(
        "n", "lang", down(1, "n1", "n2").alias("d1"), down(2, "n2", "n3").alias("d2"), down(3, "n3", "n4").alias("d3"))
    # five rows a language
    rows = level.join(F.broadcast(discounts), ["n", "lang"])
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("d", F.least(d, F.col("c").cast("double"))).withColumn("ctx", F.expr("substring(gram, 1, n - 1)"))
    over = W.partitionBy("n", "lang", "ctx")
    rows = rows.withColumn("all", F.sum("c").over(over)).withColumn("held", F.sum("d").over(over))
    both = F.array(
        F.struct(F.col("n"), F.lit("p").alias("kind"), F.col("gram"), ((F.col("c") - F.col("d")) / F.col("all")).alias("v")),
        F.struct((F.col("n") - 1).alias("n"), F.lit("g").alias("kind"), F.col("ctx").alias("gram"), (F.col("held") / F.col("all")).alias("v")))
    # a context has the same weight on all its rows
    return rows.select("lang", F.inline(both)).groupBy("n", "kind", "lang", "gram").agg(F.max("v").cast("float").alias("v"))


def _rank(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key among sorted keys, -1 for one that is not there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _longer(rank: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.where(rank < 0, -1, rank << BITS | code)


def _codes(grams: pa.Array, n: int) -> list[np.ndarray]:
    """Columns of the code points of n-grams."""
    grams = grams.cast(pa.large_string())
    ends = np.frombuffer(grams.buffers()[1], np.int64)[grams.offset:grams.offset + len(grams) + 1]
    text = grams.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().decode() if n and len(grams) else ""
    matrix = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(grams), n)
    return [matrix[:, i] for i in range(n)]


class Grams:
    """N-grams of one language. The key of up to three characters holds them all; that of a longer
    n-gram holds the place of its beginning among those that occur and its last character."""

    def __init__(self, tables: dict[tuple[int, str], tuple[pa.Array, np.ndarray]]) -> None:
        codes = {(n, kind): _codes(grams, n) for (n, kind), (grams, _) in tables.items()}
        self.begun = {3: np.empty(0, np.int64), 4: np.empty(0, np.int64)}
        for n in (3, 4):
            keys = [self.key(c[:n], len(c[0])) for (m, _), c in codes.items() if m > n]
            # a context of four characters begins with three
            self.begun[n] = np.unique(np.concatenate(keys)) if keys else self.begun[n]
        self.tables = {}
        for at, (_, values) in tables.items():
            keys = self.key(codes[at], len(values))
            order = np.argsort(keys)
            self.tables[at] = (keys[order], values[order])

    def key(self, codes: list[np.ndarray], size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for i, code in enumerate(codes):
            out = out << BITS | code if i < 3 else _longer(_rank(self.begun[i], out), code)
        return out

    def look_up(self, n: int, kind: str, codes: list[np.ndarray], size: int, missing: float) -> np.ndarray:
        if (n, kind) not in self.tables:
            return np.full(size, missing)
        keys, values = self.tables[n, kind]
        at = _rank(keys, self.key(codes, size))
        return np.where(at < 0, missing, values[at])


class Model:
    """Sorted arrays of each language, and the number of different characters."""

    def __init__(self, tables: dict[str, Grams]) -> None:
        self.tables = tables
        self.uniform = 1.0 / (sum(len(t.tables[1, "p"][0]) for t in tables.values() if (1, "p") in t.tables) + 1)

    def word_logs(self, words: list[str], lang: str) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 probabilities of the characters of each word, its end included, and their number."""
        pad = ORDER - 1
        joined = "".join(START * pad + w + END for w in words)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes + pad)
        real = np.ones(len(codes), bool)
        for i in range(pad):
            real[ends - sizes - pad + i] = False
        at = np.flatnonzero(real)
        # few different n-grams fill many words: each is looked up once
        used = np.zeros(0x110000, bool)
        used[codes] = True
        bits = max(1, int(used.sum() - 1).bit_length())
        every = None
        if bits * ORDER < 63:
            letters = (np.cumsum(used) - 1)[codes]
            _, first, every = np.unique(sum(letters[at - i] << bits * i for i in range(ORDER)), return_index=True, return_inverse=True)
            at = at[first]
        p, mine = np.full(len(at), self.uniform), self.tables.get(lang)
        for n in range(1, ORDER + 1) if mine else ():
            gram = [codes[at - n + 1 + i] for i in range(n)]
            weight = mine.look_up(n - 1, "g", gram[:-1], len(at), 1.0)
            p = mine.look_up(n, "p", gram, len(at), 0.0) + weight * p
        logs = np.log10(np.maximum(p, 1e-12))
        logs = logs if every is None else logs[every]
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes), sizes


class Joined:
    """A model of any size: its rows, and the probability of a character that no n-gram knows."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.uniform = 1.0 / (rows.filter("n = 1 AND kind = 'p'").count() + 1)

    def gram_logs(self, grams: DataFrame) -> DataFrame:
        """``log``, log10 of the probability of the last character, for ``lang`` and ``gram`` (five characters)."""
        out = grams.withColumn("p", F.lit(self.uniform))
        for n in range(1, ORDER + 1):
            for kind, length in (("g", n - 1), ("p", n)):
                known = self.rows.filter((F.col("n") == length) & (F.col("kind") == kind)).select("lang", F.col("gram").alias("__part"), F.col("v").cast("double").alias(kind + "_v"))
                out = out.withColumn("__part", F.substring("gram", ORDER - n + 1, length)).join(known, ["lang", "__part"], "left").drop("__part")
            out = out.withColumn("p", F.coalesce("p_v", F.lit(0.0)) + F.coalesce("g_v", F.lit(1.0)) * F.col("p")).drop("p_v", "g_v")
        return out.select("lang", "gram", F.log10(F.greatest("p", F.lit(1e-12))).alias("log"))

    def text_logs(self, df: DataFrame) -> DataFrame:
        """``total``, the sum over all words, for ``__id`` from ``__id``, ``__lang`` and ``__text``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for piece in chunks(whole, "__text"):
                    ids, langs, words, counts = [], [], [], []
                    for i, name, t in zip(*[piece.column(c).to_pylist() for c in ("__id", "__lang", "__text")]):
                        counted = Counter((t or "").encode().split())
                        ids += [i] * len(counted)
                        langs += [name] * len(counted)
                        words += [w.decode() for w in counted]
                        counts += counted.values()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())],
                                                     names=["__id", "lang", "word", "c"])

        used = df.select("__id", "__lang", "__text").mapInArrow(run, "__id long, lang string, word string, c long").persist(StorageLevel.DISK_ONLY)
        padded = F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END))
        grams = used.select("lang", "word").distinct().select(
            "lang", "word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))
        logs = self.gram_logs(grams.select("lang", "gram").distinct())
        words = grams.join(logs, ["lang", "gram"]).groupBy("lang", "word").agg(F.sum("log").alias("log"))
        return used.join(words, ["lang", "word"]).groupBy("__id").agg(F.sum(F.col("c") * F.col("log")).alias("total"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model | Joined:
    """The model of all texts, in arrays or, beyond ``MOST_ROWS``, as a DataFrame."""
    counts = count_grams(df, text, lang).persist(StorageLevel.DISK_ONLY)
    level = levels(counts).persist(StorageLevel.DISK_ONLY)
    rows = model_rows(level).persist(StorageLevel.DISK_ONLY)
    if rows.count() > MOST_ROWS:
        made = Joined(durable(rows))
    else:
        got = rows.toArrow().combine_chunks()
        made = Model({name: Grams(_tables(got.filter(pc.equal(got.column("lang"), name)))) for name in pc.unique(got.column("lang")).to_pylist()})
    for x in (rows, level, counts):
        x.unpersist()
    return made


def _tables(got: pa.Table) -> dict[tuple[int, str], tuple[pa.Array, np.ndarray]]:
    out = {}
    for n in range(ORDER + 1):
        for kind in ("p", "g"):
            mine = got.filter(pc.and_(pc.equal(got.column("n"), n), pc.equal(got.column("kind"), kind))).combine_chunks()
            if mine.num_rows:
                out[n, kind] = (pa.concat_arrays(mine.column("gram").chunks), mine.column("v").to_numpy().astype(np.float32))
    return out


def repeated_words(codes: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text in windows that occur twice or more in it.

    Windows whose hash occurs once are left out; the others are compared word by word, so the count is exact.
    """
    out = np.zeros(len(lengths), np.int64)
    n = len(codes) - window + 1
    if n < 1:
        return out
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(owner[:n] == owner[window - 1:])
    if not len(starts):
        return out
    rolled = owner[:n].astype(np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + n].astype(np.uint64)
        rolled ^= rolled >> np.uint64(29)
    rolled = rolled[starts]
    ordered = np.sort(rolled)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, rolled), len(twice) - 1)
    starts = starts[twice[at] == rolled]
    rank, top = owner[starts], int(codes.max()) + 1
    for j in range(window):
        _, rank = np.unique(rank * top + codes[starts + j], return_inverse=True)
    hit = starts[np.bincount(rank)[rank] >= 2]
    size = len(codes) + 1
    marks = np.bincount(hit, minlength=size) - np.bincount(hit + window, minlength=size)
    return np.bincount(owner[np.cumsum(marks[:-1]) > 0], minlength=len(lengths)).astype(np.int64)


_SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return n


MEASURED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                        + [T.StructField("log_ppl", T.DoubleType())])


#: Words by language that a worker has met in this run: those seen last, and those seen before them.
_LEARNED: dict[str, list[dict[str, dict[bytes, float]]]] = {}


def learned(run: str) -> list[dict[str, dict[bytes, float]]]:
    """Kept from task to task of one run; at most ``CACHED_WORDS`` and those of one piece."""
    if run not in _LEARNED:
        _LEARNED.clear()
        _LEARNED[run] = [{}, {}]
    return _LEARNED[run]


def measure(df: DataFrame, model: Model | Joined | None, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Counts of each whole text, and ``log_ppl``, log10 of its perplexity (null without words or model)."""
    if isinstance(model, Joined):
        # written once, so that a row keeps its number
        rows = durable(df.withColumn("__id", F.monotonically_increasing_id()))
        counted = measure(rows, None, text, lang, ["__id", *(keep if keep is not None else [c for c in df.columns if c != text])])
        logs = model.text_logs(rows.select("__id", F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("__lang"), F.col(f"`{text}`").alias("__text")))
        return counted.join(logs, "__id", "left").withColumn("log_ppl", -F.col("total") / (F.col("word_chars") + F.col("n_words"))).drop("__id", "total")
    shared, run = df.sparkSession.sparkContext.broadcast(model), uuid4().hex
    source = df.withColumn("__lang", F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)))
    carried = keep if keep is not None else [c for c in df.columns if c != text]

    def make():
        model, known = shared.value, learned(run)

        def learn(name: str, new: set[bytes]) -> None:
            mine, before = known[0].setdefault(name, {}), known[1].get(name, {})
            fresh = new - mine.keys()
            again = fresh & before.keys()
            mine.update((w, before[w]) for w in again)
            fresh = list(fresh - again)
            if fresh:
                found, _ = model.word_logs([w.decode() for w in fresh], name)
                mine.update(zip(fresh, found.tolist()))

        def work(texts: list[str], langs: pa.Array) -> list:
            if sum(map(len, known[0].values())) > CACHED_WORDS // 2:
                known[:] = [{}, known[0]]
            names = langs.to_pylist()
            words = [t.encode().split() for t in texts]
            lengths = np.array([len(w) for w in words], np.int64)
            if model is not None:  # learn all new words of a language at once
                fresh: dict[str, set[bytes]] = {}
                for name, w in zip(names, words):
                    fresh.setdefault(name, set()).update(w)
                for name, new in fresh.items():
                    learn(name, new)
            numbers: dict[bytes, int] = {}
            codes = np.array([numbers.setdefault(x, len(numbers)) for w in words for x in w], np.int64)
            chars = np.array([len(t) - sum(map(t.count, _BLANK)) for t in texts], np.int64)
            ppl = [None if model is None or not w else -sum(map(known[0][name].__getitem__, w)) / (int(c) + len(w)) for name, w, c in zip(names, words, chars)]
            return [pa.array(lengths), pa.array(chars), [sum(map(t.count, _SYMBOLS)) for t in texts], [_dup_lines(t) for t in texts],
                    pa.array(repeated_words(codes, lengths)), pa.array(ppl, pa.float64())]

        return work

    return map_text(source, text, make, MEASURED, carried, ["__lang"])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """``low`` and ``high`` of log_ppl for each language, from the texts that pass the base rules."""
    fine = measured.filter(~base_failed() & F.col("log_ppl").isNotNull())
    q = fine.groupBy(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("__lang")).agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000).alias("q"))
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(LEAST_SPREAD))
    return q.select("__lang", (F.col("q")[0] - BELOW * spread).alias("low"), (F.col("q")[2] + ABOVE * spread).alias("high"))


def judge(measured: DataFrame, banded: DataFrame, lang: str = "lang") -> DataFrame:
    """``base_failed`` and ``kept``: the base rules passed and the perplexity inside the language's bands.

    There is one row of bands per language; they are broadcast if they are few, so that a language
    with most of the texts is not gathered.
    """
    joined = measured.withColumn("__lang", F.coalesce(F.col(lang), F.lit(NO_LANG))).join(small(durable(banded)), "__lang", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("__lang")
