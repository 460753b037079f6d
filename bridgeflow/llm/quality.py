"""A supervised quality classifier over learned subword embeddings.

A text is the average of learned vectors: one per hashed word, per hashed n-gram of four bytes of a
word, per hashed pair of neighbouring word shapes, and one for a word that repeats the one before.
A softmax over a linear layer gives the probability of the good label; vectors and layer are
learned together by stochastic gradient descent in numpy.

As the output is linear in the averaged vector, scoring needs one number per hash bucket, so what
the executors get has a fixed size. Texts are read whole: a long piece without blanks, as in
scripts that write none, counts as a row of words, cut so that every n-gram of the piece is in
exactly one of them. An empty or null text has the average of
no vectors, the zero vector, and so the score that the learned bias gives.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import map_text

#: Labelled rows that the classifier is fitted on at most, taken by the hash of their key.
SAMPLE_ROWS = 3000
BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 17, 10, 8, 0.6
SHAPES = 256
#: Zero vectors in every average, so that a few words alone cannot condemn a short text.
NEUTRAL = 30
#: Bytes of a word at most; a longer piece is cut into chunks of so many, overlapping by three.
LONGEST = 64
#: Words remembered by a Python worker at most.
CACHED_WORDS = 400_000

_FOLD = re.compile(rb"(.)\1+")
_SHAPE = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256)
)


def chunks(word: bytes) -> list[bytes]:
    """The word itself, or the marked chunks of a long one, each behind a blank, which no word has."""
    if len(word) <= LONGEST:
        return [word]
    marked = b"<" + word + b">"
    return [b" " + marked[i:i + LONGEST] for i in range(0, len(marked) - 3, LONGEST - 3)]


def word_features(word: bytes) -> list[int]:
    """Buckets of a word or chunk and of its n-grams of four bytes."""
    crc = zlib.crc32
    marked = word[1:] if word[:1] == b" " else b"<" + word + b">"
    return [crc(word, 1) % BUCKETS] + [crc(marked[i:i + 4]) % BUCKETS for i in range(len(marked) - 3)]


def shape_of(word: bytes) -> int:
    """One of a few hashed shapes: letters by case, digits, and the symbols themselves, runs folded."""
    return zlib.crc32(_FOLD.sub(rb"\1", word.lstrip(b" ").translate(_SHAPE)), 7) % SHAPES


#: Buckets of pairs of neighbouring shapes, and of repeated words.
PAIRS = np.array([zlib.crc32(bytes([a, b]), 11) % BUCKETS for a in range(SHAPES) for b in range(SHAPES)], np.int64)
REPEAT = zlib.crc32(b"repeat", 13) % BUCKETS


class Features:
    """Distinct words of a worker, numbered, with their features."""

    def __init__(self, value: np.ndarray | None = None) -> None:
        self.value = value
        self.values = None if value is None else value.tolist()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.buckets: list[list[int]] = []
        self.shapes, self.counts, self.sums = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024)

    def number(self, word: bytes) -> int:
        i = self.known[word] = len(self.known)
        if i == len(self.shapes):
            self.shapes, self.counts, self.sums = (np.concatenate([x, np.zeros_like(x)]) for x in (self.shapes, self.counts, self.sums))
        found = word_features(word)
        self.shapes[i], self.counts[i] = shape_of(word), len(found)
        if self.values is None:
            self.buckets.append(found)
        else:
            self.sums[i] = sum(map(self.values.__getitem__, found))
        return i

    def numbers(self, text: str) -> np.ndarray:
        get, number = self.known.get, self.number
        words = text.encode().split()
        if words and max(map(len, words)) > LONGEST:
            words = [c for w in words for c in chunks(w)]
        return np.array([x if (x := get(w)) is not None else number(w) for w in words], np.int64)

    def document(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text and their shares of its features."""
        at = self.numbers(text)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        shapes = self.shapes[at]
        words, times = np.unique(at, return_counts=True)
        lists = [self.buckets[w] for w in words] + [PAIRS[shapes[:-1] * SHAPES + shapes[1:]], np.full(int((at[1:] == at[:-1]).sum()), REPEAT)]
        weights = np.concatenate([np.repeat(times, [len(x) for x in lists[:-2]]), np.ones(len(lists[-2]) + len(lists[-1]), np.int64)])
        buckets, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        share = np.bincount(inverse, weights)
        return buckets, (share / (share.sum() + NEUTRAL)).astype(np.float32)

    def scores(self, texts: list[str], bias: float) -> np.ndarray:
        """Log odds of the good label."""
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            if len(self.known) > CACHED_WORDS:
                self.clear()
            at = self.numbers(text)
            if not len(at):
                out[k] = bias
                continue
            s = self.shapes[at]
            repeats = int((at[1:] == at[:-1]).sum())
            total = self.sums[at].sum() + self.value[PAIRS[s[:-1] * SHAPES + s[1:]]].sum() + repeats * float(self.value[REPEAT])
            out[k] = total / (self.counts[at].sum() + len(at) - 1 + repeats + NEUTRAL) + bias
        return out


@dataclass
class Model:
    """One number per bucket (its vector times the difference of the two outputs) and the bias."""

    value: np.ndarray
    bias: float


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Vectors and softmax layer by stochastic gradient descent, one example at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    if not examples:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    total, step = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            buckets, share, label = examples[k]
            lr = rate * (1 - step / total)
            step += 1
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * 0.5 * p
            if len(buckets):
                vectors[buckets] -= lr * share[:, None] * len(buckets) ** 0.5 * back[None, :]
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


_EXAMPLE = T.StructType([T.StructField("buckets", T.BinaryType()), T.StructField("shares", T.BinaryType())])


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows of ``labelled`` (label 0 or 1); null labels are left out.

    ``sample_rows`` bounds what reaches the driver; the rows with the lowest hash of their key are
    taken, so a retry or another machine takes the same ones.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"), F.col(text).alias("__t"))

    def make():
        features = Features()

        def work(texts: list[str]) -> list:
            made = [features.document(t) for t in texts]
            features.clear()
            return [pa.array([b.astype(np.int32).tobytes() for b, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())]

        return work

    order = [F.xxhash64("__key"), "__key", "__label", F.xxhash64("buckets")]
    got = map_text(rows, "__t", make, _EXAMPLE).orderBy(*order).limit(sample_rows).collect()
    return train([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["__label"]) for r in got])


def sampled_keys(labels: DataFrame, label: str, key: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The labelled keys that ``fit`` will take, so that only their texts need reading: one row per key, label its largest."""
    some = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias(label))
    return some.orderBy(F.xxhash64(key), key).limit(sample_rows)


SCORED = T.StructType([T.StructField("score", T.DoubleType())])


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``score``: probability of the good label for each whole text."""
    shared = df.sparkSession.sparkContext.broadcast((model.value, model.bias))

    def make():
        value, bias = shared.value
        features = Features(value)
        return lambda texts: [pa.array(1 / (1 + np.exp(-np.clip(features.scores(texts, bias), -60, 60))))]

    return map_text(df, text, make, SCORED, keep)


#: A text whose score is below this is rejected.
GOOD_FROM = 0.3


def predicted(score: Column) -> Column:
    return (score >= GOOD_FROM).cast("int")
