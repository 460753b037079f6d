"""Language of words and texts by a linear-chain conditional random field.

Every word gets features (itself, its affixes, its character n-grams, the lexicons it is in); a
learned weight per feature and language and a learned transition per pair of languages label the
words of a text together, so that a text which switches between languages is labelled word by
word. Forward-backward gives each word's probabilities; a text's language is the one with the most
words by expectation, its score that expected share.

The chain runs over all words of a text in order. Words are runs of letters, in lower case; a run of
more than ``LONGEST`` is read whole, as several words. A text
without one (null and empty included) is ``und`` with score 0, and so is any text when there was
nothing to learn from. Equal expectations go to the language that sorts first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_text

#: Rows that the model is fitted on at most, and words of each that are used (one stretch each).
SAMPLE_ROWS, SAMPLE_WORDS = 1600, 100
BUCKETS, EPOCHS, BATCH, RATE, DECAY = 1 << 16, 6, 16, 0.3, 1e-5
#: Words of a language's lexicon at most, and the share of its uses that must be in the language.
LEXICON, PURE = 300, 0.9
CACHED_WORDS = 500_000
UNKNOWN = "und"

#: Letters of a word at most: a longer run, as in scripts without blanks, is several words one after another.
LONGEST = 60
WORDS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}").findall


def word_features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Buckets of a word's features, affixes and n-grams by bytes; ``lexicons`` has a bit set of languages for each listed word."""
    crc, raw = zlib.crc32, word.encode()
    found = [crc(raw, 1), crc(raw[:1], 11), crc(raw[:2], 12), crc(raw[:3], 13), crc(raw[-1:], 21), crc(raw[-2:], 22), crc(raw[-3:], 23)]
    found += [crc(raw[i:i + 3], 33) for i in range(len(raw) - 2)]
    if word in lexicons:
        found.append(lexicons[word] + 40)
    return [x % BUCKETS for x in found]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket, language
    moves: np.ndarray  # language, next language
    lexicons: dict[str, int] = field(default_factory=dict)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probabilities of the labels of each word; ``scores`` holds the sequences one after another.

    With ``pairs`` also the expected number of moves from each label to each next one.

    All sequences advance together, the longest first, so a step costs one matrix product.
    """
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    # words by step, then by sequence, so that each step is one slice
    begins = np.cumsum(active) - active
    steps = np.repeat(np.arange(len(active)), active)
    place = starts[np.arange(len(steps)) - begins[steps]] + steps
    local = scores[place]
    local = np.exp(local - local.max(axis=1, keepdims=True)) if len(local) else local
    move = np.exp(moves - moves.max())
    ahead, behind = np.empty_like(local), np.empty_like(local)
    ones, last = np.ones((k, 1)), None
    for a, m in zip(begins.tolist(), active.tolist()):
        now = local[a:a + m] if last is None else (last[:m] @ move) * local[a:a + m]
        last = np.divide(now, now @ ones, out=ahead[a:a + m])
    back = move.T.copy()
    last, was, after = None, 0, 0
    for a, m in zip(begins[::-1].tolist(), active[::-1].tolist()):
        now = behind[a:a + m]
        now[was:] = 1.0 / k
        if was:
            step = (last * local[after:after + was]) @ back
            np.divide(step, step @ ones, out=now[:was])
        last, was, after = now, m, a
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    probs = np.empty_like(both)
    probs[place] = both
    if not pairs:
        return probs
    # a word of step t + 1 stands as many places after its predecessor as step t has sequences
    later = np.arange(active[0], len(place)) if len(active) else np.zeros(0, np.int64)
    earlier = later - active[steps[later] - 1]
    joint = ahead[earlier][:, :, None] * move[None] * (local * behind)[later][:, None, :]
    return probs, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def train(texts: list[list[str]], labels: list[str], seed: int = 1) -> Model:
    """Weights and transitions by stochastic gradient ascent on the likelihood of the word labels."""
    langs = sorted(set(labels))
    k = len(langs)
    place = {x: i for i, x in enumerate(langs)}
    uses = [Counter() for _ in langs]
    for words, lang in zip(texts, labels):
        uses[place[lang]].update(words)
    totals = [max(1, sum(u.values())) for u in uses]
    lexicons: dict[str, int] = {}
    for i, u in enumerate(uses):
        rate = lambda w: sum(v[w] / n for v, n in zip(uses, totals))
        listed = [w for w, c in sorted(u.items(), key=lambda x: (-x[1], x[0]))[:3 * LEXICON] if c > 1 and u[w] / totals[i] >= PURE * rate(w)]
        for w in listed[:LEXICON]:
            lexicons[w] = lexicons.get(w, 0) | 1 << i
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen = np.full((BUCKETS, k), 1e-2)
    known = {w: np.array(word_features(w, lexicons)) for words in texts for w in set(words)}
    full = np.array([d for d, words in enumerate(texts) if words], np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(full)
        for a in range(0, len(shuffled), BATCH):
            some = shuffled[a:a + BATCH]
            lists = [known[w] for d in some for w in texts[d]]
            lengths = np.array([len(texts[d]) for d in some])
            sizes = np.array([len(x) for x in lists])
            flat = np.concatenate(lists)
            scores = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
            probs, expected = forward_backward(scores, lengths, moves, pairs=True)
            y = np.repeat([place[labels[d]] for d in some], lengths)
            error = -probs
            error[np.arange(len(y)), y] += 1
            order = np.argsort(flat, kind="stable")
            buckets, starts = np.unique(flat[order], return_index=True)
            slope = np.add.reduceat(np.repeat(error, sizes, axis=0)[order], starts, axis=0) / len(some)
            slope -= DECAY * weights[buckets]
            seen[buckets] += slope ** 2
            weights[buckets] += RATE * slope / np.sqrt(seen[buckets])
            observed = np.zeros((k, k))
            np.add.at(observed, (y, y), 1.0)
            for d in some:
                observed[place[labels[d]], place[labels[d]]] -= 1
            moves += RATE * (observed - expected) / len(y) - DECAY * moves
    return Model(langs, weights.astype(np.float32), moves, lexicons)


class Labeller:
    """Emission scores of distinct words, remembered by a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Number new words and score them all at once."""
        if not words:
            return
        lists = [word_features(w, self.model.lexicons) for w in words]
        sizes = np.array([len(x) for x in lists])
        found = np.add.reduceat(self.model.weights[np.concatenate(lists)], np.cumsum(sizes) - sizes, axis=0)
        first = len(self.known)
        while first + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[first:first + len(words)] = found
        self.known.update(zip(words, range(first, first + len(words))))

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        """Probabilities of all words of all texts, one after another."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        flat = list(chain.from_iterable(texts))
        self.learn(set(flat) - self.known.keys())
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(x) for x in texts], np.int64)
        return forward_backward(self.scores[at].astype(np.float64), lengths[lengths > 0], self.model.moves)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Expected share of each language in the words of each text; zeros without words."""
        words = [WORDS(t.lower()) for t in texts]
        lengths = np.array([len(x) for x in words], np.int64)
        out = np.zeros((len(texts), len(self.model.langs)))
        if lengths.any() and self.model.langs:
            probs = self.probabilities(words)
            full = np.flatnonzero(lengths)
            starts = np.cumsum(lengths[full]) - lengths[full]
            out[full] = np.add.reduceat(probs, starts, axis=0) / lengths[full, None]
        return out


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows with a language; ``sample_rows`` bounds what reaches the driver.

    The rows with the lowest hash of their key are taken; of each one stretch of words, from a
    place that depends on the key alone.
    """
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.col(text).alias("__t"))
    first = rows.select("__key", "__lang").orderBy(F.xxhash64("__key"), "__key", "__lang").limit(sample_rows)
    some = rows.join(first.distinct(), ["__key", "__lang"])

    def make():
        def stretch(text: str) -> list[str]:
            words = WORDS(text.lower())
            a = zlib.crc32(text[:64].encode()) % max(1, len(words) - SAMPLE_WORDS + 1)
            return words[a:a + SAMPLE_WORDS]

        return lambda texts: [[stretch(t) for t in texts]]

    words = T.StructType([T.StructField("words", T.ArrayType(T.StringType()))])
    got = map_text(some, "__t", make, words).orderBy(F.xxhash64("__key"), "__key", "__lang", F.xxhash64("words")).limit(sample_rows).collect()
    return train([r["words"] for r in got], [r["__lang"] for r in got])


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                          T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))])


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred``, ``score`` and ``shares`` (the expected share of every learned language) of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shared.value)
        langs = shared.value.langs

        def work(texts: list[str]) -> list:
            shares = labeller.shares(texts)
            if not langs:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts)]
            best = shares.argmax(axis=1)
            score = np.minimum(shares[np.arange(len(texts)), best], 1.0)
            names = [langs[b] if s > 0 else UNKNOWN for b, s in zip(best, score)]
            pairs = [list(zip(langs, map(float, row))) if s > 0 else [] for row, s in zip(shares, score)]
            return [names, pa.array(score), pairs]

        return work

    return map_text(df, text, make, PREDICTED, keep)


def label_words(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``words``: every word of each text with its likeliest language and that language's probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("words", T.ArrayType(T.StructType([
        T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])))])

    def make():
        labeller = Labeller(shared.value)
        langs = shared.value.langs

        def work(texts: list[str]) -> list:
            words = [WORDS(t.lower()) for t in texts]
            if not langs or not any(words):
                return [[[] for _ in texts]]
            probs, at, rows = labeller.probabilities(words), 0, []
            for w in words:
                mine = probs[at:at + len(w)]
                at += len(w)
                rows.append([{"word": x, "lang": langs[p.argmax()], "score": float(p.max())} for x, p in zip(w, mine)])
            return [rows]

        return work

    return map_text(df, text, make, out, keep)
