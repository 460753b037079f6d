"""Fill-in-middle transformation: whole texts cut between tokens at two places and reordered.

The token ends of a text form a ``BoundarySet``, a compressed set of code point offsets: offsets
are dealt to containers by their upper bits, a container is a sorted array, a bitmap or a list of
runs, whichever is smallest, and cumulative cardinalities lead to the container that holds the
k-th end, which is then selected inside it. Cuts come from a digest of the key, so a row gives the
same output in any partition and any run.

Cases: null and empty texts are ``plain`` with 0 tokens and the empty text as output; a text that
holds a sentinel is ``plain``, so that every output can be taken apart again. Rows that repeat, or
whose keys do, each get their own output, equal for equal rows; a null key counts as the empty
text in the digest. An empty table gives an empty one. A text of any length is cut as a whole; a
task holds one text of more than ``common.CHUNK_BYTES`` at a time, with five bytes a code point
beside it. Columns that are not carried, or clash with an output, give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import map_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM, PSM = "plain", "spm", "psm"

#: Upper bits of an offset name its container.
LOW_BITS = 16
_ARRAY, _BITMAP, _RUNS = 0, 1, 2

#: Space and \t to \r.
_SPACES = np.zeros(33, bool)
_SPACES[[32, *range(9, 14)]] = True
_SET_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)


def token_ends(text: str) -> np.ndarray:
    """Offsets at which the tokens of ``text`` end: after each run of other characters, and after a last run of spaces."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return np.zeros(0, np.int64)
    space = _SPACES[np.minimum(codes, 32)] & (codes <= 32)
    last = np.empty(len(codes), bool)
    np.greater(space[1:], space[:-1], out=last[:-1])
    last[-1] = True
    return np.flatnonzero(last) + 1


class BoundarySet:
    """A sorted set of offsets in array, bitmap and run containers, with ``select``."""

    def __init__(self, offsets: np.ndarray) -> None:
        offsets = np.asarray(offsets, np.int64)
        high = offsets >> LOW_BITS
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(offsets) else np.zeros(0, np.int64)
        self.keys = high[starts]
        #: members up to and with each container
        self.until = np.r_[starts[1:], len(offsets)] if len(offsets) else starts
        low = (offsets & ((1 << LOW_BITS) - 1)).astype(np.uint16)
        self.containers = [self._container(low[a:b]) for a, b in zip(starts, self.until)]

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        """The smallest form: two bytes a member, 8 KB of bits, or four bytes a run."""
        first = np.flatnonzero(np.r_[True, np.diff(low.astype(np.int64)) != 1])
        if 4 * len(first) < min(2 * len(low), 1 << (LOW_BITS - 3)):
            lengths = np.diff(np.r_[first, len(low)])
            return _RUNS, low[first], np.cumsum(lengths)
        if 2 * len(low) <= 1 << (LOW_BITS - 3):
            return _ARRAY, low, None
        bits = np.zeros(1 << LOW_BITS, bool)
        bits[low] = True
        packed = np.packbits(bits, bitorder="little")
        return _BITMAP, packed, np.cumsum(_SET_BITS[packed])

    def __len__(self) -> int:
        return int(self.until[-1]) if len(self.until) else 0

    def select(self, k: int) -> int:
        """The member with ``k`` members below it."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.until, k, side="right"))
        k -= int(self.until[c - 1]) if c else 0
        kind, values, until = self.containers[c]
        if kind == _ARRAY:
            low = int(values[k])
        elif kind == _RUNS:
            run = int(np.searchsorted(until, k, side="right"))
            low = int(values[run]) + k - (int(until[run - 1]) if run else 0)
        else:
            byte = int(np.searchsorted(until, k, side="right"))
            k -= int(until[byte - 1]) if byte else 0
            low = byte * 8 + [i for i in range(8) if values[byte] >> i & 1][k]
        return (int(self.keys[c]) << LOW_BITS) + low

    def end_of(self, units: int) -> int:
        """Offset after the first ``units`` tokens."""
        return self.select(units - 1) if units else 0


def assemble(text: str, a: int, b: int, form: str) -> str:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == PSM:
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``output`` was made from; parts never hold a sentinel, so the first one of each kind counts."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, middle = output[len(first):].split(MIDDLE, 1)
    one, two = head.split(second, 1)
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return prefix + middle + suffix


def draws(key: Column, seed: int = 42) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of seed and key."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


OUT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Key, ``n`` tokens, ``form``, cut lengths and ``output`` of every row.

    ``rate`` percent of the texts are transformed, of these ``spm_rate`` percent suffix first.
    """
    h = draws(F.col(f"`{key}`"), seed)
    # the draws travel in one column beside the text
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text"),
                       F.when(h[2] % 100 >= rate, F.lit(PLAIN)).when(h[3] % 100 < spm_rate, F.lit(SPM)).otherwise(F.lit(PSM)).alias("__form"),
                       h[0].alias("__h1"), h[1].alias("__h2"))

    def make():
        def work(texts: list[str], forms: pa.Array, first: pa.Array, second: pa.Array) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for t, form, h1, h2 in zip(texts, forms.to_pylist(), first.to_pylist(), second.to_pylist()):
                ends = token_ends(t)
                n = len(ends)
                row = (n, PLAIN, None, None, t)
                if n and form != PLAIN and PREFIX not in t and SUFFIX not in t and MIDDLE not in t:
                    marks = BoundarySet(ends)
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = marks.end_of(a), marks.end_of(b)
                    row = (n, form, a, b - a, assemble(t, a, b, form))
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    made = map_text(rows, "text", make, OUT, keep=["__key"], extra=["__form", "__h1", "__h2"])
    return made.withColumnRenamed("__key", key)


def restored(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``made`` with the ``text`` rebuilt from ``output`` and ``form`` alone."""
    o, f = F.col(output), F.col(form)
    after = lambda s, mark: F.substr(s, F.position(F.lit(mark), s) + len(mark))
    until = lambda s, mark: F.substr(s, F.lit(1), F.position(F.lit(mark), s) - 1)
    head, middle = F.substr(until(o, MIDDLE), F.lit(len(PREFIX) + 1)), after(o, MIDDLE)
    psm = F.concat(until(head, SUFFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, until(head, PREFIX))
    return made.withColumn("text", F.when(f == PLAIN, o).when(f == PSM, psm).otherwise(spm))
