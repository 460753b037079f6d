"""Byte-level BPE encoding and decoding with a rank queue under a hierarchical bitmap.

Each pre-token is merged on its own. Positions of mergeable pairs wait in one bucket per merge
rank; a bitmap of two levels (one bit per rank, one per word of 256 ranks) finds the lowest waiting
rank by two find-first-set steps; parts form a linked list, and an entry whose pair has changed
meanwhile is skipped. A pre-token of n bytes costs O(n log n) however long it is.

Null texts are encoded as empty ones: no ids and no bytes.
"""

from __future__ import annotations

import base64
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .common import list_array, map_text

#: Pre-tokens up to this many characters are remembered, and so many of them at most.
CACHED_CHARS, CACHED_TOKENS = 40, 500_000
#: Ranks per word of the bitmap: 2 ** SHIFT.
SHIFT = 8
MASK = (1 << SHIFT) - 1


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with one ``base64 rank`` pair per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.words = [0] * ((len(self.pieces) >> SHIFT) + 1)  # all zero again after each merge
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [get(piece[i:i + 2]) for i in range(n - 1)] + [None]
        # buckets hold positions as heaps; words has a bit for each rank that waits, top one for each word in use
        buckets: dict[int, list[int]] = {}
        words, top = self.words, 0
        for i, rank in enumerate(current):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> SHIFT] |= 1 << (rank & MASK)
                    top |= 1 << (rank >> SHIFT)
        while top:
            a = (top & -top).bit_length() - 1
            word = words[a]
            rank = (a << SHIFT) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                word &= word - 1
                words[a] = word
                if not word:
                    top &= top - 1
            if current[i] != rank:
                continue  # the pair has changed since
            gone = after[i]
            end = after[i] = after[gone]
            current[gone] = current[i] = None
            if end < n:
                before[end] = i
            left = before[i]
            for at, stop in ((i, after[end] if end < n else 0), (left, end if left >= 0 else 0)):
                if not stop:
                    continue
                made = current[at] = get(piece[at:stop])
                if made is not None:
                    if made in buckets:
                        heappush(buckets[made], at)
                    else:
                        buckets[made] = [at]
                        words[made >> SHIFT] |= 1 << (made & MASK)
                        top |= 1 << (made >> SHIFT)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def _packed(self, piece: str) -> bytes:
        packed = np.array(self.merge(piece.encode()), np.int32).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.known) >= CACHED_TOKENS:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        known, packed = self.known.get, self._packed
        return np.frombuffer(b"".join([known(p) or packed(p) for p in self.split(text)]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[tuple, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    key = (hash(shared.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(shared.value), pattern)
    return _codecs[key]


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])


def encode_decode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``ids`` of each text, and ``decoded``, the bytes that these ids stand for.

    ``ranks`` is the content of a rank file; the driver reads it once and it is shared as a
    broadcast of under a megabyte, whatever the corpus.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        codec = _codec(shared, pattern)

        def work(texts: list[str]) -> list:
            ids = [codec.encode(t) for t in texts]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [list_array(flat, [len(x) for x in ids], pa.int32()), pa.array([codec.decode(x) for x in ids], pa.binary())]

        return work

    return map_text(df, text, make, ENCODED, keep)
