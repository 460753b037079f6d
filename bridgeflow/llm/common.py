"""Shared by the corpus operators: tables, bounded chunks of text, hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that a Python task holds as strings at once; one longer text is a chunk of its own.
CHUNK_BYTES = 2 * 1024 * 1024

#: Rows up to which a table of keys may be broadcast; beyond, Spark joins it by shuffling.
BROADCAST_ROWS = 1_000_000

Worker = Callable[..., list]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with a bounded amount of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    a, n = 0, batch.num_rows
    while a < n:
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        yield batch.slice(a, b - a)
        a = b


def map_text(df: DataFrame, text: str, make: Callable[[], Worker], out: T.StructType, keep: list[str] | None = None,
             extra: list[str] | None = None) -> DataFrame:
    """Columns of ``out`` computed from the text column, beside the other columns of ``df``.

    ``make`` runs once per task and returns a function from a list of texts (null: empty) to one
    Arrow array or list per output field. Carried are ``keep`` or all columns but the text; one
    with the name of an output gives way to it. ``extra`` columns reach the function as further
    Arrow arrays and are not carried.
    """
    made = {f.name for f in out.fields}
    carried = [c for c in (keep if keep is not None else df.columns) if c != text and c not in made]
    extra = extra or []
    source = df.select(*[F.col(f"`{c}`") for c in carried + extra], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType(source.schema.fields[:len(carried)] + out.fields)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    names = carried + [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in chunks(batch, "__text"):
                texts = [t or "" for t in piece.column("__text").to_pylist()]
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(work(texts, *[piece.column(c) for c in extra]), kinds)]
                made = [x if x.type == kind else x.cast(kind) for x, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in carried] + made, names=names)

    return source.mapInArrow(run, schema)


def list_array(flat: np.ndarray, counts, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list array from its flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def crc_mod(column: str, m: int) -> Column:
    """Remainder of the CRC-32 of a key's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def hash64(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def digest(column: Column) -> Column:
    return F.sha2(column, 256)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
]))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df
