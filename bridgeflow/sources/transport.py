"""Transports of one's own as Spark data sources, and line files followed from stored offsets.

A ``Transport`` says which sources it has, how far they go and how to read or write a stretch;
``register_transport`` makes it a format for ``spark.read``, ``readStream`` and ``write``. Positions
are per source and live in Spark's checkpoint, so a restarted stream goes on where its last
finished batch ended. Sources are read by the executors, in stretches of bounded size.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

Positions = dict[str, int]


class Transport:
    """Base of transports; ``options`` are those given to the reader or writer."""

    schema: str = "value string"

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def start(self) -> Positions:
        """Where a new stream begins."""
        return {}

    def end(self) -> Positions:
        """How far the sources go now. A source that is missing from the start begins at 0."""
        raise NotImplementedError(f"{type(self).__name__} cannot be read")

    def split(self, source: str, start: int, end: int) -> list[tuple[int, int]]:
        """Stretches that are read apart."""
        return [(start, end)]

    def read(self, source: str, start: int, end: int) -> Iterator[tuple]:
        """Rows of a stretch, by the columns of ``schema``."""
        raise NotImplementedError(f"{type(self).__name__} cannot be read")

    def write(self, rows: Iterator, batch: int | None, task: int) -> str:
        """Write the rows of a task and return what ``commit`` needs. A task may run more than once."""
        raise NotImplementedError(f"{type(self).__name__} cannot be written")

    def commit(self, written: list[str], batch: int | None) -> None:
        """Called once all tasks are written; a batch that is run again may be committed again."""


class _Stretch(InputPartition):
    def __init__(self, source: str, start: int, end: int) -> None:
        super().__init__((source, start, end))
        self.source, self.start, self.end = source, start, end


def _stretches(transport: Transport, start: Positions, end: Positions) -> list[_Stretch]:
    out = []
    for source, upto in sorted(end.items()):
        begin = start.get(source, 0)
        begin = 0 if upto < begin else begin  # a source that became shorter was replaced
        if begin < upto:
            out += [_Stretch(source, a, b) for a, b in transport.split(source, begin, upto)]
    return out


class _Batch(DataSourceReader):
    def __init__(self, transport: Transport) -> None:
        self.transport = transport

    def partitions(self):
        return _stretches(self.transport, {}, self.transport.end()) or [_Stretch("", 0, 0)]

    def read(self, part):
        return self.transport.read(part.source, part.start, part.end) if part.end > part.start else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, transport: Transport) -> None:
        self.transport = transport

    def initialOffset(self) -> dict:
        return self.transport.start()

    def latestOffset(self) -> dict:
        return self.transport.end()

    def partitions(self, start: dict, end: dict):
        return _stretches(self.transport, start, end)

    def read(self, part):
        return self.transport.read(part.source, part.start, part.end)

    def commit(self, end: dict) -> None:
        pass


class _Written(WriterCommitMessage):
    def __init__(self, what: str) -> None:
        self.what = what


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class _BatchWriter(DataSourceWriter):
    def __init__(self, transport: Transport) -> None:
        self.transport = transport

    def write(self, rows):
        return _Written(self.transport.write(rows, None, _task()))

    def commit(self, messages):
        self.transport.commit([m.what for m in messages if m is not None], None)


class _StreamWriter(DataSourceStreamWriter):
    """Tasks do not know their batch, so a committed batch names what was written."""

    def __init__(self, transport: Transport) -> None:
        self.transport = transport

    def write(self, rows):
        return _Written(self.transport.write(rows, None, _task()))

    def commit(self, messages, batchId: int):
        self.transport.commit([m.what for m in messages if m is not None], batchId)


def register_transport(spark: SparkSession, format_name: str, transport: type[Transport]) -> None:
    """Make a transport a format of ``spark.read``, ``spark.readStream``, ``df.write`` and ``df.writeStream``."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return transport.schema

        def reader(self, schema: T.StructType):
            return _Batch(transport(dict(self.options)))

        def streamReader(self, schema: T.StructType):
            return _Stream(transport(dict(self.options)))

        def writer(self, schema: T.StructType, overwrite: bool):
            return _BatchWriter(transport(dict(self.options)))

        def streamWriter(self, schema: T.StructType, overwrite: bool):
            return _StreamWriter(transport(dict(self.options)))

    spark.dataSource.register(Source)


# ---- line files ---------------------------------------------------------------------------

class LineFiles(Transport):
    """Complete lines of growing files, with the place of each line.

    Options: ``path`` (a file, folder or pattern on a file system that all executors see), ``from``
    (``start`` or ``end``: what the files hold already is left out) and ``stretch``, the bytes that a
    task reads at once. A line belongs to the stretch that its first byte lies in; what follows the
    last line end is left for later. Bytes that are no UTF-8 are replaced.
    """

    schema = "path string, place long, line string"

    def _files(self) -> list[str]:
        path = self.options["path"]
        if os.path.isdir(path):
            path = os.path.join(glob.escape(path), "*")
        return sorted(f for f in glob.glob(path) if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_")))

    def start(self) -> Positions:
        return self.end() if self.options.get("from", "end") == "end" else {}

    def end(self) -> Positions:
        return {f: self._complete(f) for f in self._files()}

    @staticmethod
    def _complete(path: str, block: int = 1 << 16) -> int:
        """Bytes up to the last line end, looked for from behind."""
        with open(path, "rb") as file:
            upto = file.seek(0, os.SEEK_END)
            while upto > 0:
                begin = max(0, upto - block)
                file.seek(begin)
                at = file.read(upto - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                upto = begin
        return 0

    def split(self, source: str, start: int, end: int) -> list[tuple[int, int]]:
        size = int(self.options.get("stretch", 64 * 1024 * 1024))
        return [(a, min(a + size, end)) for a in range(start, end, size)]

    def read(self, source: str, start: int, end: int) -> Iterator[tuple]:
        with open(source, "rb") as file:
            at = start
            if start > 0:
                # the line that runs into this stretch belongs to the one before
                file.seek(start - 1)
                at = start - 1 + len(file.readline())
            file.seek(at)
            while at < end:
                line = file.readline()
                if not line.endswith(b"\n"):
                    return
                yield source, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


def follow_lines(spark: SparkSession, path: str, from_end: bool = True, stretch: int = 64 * 1024 * 1024) -> DataFrame:
    """Stream of the lines appended to files: path, place and line; from their present end on, or all of them."""
    register_transport(spark, "line_files", LineFiles)
    return spark.readStream.format("line_files").options(**{"path": path, "from": "end" if from_end else "start", "stretch": str(stretch)}).load()


def read_lines(spark: SparkSession, path: str, stretch: int = 64 * 1024 * 1024) -> DataFrame:
    """The complete lines that the files hold now, with their places."""
    register_transport(spark, "line_files", LineFiles)
    return spark.read.format("line_files").options(path=path, stretch=str(stretch)).load()
