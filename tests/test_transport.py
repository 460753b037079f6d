"""Transports of one's own, and line files followed over restarts."""

import json
import os

from bridgeflow.sources import transport as tp
from bridgeflow.sources.decode import line_records


def test_lines_are_read_once_whatever_the_stretch(spark, tmp_path):
    text = "".join(f"line {i} é\n" * (i % 3) + "\r\n" * (i % 5 == 0) for i in range(200)) + "no end"
    (tmp_path / "a.log").write_bytes(text.encode())
    (tmp_path / "b.log").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x\n")
    want = [x.rstrip("\r") for x in text.split("\n")[:-1]]
    for stretch in (7, 100, 1 << 20):
        rows = tp.read_lines(spark, str(tmp_path), stretch).orderBy("place").collect()
        assert [r["line"] for r in rows] == want
        assert len({r["place"] for r in rows}) == len(want)


def run(spark, source, out, state):
    query = source.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).start()
    query.processAllAvailable()
    return query


def append(path, *lines, end="\n"):
    with open(path, "a") as file:
        file.write("\n".join(lines) + end)


def test_followed_over_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(folder)
    append(f"{folder}/a.log", "old 1", "old 2")
    source = lambda: tp.follow_lines(spark, folder, stretch=10)
    query = run(spark, source(), out, state)
    append(f"{folder}/a.log", "new 1", "new 2")
    append(f"{folder}/a.log", "half", end="")
    query.processAllAvailable()
    query.stop()
    # while the stream is down a line is finished, more come, and a new file begins
    append(f"{folder}/a.log", " and half", "new 3")
    append(f"{folder}/b.log", "other 1", "other 2")
    query = run(spark, source(), out, state)
    append(f"{folder}/b.log", "other 3")
    query.processAllAvailable()
    query.stop()
    got = sorted(r["line"] for r in spark.read.parquet(out).collect())
    assert got == sorted(["new 1", "new 2", "half and half", "new 3", "other 1", "other 2", "other 3"])


def test_from_the_start(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    append(folder / "a.log", '{"a": 1}', "{bad", '{"a": 2}')
    query = run(spark, tp.follow_lines(spark, str(folder), from_end=False), str(tmp_path / "out"), str(tmp_path / "state"))
    query.stop()
    lines = spark.read.parquet(str(tmp_path / "out")).orderBy("place").selectExpr("line AS value")
    assert lines.count() == 3 and line_records(lines).count() > 0


def numbered():
    class Numbered(tp.Transport):
        """Two counters as sources; written rows go to a folder, a file per task, listed on commit."""

        schema = "source string, n long"

        def end(self):
            return {"even": 40, "odd": 30}

        def split(self, source, start, end):
            return [(a, min(a + 16, end)) for a in range(start, end, 16)]

        def read(self, source, start, end):
            for i in range(start, end):
                yield source, 2 * i + (source == "odd")

        def write(self, rows, batch, task):
            import uuid

            name = f"{task}-{uuid.uuid4().hex}"
            with open(os.path.join(self.options["path"], name), "w") as file:
                json.dump([r["n"] for r in rows], file)
            return name

        def commit(self, written, batch):
            with open(os.path.join(self.options["path"], "_done"), "w") as file:
                json.dump(written, file)

    return Numbered


def test_own_transport(spark, tmp_path):
    tp.register_transport(spark, "numbered", numbered())
    df = spark.read.format("numbered").load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r["n"] for r in df.collect()) == sorted([2 * i for i in range(40)] + [2 * i + 1 for i in range(30)])
    df.write.format("numbered").option("path", str(tmp_path)).mode("append").save()
    files = json.loads((tmp_path / "_done").read_text())
    assert sorted(n for f in files for n in json.loads((tmp_path / f).read_text())) == sorted(r["n"] for r in df.collect())
