"""Side-by-side run of a Spark query and its SQL twin on the same parquet files."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return repr(v)
    raise AssertionError(f"column value of type {type(v)}: {v!r}")


def difference(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else a description."""
    names = sorted(df.columns)
    left = sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    at = [columns.index(n) for n in names]
    right = sorted(tuple(_cell(r[i]) for i in at) for r in cur.fetchall())
    if not left:
        return "no rows"
    if left != right:
        a = [x for x in left if x not in set(right)][:3]
        b = [x for x in right if x not in set(left)][:3]
        return f"{len(left)} and {len(right)} rows; {names}; only Spark {a}; only SQL {b}"
    return None


def main() -> None:
    import time

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from bridgeflow.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith(".") and fn.__module__.endswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as e:  # report and go on to the next query
            problem = "ERROR " + str(e)[:900]
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
