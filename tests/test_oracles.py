"""Every registered query with an SQL twin returns the same rows as the twin."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"score_pairs", "connect_nodes", "candidate_pairs"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    problem = difference(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY), problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_without_the_corpus_operators(tmp_path):
    """A copy of the repository without the corpus operators still lists every other query."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries(); print(len(e.queries()), len(e.oracle_sql()))"
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert made.returncode == 0, made.stderr
    own = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]
    assert int(made.stdout.split()[0]) == len(own)
