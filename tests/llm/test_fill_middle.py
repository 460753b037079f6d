"""Fill-in-middle against a plain version over code points."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from bridgeflow.llm import fill_middle as fm, queries

from .helpers import HARD, hard_table

TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def plain_version(doc_id, text):
    text = text or ""
    tokens = re.findall(TOKENS, text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1f\x85  aé\U0001f600<", max_size=40))
@settings(max_examples=300, deadline=None)
def test_token_ends(text):
    assert fm.token_ends(text).tolist() == [m.end() for m in re.finditer(TOKENS, text)]


@pytest.mark.parametrize("offsets", [
    [], [1], list(range(5, 300_000, 7)), list(range(1, 200_000)), list(range(0, 140_000, 2)) + [400_000, 400_001, 900_000],
    sorted({int(x) for x in np.random.default_rng(5).integers(0, 1 << 20, 30_000)}),
])
def test_select(offsets):
    marks = fm.BoundarySet(np.array(offsets, np.int64))
    assert len(marks) == len(offsets)
    step = max(1, len(offsets) // 997)
    for k in sorted({*range(0, len(offsets), step), len(offsets) - 1} - {-1}):
        assert marks.select(k) == offsets[k]
    for k in (-1, len(offsets)):
        with pytest.raises(IndexError):
            marks.select(k)


def test_all_kinds_of_container():
    kinds = lambda xs: [c[0] for c in fm.BoundarySet(np.array(xs)).containers]
    assert kinds([1, 5, 9]) == [fm._ARRAY]
    assert kinds(range(0, 60_000, 2)) == [fm._BITMAP]
    assert kinds(range(60_000)) == [fm._RUNS]
    assert kinds([7, *range(65_536, 131_072), *range(131_072, 196_608, 3)]) == [fm._ARRAY, fm._RUNS, fm._BITMAP]


def test_hard_rows(spark):
    rows = HARD + [(10, "has <P> inside", "en"), (11, "a <M", "en"), (12, " a b " * 40_000, "en"), (13, "\U0001f600 é " * 30_000, "en")]
    rows += [(i, "one two\tthree \n four<S five ", "en") for i in range(100, 160)]
    made = fm.restored(fm.transform(hard_table(spark, rows)))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()), key=repr)
    assert got == sorted(((k, *plain_version(k, t)) for k, t, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in made.collect())
    assert texts == sorted((k or 0, t or "") for k, t, _ in rows)
    for _, _, form, _, _, out in got:
        assert fm.restore(out, form) in {t or "" for _, t, _ in rows}


@given(st.text(alphabet="ab <PSM>\n", max_size=30), st.data())
@settings(max_examples=300, deadline=None)
def test_round_trip(text, data):
    if any(s in text for s in (fm.PREFIX, fm.SUFFIX, fm.MIDDLE)):
        return
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    for form in (fm.PSM, fm.SPM):
        assert fm.restore(fm.assemble(text, a, b, form), form) == text


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fm.restored(fm.transform(empty)).collect() == []


def test_query_has_the_contract_columns(spark, sf_dir):
    made = queries.op11_fill_in_middle(spark, sf_dir)
    assert dict(made.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
                                 "output_sha256": "string", "restored_sha256": "string"}
