"""Decontamination, the Jaccard join and the pipeline against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from bridgeflow.llm import decontaminate, jaccard, quality, queries, secrets
from llm.helpers import HARD, hard_table, hit_words, jaccard_rows

SF = "/root/testdata/sf0.001"


def passages(seed):
    rng = random.Random(seed)
    item = lambda n: " ".join(rng.choice("alpha beta Gamma éta delta-one the of 12".split()) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([25, 14, 10, 10, 3, 1, 0, 30])] + [(None, item(12)), (8, None), (8, "..."), (9, "same ten words as one two three four five six"), (9, "same ten words as one two three four five six")]
    texts = [(i, " ".join([item(rng.randint(0, 8)), (rng.choice(items)[1] or "")[: rng.choice([20, 60, 500])], item(4)])) for i in range(120)]
    return items, texts + [(3, texts[3][1]), (None, texts[5][1]), (4, "other text")] + [(k, t) for k, t, _ in HARD]


@pytest.mark.parametrize("block", [1_000_000, 9])
def test_hits(spark, block):
    items, texts = passages(1)
    docs = hard_table(spark, [(k, t, None) for k, t in texts])
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block=block)
    rows = got.select("doc_id", "n_words", decontaminate.n_hit(got["spans"]).alias("n_hit"), "items").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(map(str, r["items"]))) for r in rows), key=key)
    assert have == sorted(((k, *hit_words(t, items)) for k, t in texts), key=key)


def test_decontamination_edges(spark):
    items, texts = passages(2)
    docs = hard_table(spark, [(k, t, None) for k, t in texts])
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert Counter(r["text"] for r in left.collect()) == Counter(t for k, t in texts if not hit_words(t, items)[1])
    assert decontaminate.contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def near_copies(seed, n_base=25, copies=12, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for b in range(n_base):
        base = rng.choices(vocabulary, k=words)
        for c in range(rng.choice([1, 2, copies])):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (5001, None), (5002, ""), (5003, "one two"), (5004, "one  two"), (5005, "one two three")]


@pytest.mark.parametrize("block", [256, 8])
def test_classes_and_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(3)
    got = jaccard.near_duplicates(hard_table(spark, [(k, t, None) for k, t in rows])).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(jaccard_rows(rows))


def test_one_of_each(spark):
    rows = near_copies(4)
    docs = hard_table(spark, [(k, t, None) for k, t in rows])
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    want = Counter((k, c) if (t or "").split() else (k, t) for (k, t), (_, c, _) in zip(rows, jaccard_rows(rows)))
    kept = Counter(r["doc_id"] for r in got.collect())
    assert kept == Counter({k for k, c in want if k == c} | {5001, 5002})
    assert jaccard.one_of_each(docs.limit(0)).count() == 0
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_classes_do_not_hang_on_keys(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(400)}" for _ in range(80)] for _ in range(4)]
    near = lambda w: " ".join(w[:-1] + ["other"])
    # a key on unrelated texts, one of them with a near copy; a class whose keys are all null, twice
    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (2, near(base[1])), (None, " ".join(base[2])), (None, near(base[2])), (None, " ".join(base[3])), (None, near(base[3]))]
    got = jaccard.near_duplicates(hard_table(spark, [(k, t, None) for k, t in rows])).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(jaccard_rows(rows))
    assert sorted(Counter(r["class_md5"] for r in got).values()) == [1, 2, 2, 2]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(hard_table(spark, [(k, t, None) for k, t in rows])).collect())
    assert kept[1, rows[0][1]] == kept[1, rows[1][1]] == 1 and sum(kept.values()) == 4
    assert kept[None, rows[3][1]] + kept[None, rows[4][1]] == 1 and kept[None, rows[5][1]] + kept[None, rows[6][1]] == 1


def test_hard_rows(spark):
    got = jaccard.near_duplicates(hard_table(spark)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(jaccard_rows([(k, t) for k, t, _ in HARD]))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    up = {}
    find = lambda a: a if up.setdefault(a, a) == a else find(up[a])
    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in up}


def test_pairs_are_dropped_late_enough():
    assert len(jaccard.LEAST) == jaccard.HASHES // jaccard.STEP and all(a < b for a, b in zip(jaccard.LEAST, jaccard.LEAST[1:]))
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 16, (1, jaccard.HASHES)).astype(np.uint16)
        b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint16)
        lost += len(jaccard.survivors(a, b)[0]) == 0
    assert lost == 0
    far = np.where(rng.random(a.shape) < 0.2, a, a + 1).astype(np.uint16)
    assert len(jaccard.survivors(a, far)[0]) == 0


def test_pipeline_against_plain_stages(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.quality_model(spark, table, SF)
    scores = quality.Features(model.value).scores([d["text"] or "" for d in docs], model.bias)
    left = [d for d, z in zip(docs, scores) if 1 / (1 + np.exp(-z)) >= quality.GOOD_FROM]
    classes = jaccard_rows([(d["doc_id"], d["text"]) for d in left])
    left = [d for d, (k, c, _) in zip(left, classes) if k == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [d for d in left if not hit_words(d["text"], items)[1]]
    want = {d["doc_id"]: secrets.masked(d["text"], [(a, b) for _, a, b, _ in secrets.find(d["text"])], "[SECRET]") for d in left}
    got = corpus_pipeline.run(spark, SF).collect()
    import hashlib
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_stages_stand_hard_rows(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = hard_table(spark).select("doc_id", "text", "lang", "source").selectExpr("*", "cast(0 as long) as n_chars")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == names
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()
