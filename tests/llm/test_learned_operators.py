"""Quality, language and perplexity: exactness of the parts, held-out accuracy of the whole."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bridgeflow.llm import language, perplexity, quality, queries
from llm.helpers import HARD, hard_table, repeat_words

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_classifier"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([(s >= quality.GOOD_FROM) == (q == 1) for s, q in held]) > 0.95


def test_quality_hard_rows(spark):
    model = quality.train([(*quality.Features().document(t), y) for t, y in [("good words here", 1), ("b@d!! b@d!!", 0), ("", 1)] * 5])
    got = quality.score(hard_table(spark), model).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] == 6}
    assert len(same) == 1 and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score(hard_table(spark).limit(0), model).count() == 0
    empty = quality.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r["score"] for r in quality.score(hard_table(spark), empty).collect()} == {0.5}


def test_quality_score_is_the_model_of_the_average():
    features = quality.Features()
    text = "One two two three. One!! über"
    buckets, share = features.document(text)
    value = np.random.default_rng(0).normal(size=quality.BUCKETS).astype(np.float32)
    assert np.isclose(quality.Features(value).scores([text], 0.25)[0], float(share @ value[buckets]) + 0.25, atol=1e-5)


def test_long_pieces_are_read_whole():
    rng = random.Random(3)
    for n in (64, 65, 66, 125, 126, 127, 1000):
        word = bytes(rng.choices(range(97, 123), k=n))
        parts = quality.chunks(word)
        marked = b"<" + word + b">"
        grams = Counter(zlib.crc32(marked[i:i + 4]) % quality.BUCKETS for i in range(len(marked) - 3))
        assert sum((Counter(quality.word_features(p)[1:]) for p in parts), Counter()) == grams
        assert all(len(p) <= quality.LONGEST + 1 for p in parts)
    # texts without blanks whose first 64 bytes are the same, told apart by the rest
    good, bad = ("".join(rng.choices(s, k=200)) for s in ("天地玄黄宇宙洪荒", "買賺錢免費點擊贏"))
    head = "日月盈昃辰宿列張寒來暑往秋收冬藏閏餘成歲律呂"
    text = lambda s: head + "".join(rng.choices(s, k=150))
    model = quality.train([(*quality.Features().document(text(s)), y) for _ in range(20) for s, y in ((good, 1), (bad, 0))])
    high, low = quality.Features(model.value).scores([text(good), text(bad)], model.bias)
    assert high > 0.5 and low < -0.5
    one = quality.Features()
    buckets, share = one.document(text(good))
    assert len(one.known) == len(quality.chunks(text(good).encode()))


def test_forward_backward_by_enumeration():
    rng, k = np.random.default_rng(0), 3
    lengths = np.array([4, 1, 6, 2])
    scores, moves = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k))
    probs, pairs = language.forward_backward(scores, lengths, moves, pairs=True)
    want, expected, at = np.zeros_like(scores), np.zeros((k, k)), 0
    for n in lengths:
        total, p, e = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for y in itertools.product(range(k), repeat=int(n)):
            w = math.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                p[i, y[i]] += w
            for i in range(n - 1):
                e[y[i], y[i + 1]] += w
        want[at:at + n], expected, at = p / total, expected + e / total, at + n
    assert np.allclose(probs, want) and np.allclose(pairs, expected)


def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [(got[d["doc_id"]]["lang_pred"], d["lang"]) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    assert np.mean([a == b for a, b in held]) > 0.98


def test_language_hard_rows_and_switching(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    got = language.predict(hard_table(spark), model, keep=["doc_id"]).collect()
    assert len(got) == len(HARD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 9)} == {language.UNKNOWN}
    assert all(0 <= r["score"] <= 1 for r in got)
    one = {lang: docs.filter(F.col("lang") == lang).orderBy("doc_id").first()["text"] for lang in ("en", "de")}
    words = {k: [w for w in language.WORDS(v.lower())][:40] for k, v in one.items()}
    both = spark.createDataFrame([(1, " ".join(words["en"] + words["de"]))], "doc_id int, text string")
    labels = [w["lang"] for w in language.label_words(both, model).first()["words"]]
    n = len(words["en"])
    assert Counter(labels[:n]).most_common(1)[0][0] == "en" and Counter(labels[n:]).most_common(1)[0][0] == "de"
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(hard_table(spark), none).collect()} == {language.UNKNOWN}


def test_counts_of_whole_texts(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\x0b\n", "# a\nb b\nb b\n\n\n<x>|&$%*"] + [
        "".join(rng.choice(["a", "bb", "#c", " ", "  ", "\n", "a bb a bb a bb a bb a bb\n", " ", "\U0001f600"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity.measure(df, None).collect()}
    import re
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat_words(words))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["log_ppl"] is None


def plain_model(words):
    """Probabilities of an interpolated modified Kneser-Ney model over the characters of words, by definition."""
    n, start, end = perplexity.ORDER, perplexity.START, perplexity.END
    counts = {n: Counter()}
    for w in words:
        s = start * (n - 1) + w + end
        counts[n].update(s[i:i + n] for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    held = {}
    for k, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = lambda j: max(0.1, j - (j + 1) * y * of[j + 1] / of[j]) if of[j] and of[j + 1] else 0.1 + 0.4 * min(j, 2)
        held[k] = lambda c, d=(d(1), d(2), d(3)): min(d[min(c, 3) - 1], c)

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        k = len(gram)
        mine = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(mine.values())
        if not total:
            return p(gram[1:])
        c = mine.get(gram, 0)
        return ((c - held[k](c)) / total if c else 0) + sum(held[k](c) for c in mine.values()) / total * p(gram[1:])

    return p


def test_model_is_kneser_ney(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(40)) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    model = perplexity.fit(df)
    p = plain_model([w for t in texts for w in t.split()])
    words = ["abc", "a", "ééb", "zq", "abcabcab"]
    got, sizes = model.word_logs(words, "xx")
    for w, g in zip(words, got):
        s = perplexity.START * 4 + w + perplexity.END
        want = sum(math.log10(p(s[i - 4:i + 1])) for i in range(4, len(s)))
        assert abs(g - want) < 1e-3, w
    one = perplexity.measure(df, model).filter("doc_id = 0").first()
    logs, n = model.word_logs(texts[0].split(), "xx")
    assert abs(one["log_ppl"] + logs.sum() / n.sum()) < 1e-6


def test_every_ngram_has_its_own_probability(spark, monkeypatch):
    """Pairs of letters whose numbers had one sum of products, a few letters beyond 16 bits, in arrays and joined."""
    one, two = "\u5600\u5600", chr(0x5600 + 682) + chr(0x5600 + -69)
    words = [one] * 30 + [two, "\u5600a", two[0] + "b", "\U0001F600\U0010FFFFab", "abcdefgh", "abcxefgh"] * 2
    df = spark.createDataFrame([(i, " ".join(words[i::6]), "xx") for i in range(6)] + [(50, None, None), (51, "", "yy")], "doc_id long, text string, lang string")
    p, model = plain_model(words), perplexity.fit(df)
    checked = sorted(set(words)) + ["zq", two[0] + "\u5600"]
    got, _ = model.word_logs(checked, "xx")
    for w, g in zip(checked, got):
        s = perplexity.START * 4 + w + perplexity.END
        assert abs(g - sum(math.log10(p(s[i - 4:i + 1])) for i in range(4, len(s)))) < 1e-3, w
    rows = lambda m: {r["doc_id"]: r.asDict() for r in perplexity.measure(df, m).collect()}
    arrays = rows(model)
    monkeypatch.setattr(perplexity, "MOST_ROWS", 0)
    joined = perplexity.fit(df)
    assert isinstance(joined, perplexity.Joined) and arrays[50]["log_ppl"] is None
    assert rows(joined) == {k: r | {"log_ppl": r["log_ppl"] and pytest.approx(r["log_ppl"], abs=1e-5)} for k, r in arrays.items()}


def test_perplexity_hard_rows_and_bands(spark):
    df = hard_table(spark)
    measured = perplexity.measure(df, perplexity.fit(df), keep=["doc_id", "lang"])
    judged = perplexity.judge(measured, perplexity.bands(measured)).collect()
    assert len(judged) == len(HARD)
    assert all(r["base_failed"] and not r["kept"] for r in judged if r["doc_id"] in (1, 2, 3, 4))
    assert perplexity.measure(df.limit(0), perplexity.fit(df.limit(0))).count() == 0


def test_clean_documents_are_kept(spark):
    got = queries.QUERIES["op8_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = got.filter("quality = 1 and not base_failed").select("kept").collect()
    assert np.mean([r["kept"] for r in rows]) > 0.97


def test_a_language_with_a_line_break_is_a_language(spark):
    rows = [(1, "one two three " * 10, "e\nn"), (2, "one two three " * 10, "en"), (3, "", "e\nn"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = {r["doc_id"]: r for r in perplexity.measure(df, perplexity.fit(df), keep=["doc_id", "lang"]).collect()}
    assert made[1]["n_words"] == made[2]["n_words"] == 30 and made[1]["word_chars"] == made[2]["word_chars"] == 110
    assert made[3]["n_words"] == made[4]["n_words"] == 0 and made[1]["lang"] == "e\nn"


def test_words_are_remembered_within_bounds(monkeypatch):
    assert perplexity.learned("one") is perplexity.learned("one")
    perplexity.learned("two")
    assert list(perplexity._LEARNED) == ["two"]


def test_long_runs_are_read_whole():
    same = "abcdefghij" * 6
    one, two = same + "k" * 400, same + "z" * 400
    assert "".join(language.WORDS(one)) == one and max(map(len, language.WORDS(one))) == language.LONGEST
    features = lambda run: [sorted(language.word_features(w, {})) for w in language.WORDS(run)]
    assert features(one)[0] == features(two)[0] and features(one)[1:] != features(two)[1:]
    assert language.WORDS("ab1cd_é") == ["ab", "cd", "é"]


def test_the_end_of_a_long_run_decides(spark):
    """Texts without blanks whose first sixty letters are the same."""
    head = "abcdefghij" * 6
    rows = [(i, head + ("klm" if i % 2 else "xyz") * (40 + i), "k" if i % 2 else "x") for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, head + "klm" * 90, None), (2, head + "xyz" * 90, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(asked.drop("lang"), model).collect()} == {1: "k", 2: "x"}
