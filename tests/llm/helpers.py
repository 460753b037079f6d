"""Rows that every corpus operator must stand, and plain versions of what the operators compute."""

from __future__ import annotations

import collections
import re

LONG = "lorem ipsum dolor sit amet " * 20_000
HARD = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "x" * 200_000, "en"), (5, LONG, "fr"), (6, "same text here again", None),
    (6, "same text here again", None), (None, "same text here again", "de"), (7, "é\U0001f600 café über", "de"), (8, "\x00\x01 null bytes", "en"), (9, "...!!!???", None),
]


def hard_table(spark, rows=HARD):
    """The hard rows, with extra columns whose names clash with outputs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = ["spans", "score", "ids", "decoded", "n_words", "licenses", "n", "id", "key", "class_id", "words", "links", "source", "n_chars"]
    return df.withColumns({c: F.lit("clash") for c in clash})


def jaccard_rows(rows, size=5, least=0.8):
    """(key, class, links) of every row by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(rows)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in where[g] if j != i)
        for j, n in shared.items():
            if n >= least * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    classes = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        classes[find(i)].append(k)
    least_key = {r: min((k for k in ks if k is not None), default=None) for r, ks in classes.items()}
    return [(rows[i][0], least_key[find(i)] if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_spans(text):
    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PERSONAL.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def secret_spans(text):
    assign = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text or "") if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def hit_words(text, items, window=10):
    """(number of words, hit words, ids of items with a window in the text) by plain search."""
    def words(t):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        if not n:
            continue
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in grams:
                hit.update(range(i, i + n))
                ids.add(item)
    return len(w), len(hit), sorted(str(x) for x in ids if x is not None)


def repeat_words(words, n=8):
    seen = collections.Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return len({j for i in range(len(words) - n + 1) if seen[tuple(words[i:i + n])] > 1 for j in range(i, i + n)})
