"""Secrets in texts: fixed credential shapes, and credential values that are costly to guess.

Three shapes are reported wherever they occur. In addition every value in a credential context
(``pwd: ...``, ``Authorization: Bearer ...``, ``scheme://user:value@host``) is rated by the number
of guesses it would take: the cheapest split into dictionary words, dates, repeats, sequences,
keyboard walks and brute-force spans, found by dynamic programming; costly values are reported.
A value is matched and reported whole, however long; one that is a single word of some language
costs no more than a dictionary of such words, and references like ``$NAME`` are no values.

Null and empty texts have no spans. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import SPANS, map_text

KINDS = ("assign", "access", "hex")
#: Kind of the spans that the guess cost adds.
GUESSED = "guessed"
#: Guesses as a power of ten from which a value counts as a secret, and the least length of one.
COSTLY, SHORTEST = 8.0, 8

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Other credential contexts; the value is the last group.
_CONTEXTS = (
    re.compile(r"""(?:pass(?:word|phrase|wd|code)?|pwd|pw|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|"""
               r"""client[_-]?secret|auth|credentials?)["']?\x20*+(?::=|=>|[:=])\x20*+["']?([^\s"'<>,;]{6,}+)""", re.I | re.A),
    re.compile(r"""(?:bearer|basic)\x20++([A-Za-z0-9+/_.=~-]{8,}+)""", re.I | re.A),
    re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:([^\s/@]{4,}+)@""", re.A),
)
#: A cheap look before the contexts are searched.
_HINT = re.compile(r"pass|pwd|pw|secret|token|key|auth|credential|bearer|basic|://", re.I | re.A)

#: Frequent parts of passwords, commonest first: the place in the list is the number of guesses.
WORDS = (
    "password qwerty letmein admin welcome monkey dragon master login princess sunshine football baseball shadow "
    "superman batman trustno iloveyou hello freedom whatever secret summer winter spring autumn flower love changeme "
    "default root test guest user example sample dummy placeholder your here none null true false token key pass "
    "server database local host public private access service account system manager office company".split()
)
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Guesses, as a power of ten, for a word of some language that is not listed, and its letters at most.
UNLISTED, LONGEST_WORD = 6.0, 16
#: Characters that are rated at a time, and the cost at which a span's score is full.
PIECE, FULL = 400, 20
#: Neighbouring letters that are common in words of languages in Latin script.
_COMMON = {c + v for c in "bcdfghlmnprstvk" for v in "aeiou"} | {v + c for c in "bcdfglmnprstvk" for v in "aeiou"} | set(
    "ea ee ei eu ie io oo ou ai au ia oi ue ui ua qu ya ye yo ay ey oy ly ty ry ny my by ja je jo ju wa we wi wo aw ew ow "
    "ze za zi iz ez az ex ax ah eh oh th sh ch ck ph wh gh st sp sc sk sm sn sl sw tr dr br cr fr gr pr kr bl cl fl gl pl "
    "nd nt ng ns nc nk mp mb ld lt lk ls lv lm rd rt rs rn rm rl rk rg rc rv rb ct pt ft ts ds ks ms ps cs bs "
    "ll ss tt ff nn mm rr pp cc dd gg xp xt tz ht dg wn rw sz kt hr hl nf".split())
_LEET = str.maketrans("@401357$!", "aaoiestsi")


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD):
        for x, key in enumerate(row):
            near[key] = {r[i] for dy in (-1, 0, 1) if 0 <= y + dy < len(KEYBOARD) for r in (KEYBOARD[y + dy],)
                         for i in (x - 1, x, x + 1) if 0 <= i < len(r)} - {key}
    return near


_NEAR = _neighbours()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")


def _alphabet(value: str) -> int:
    kinds = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for test, n in kinds if any(test(c) and c.isascii() for c in value))
    return max(10, size + 33 * any(not c.isalnum() or not c.isascii() for c in value))


def _wordlike(value: str) -> bool:
    """Small letters, or with one capital in front, whose neighbours are nearly all common in words; accents do not count."""
    if not value.isalpha() or not (value.islower() or value.istitle()):
        return False
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    pairs = [plain[i:i + 2] for i in range(len(plain) - 1)]
    return sum(p in _COMMON for p in pairs) >= 0.8 * len(pairs)


def guess_cost(value: str) -> float:
    """Guesses for ``value`` as a power of ten, over its cheapest split.

    ``cost[j]`` is the cheapest way to have guessed the first j characters; a part from i to j is a
    known word (also in leet spelling or other case), a date, a repeat of an earlier unit, a run of
    neighbouring code points, a walk over neighbouring keys, or one more brute-force character. A
    value that is one unlisted word, brackets around it aside, is a part as well.
    """
    n = len(value)
    lower = value.lower()
    plain = lower.translate(_LEET)
    brute = math.log10(_alphabet(value))
    cost = [0.0] + [math.inf] * n
    dates = {}
    for i in range(n):
        m = _DATE.match(value, i)
        if m:
            dates[i] = m.end()
    for i in range(n):
        here = cost[i]

        def reach(j: int, price: float) -> None:
            # a part after another costs its place in the split as well
            price = here + price + (0.3 if i else 0.0)
            if price < cost[j]:
                cost[j] = price

        if here + brute < cost[i + 1]:
            cost[i + 1] = here + brute
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(lower[i:j])
            leet = rank is None
            if leet:
                rank = _RANK.get(plain[i:j])
            if rank:
                cased = 0.3 * (value[i:j] != lower[i:j])
                reach(j, math.log10(rank + 1) + cased + 0.6 * leet)
        if i in dates:
            reach(dates[i], 2.1 if dates[i] - i == 4 else 4.3)
        # repeats of a unit of up to eight characters
        for unit in range(1, min(8, (n - i) // 2) + 1):
            j = i + unit
            while value[j:j + unit] == value[i:i + unit] and j + unit <= n:
                j += unit
            if j - i >= max(3, 2 * unit):
                reach(j, min(unit, 4) * brute + math.log10((j - i) // unit + 1))
        # runs of neighbouring code points, up or down
        if i + 2 < n and abs(step := ord(value[i + 1]) - ord(value[i])) == 1:
            step = ord(value[i + 1]) - ord(value[i])
            j = i + 2
            while j < n and ord(value[j]) - ord(value[j - 1]) == step:
                j += 1
            if j - i >= 3:
                reach(j, brute + math.log10(j - i))
        # walks over neighbouring keys
        j = i + 1
        while j < n and lower[j] in _NEAR.get(lower[j - 1], ()):
            j += 1
        if j - i >= 4:
            reach(j, 1.0 + 0.45 * (j - i))
    word = value.strip("<>{}[]()")
    if len(word) > 3 and _wordlike(word):
        others = n - len(word) + max(0, len(word) - LONGEST_WORD)
        return min(cost[n], UNLISTED + others * brute)
    return cost[n]


def rated(value: str) -> float:
    """The guess cost of a value of any length: of a long one that of its costliest piece, as none is cheaper as a whole."""
    price = 0.0
    for piece in dict.fromkeys(value[i:i + PIECE] for i in range(0, len(value), PIECE)):
        price = max(price, guess_cost(piece))
        if price >= FULL:
            break
    return price


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, kind, end) of the fixed shapes, by start, then kind."""
    found = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def find(text: str, costly: float = COSTLY) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, score), by start, then kind; base spans score 1."""
    base = base_spans(text)
    spans = [(start, place, kind, end, 1.0) for start, place, kind, end in base]
    if _HINT.search(text):
        taken = {}
        for pattern in _CONTEXTS:
            for m in pattern.finditer(text):
                start, end = m.span(m.lastindex)
                # what may end a sentence is not rated, but goes with the span
                value = text[start:end].rstrip(".,:!?)")
                if len(value) < SHORTEST or any(a <= start and start + len(value) <= b for a, _, _, b in base):
                    continue
                if _ordinary(value, text[start:end]):
                    continue
                price = rated(value)
                if price >= costly:
                    taken[start, end] = min(1.0, price / FULL)
        spans += [(a, len(KINDS), GUESSED, b, score) for (a, b), score in taken.items()]
    return [(kind, start, end, score) for start, _, kind, end, score in sorted(spans)]


_REFERENCE = re.compile(r"\$(?:[A-Za-z_]\w*+|\{\w++\})", re.A)
_BRACKETED = re.compile(r"[{\[(]+([A-Za-z_][A-Za-z_.-]*)[}\])]+", re.A)


def _ordinary(value: str, whole: str) -> bool:
    """``$NAME`` and ``${NAME}`` are references, and words in brackets stand for a value."""
    if not value.isprintable() or _REFERENCE.fullmatch(value):
        return True
    m = _BRACKETED.fullmatch(whole.rstrip(".,:!?"))
    return bool(m) and all(len(w) < 4 or _wordlike(w.lower()) for w in re.split("[_.-]", m[1]))


FOUND = T.StructType([T.StructField("spans", SPANS)])


def _arrow(found: list[list[tuple]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans] for spans in found])


def find_secrets(df: DataFrame, text: str = "text", costly: float = COSTLY, keep: list[str] | None = None) -> DataFrame:
    """``spans``: kind, start, end and score of every secret of each text, by start, then kind."""

    def make():
        return lambda texts: [[[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t, costly)] for t in texts]]

    return map_text(df, text, make, FOUND, keep)


def redact(df: DataFrame, text: str = "text", costly: float = COSTLY, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with every secret replaced by a mask; texts without one stay as they are, null included.

    Of an assignment the whole match goes, as its span says; overlapping spans become one mask.
    """
    names = df.columns
    clean = "__clean"
    fields = T.StructType([T.StructField(clean, T.StringType())])

    def make():
        return lambda texts: [[masked(t, [(a, b) for _, a, b, _ in find(t, costly)], mask) for t in texts]]

    from pyspark.sql import functions as F

    done = map_text(df.withColumn("__source", F.col(f"`{text}`")), "__source", make, fields)
    col = F.when(F.col(f"`{text}`").isNotNull(), F.col(clean)).alias(text)
    return done.select(*[col if c == text else F.col(f"`{c}`") for c in names])


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """``text`` with the union of ``spans`` replaced, one mask per stretch."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text
