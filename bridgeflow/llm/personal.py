"""Personal data: patterns propose spans, check digits confirm them, context adjusts the score.

DataFrame operations only. Java's regular expressions find the matches; the text between two
matches, given by splitting on the same pattern, yields their places. Four kinds are always
reported when their rule holds (email, ip, card, phone). Two more start from a score that check
digits and words near the match move, and are reported from a threshold on: iban (mod-97) and
national_id (nine digits grouped 3-2-4).

Null and empty texts have no spans. Places count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
#: Same matches as the plain patterns: a match can only begin where a run of its first characters
#: begins or where the last match ended, and runs never need to be given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words near a match, and how far they move its score.
CONTEXT = {
    "iban": r"(?i)\b(iban|account|konto|cuenta|compte|bank|swift|bic)\b",
    "national_id": r"(?i)\b(ssn|social security|tax id|taxpayer|national id|identity)\b",
}
AGAINST = r"(?i)\b(invoice|order|serial|part|ticket|ref|reference|version|isbn)\b"
START_SCORE = {"iban": 0.6, "national_id": 0.3}
NEAR, FOR_IT, AGAINST_IT, THRESHOLD = 40, 0.4, 0.3, 0.5
BLOCK = 128


def _running(items: Column, start: Column) -> Column:
    """Sum of ``start`` and all items before each one."""
    state = F.struct(F.expr("array()").cast("array<int>").alias("out"), start.cast("int").alias("at"))
    return F.aggregate(items, state, lambda s, v: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + v).alias("at")))["out"]


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """``df`` with one array of (start, found) per name: all matches, leftmost and without overlap.

    ``patterns`` gives, by name, a cheap necessary condition and the pattern. Every step is a column
    of its own, so that no expression is evaluated twice; running sums go by blocks, which keeps
    them near linear in the number of matches.
    """
    col = lambda kind, name: F.col(f"__{kind}_{name}")
    none = F.expr("array()")
    step = lambda kind, name, make: df.withColumns({f"__{kind}_{n}": make(n) for n in name})
    names = list(patterns)
    df = step("found", names, lambda n: F.when(patterns[n][0], F.regexp_extract_all(F.col(text), F.lit(patterns[n][1]), F.lit(0))).otherwise(none.cast("array<string>")))
    some = lambda n: F.size(col("found", n)) > 0
    df = step("gap", names, lambda n: F.when(some(n), F.transform(F.split(F.col(text), patterns[n][1], -1), F.length)))
    df = step("long", names, lambda n: F.when(some(n), F.zip_with(F.slice(col("gap", n), 1, F.size(col("found", n))), col("found", n), lambda g, m: g + F.length(m))))
    df = step("block", names, lambda n: F.when(some(n), F.transform(
        F.sequence(F.lit(0), F.floor((F.size(col("long", n)) - 1) / BLOCK).cast("int")), lambda b: F.slice(col("long", n), b * BLOCK + 1, F.lit(BLOCK)))))
    df = step("before", names, lambda n: F.when(some(n), _running(F.transform(col("block", n), lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y)), F.lit(0))))
    df = step("start", names, lambda n: F.when(some(n), F.flatten(F.zip_with(col("block", n), col("before", n), _running))))
    df = step("place", names, lambda n: F.when(some(n), F.zip_with(col("start", n), F.slice(col("gap", n), 1, F.size(col("start", n))), lambda s, g: s + g)))
    made = {n: F.when(some(n), F.zip_with(col("place", n), col("found", n), lambda s, m: F.struct(s.alias("start"), m.alias("found"))))
            .otherwise(none.cast("array<struct<start:int,found:string>>")) for n in names}
    spent = [f"__{kind}_{n}" for kind in ("found", "gap", "long", "block", "before", "start", "place") for n in names]
    return df.withColumns(made).drop(*spent)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second one from the right doubled, is a multiple of ten."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d: d.cast("int"))
    total = F.aggregate(
        F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def mod97(found: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as numbers, leaves 1 modulo 97."""
    plain = F.regexp_replace(found, r"\x20", "")
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(moved, F.lit(0), lambda r, c: F.when(c.between("0", "9"), (r * 10 + value(c)) % 97).otherwise((r * 100 + value(c)) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        small = lambda part: (F.length(F.regexp_replace(part, "^0+(?=[0-9])", "")) <= 3) & (F.substring(F.regexp_replace(part, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255)
        return F.forall(F.split(found, r"\."), small)
    if kind == "card":
        digits = _digits(found)
        # a run that is too long is not split at all
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def _spans(text: Column, kind: str, found: Column) -> Column:
    valid = F.filter(found, lambda m: _valid(kind, m["found"]))

    def span(m: Column) -> Column:
        end = m["start"] + F.length(m["found"])
        if kind in KINDS:
            score = F.lit(1.0)
        else:
            before = F.greatest(m["start"] - NEAR, F.lit(0))
            near = F.substring(text, before + 1, end - before + NEAR)
            score = F.lit(START_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), FOR_IT).otherwise(0.0) - F.when(near.rlike(AGAINST), AGAINST_IT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), end.alias("end"), score.alias("score"))

    spans = F.transform(valid, span)
    return spans if kind in KINDS else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def find_personal(df: DataFrame, text: str = "text") -> DataFrame:
    """``spans`` (kind, start, end, score) of the personal data of each text, by kind, then start; a column of that name is replaced."""
    plain = df.withColumn("__plain", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    plain = plain.withColumn("__digit", F.col("__plain").rlike("[0-9]")).withColumn("__at", F.col("__plain").contains("@"))
    needs = {kind: F.col("__at") if kind == "email" else F.col("__digit") for kind in PATTERNS}
    found = with_matches(plain, "__plain", {f"__m_{kind}": (needs[kind], pattern) for kind, pattern in PATTERNS.items()})
    spans = F.concat(*[_spans(F.col("__plain"), kind, F.col(f"__m_{kind}")) for kind in PATTERNS])
    return found.withColumn("spans", spans).drop("__plain", "__digit", "__at", *[f"__m_{kind}" for kind in PATTERNS])


def redact(df: DataFrame, text: str = "text", mask: str = "[PERSONAL]") -> DataFrame:
    """The rows of ``df`` with all spans of their text masked; overlapping spans share a mask, null texts stay null."""
    found = find_personal(df.select("*", F.col(f"`{text}`").alias("__t")).withColumnRenamed("spans", "__held") if "spans" in df.columns else df.withColumn("__t", F.col(f"`{text}`")), "__t")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(
        F.when(x["a"] >= s["at"], F.concat(s["out"], F.substring(F.col("__t"), s["at"] + 1, x["a"] - s["at"]), F.lit(mask))).otherwise(s["out"]).alias("out"),
        F.greatest(s["at"], x["b"]).alias("at"))
    done = F.aggregate(ordered, state, step, lambda s: F.concat(s["out"], F.substring(F.col("__t"), s["at"] + 1, F.length("__t"))))
    out = found.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(F.col("__t"))).drop("__t", "spans")
    return out.withColumnRenamed("__held", "spans") if "spans" in df.columns else out
