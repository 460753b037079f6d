"""String helpers that follow Python's text rules inside JVM expressions."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf


def strip(c: Column) -> Column:
    """Trim all whitespace, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def string_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(values: dict, key: Column) -> Column:
    """Entry of a literal map, null when missing."""
    return F.try_element_at(string_map(values), key)


def any_word(text: Column, words: list[str]) -> Column:
    """True where ``text`` contains one of ``words``: one regular expression for all."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a shell glob with ``*``, ``?`` and ``[...]``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[^" + body[1:] + "]" if body[0] == "!" else "[" + ("\\" if body[0] == "^" else "") + body + "]")
            i = close
        else:
            out.append(c if c.isalnum() or c in "_/ :" else "\\" + c)
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def matches_glob(c: Column, glob: str) -> Column:
    """Shell glob match; globs with stars only at their ends need no regular expression."""
    core = glob.strip("*")
    if core and not any(x in core for x in "*?["):
        head, tail = glob.startswith("*"), glob.endswith("*")
        if head and tail:
            return c.contains(core)
        return c.endswith(core) if head else c.startswith(core) if tail else c == core
    return c.rlike(glob_regex(glob))


def any_glob(c: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | matches_glob(c, g)
    return out


def first_glob(c: Column, globs: list[str]) -> Column:
    """First glob of the list that matches, else null."""
    return F.coalesce(*[F.when(matches_glob(c, g), F.lit(g)) for g in globs], F.lit(None).cast("string"))


def json_quote(c: Column) -> Column:
    """JSON string literal of ``c`` with ASCII escapes."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")

    def escape(ch: Column) -> Column:
        return F.when(ch.isin(*short), F.try_element_at(string_map(short), ch)).when(ch.rlike(r"^[\x20-\x7E]"), ch).otherwise(units(ch))

    # runs of plain characters stay together, every other character is a piece of its own
    pieces = F.regexp_extract_all(c, F.lit(r"[\x20-\x7E&&[^\"\\]]++|(?s:.)"), F.lit(0))
    escaped = F.array_join(F.transform(pieces, escape), "")
    plain = c.rlike(r"^[\x20-\x7E&&[^\"\\]]*\z")
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(escaped), F.lit('"'))


def name_grams(c: Column) -> Column:
    """Lower-case character trigrams plus the whole name."""
    s = F.lower(c)
    grams = F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: s.substr(i, F.lit(3))))
    return F.array_distinct(F.concat(F.coalesce(grams, F.array().cast("array<string>")), F.array(s)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def name_similarity(a: Column, b: Column) -> Column:
    return jaccard(name_grams(a), name_grams(b))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text; the key travels inside the function, so no plan, log or screen shows it."""
    @arrow_udf("string")
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts.to_pylist()], pa.string())

    return sign(message)


def last_wins(entries: Column) -> Column:
    """Map of (key, value) entries in which the last value of a repeated key counts."""
    def made(all_: Column) -> Column:
        clash = F.size(F.array_distinct(F.transform(all_, lambda e: e["key"]))) < F.size(all_)
        kept = F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))
        return F.map_from_entries(F.when(clash, kept).otherwise(all_))

    return let(entries, made)
