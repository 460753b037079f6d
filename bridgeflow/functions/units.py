"""Unit converters; every one is a Column expression without time-zone dependence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import lookup, strip


def bytes_to_human(c: Column) -> Column:
    size = c.try_cast("double")
    unit = lambda power, suffix: F.concat(
        F.call_function("format_number", size / float(1024 ** power), F.lit("0.00")), F.lit(" " + suffix))
    ladder = F.when(F.abs(size) < 1024.0, unit(0, "B"))
    for power, suffix in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        ladder = ladder.when(F.abs(size) < float(1024 ** (power + 1)), unit(power, suffix))
    return F.when(size.isNull(), c.cast("string")).otherwise(ladder.otherwise(unit(5, "PB")))


def celsius_to_fahrenheit(c: Column) -> Column:
    return F.bround(c.try_cast("double") * 9 / 5 + 32, 4)


def fahrenheit_to_celsius(c: Column) -> Column:
    return F.bround((c.try_cast("double") - 32) * 5 / 9, 4)


def unix_to_iso(c: Column) -> Column:
    """Epoch seconds to ``YYYY-MM-DDTHH:MM:SS[.ffffff]+00:00``; other values become their text."""
    seconds = c.try_cast("double")
    micros = F.bround(F.when(seconds.between(-62135596800.0, 253402300799.0), seconds) * 1000000.0).cast("long")
    # a zone-less timestamp prints the same in every session time zone, without trailing zeros
    text = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string")
    full = F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
    return F.coalesce(F.concat(F.replace(full, F.lit(" "), F.lit("T")), F.lit("+00:00")), c.cast("string"), F.lit("None"))


def iso_to_unix(c: Column) -> Column:
    """ISO text to epoch seconds; naive text is UTC, numeric text is itself, anything else 0."""
    s = F.replace(c.cast("string"), F.lit("Z"), F.lit("+00:00"))
    # a failed parse is slow, so only text of about the right form is tried
    offset = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(s.contains("T"), F.try_to_timestamp(offset, F.lit("yyyy-M-d'T'H:m:sXXX")))
    naive = F.when(s.contains(" "), F.try_to_timestamp(F.concat(s, F.lit("+00:00")), F.lit("yyyy-M-d H:m:sXXX")))
    return F.coalesce(F.unix_micros(F.coalesce(zoned, naive)) / 1000000.0, s.try_cast("double"), F.lit(0.0))


def severity_level(c: Column, trim: bool = False) -> Column:
    word = F.lower(F.coalesce(c.cast("string"), F.lit("None")))
    return F.coalesce(lookup(fixed.SEVERITY_LEVELS, strip(word) if trim else word), F.lit(fixed.DEFAULT_SEVERITY))


def normalize_severity(c: Column) -> Column:
    labels = F.array(*[F.lit(x) for x in fixed.SEVERITY_LABELS])
    return F.element_at(labels, severity_level(c, trim=True) + 1)


# a null result of these two means the value does not convert and stays as it is
CONVERTERS = {
    "bytes_to_human": bytes_to_human,
    "c_to_f": celsius_to_fahrenheit,
    "f_to_c": fahrenheit_to_celsius,
    "unix_to_iso": unix_to_iso,
    "iso_to_unix": iso_to_unix,
    "normalize_severity": normalize_severity,
}
