"""Queries of the record transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import units
from ..operators import transform as tr
from . import lenses as ln
from .base import Suite, Tables

suite = Suite()


def _stamp() -> dict:
    """Provenance with literals, so that two runs agree."""
    return dict(ingested_at=F.lit("2024-02-01T00:00:00+00:00"), hostname="host", pid="1")


def _records(t: Tables):
    """Messages under producer-side field names."""
    return ln.messages(t).select(
        "event_id", F.col("t").alias("ts"), F.col("user_id").alias("UID"), F.col("severity").alias("lvl"),
        F.col("text").alias("msg"), F.col("value").alias("temp_c"))


@suite.query("normalize_fields", ln.with_(ln.MESSAGES) + """
SELECT event_id, t AS "timestamp", user_id AS "user.id", severity, text AS message, value AS temperature_celsius
FROM messages""")
def _(t):
    return tr.normalize_fields(_records(t))


@suite.query("normalize_map", ln.with_(ln.MESSAGES) + """
SELECT event_id, text AS message, event_type AS kept, severity AS custom FROM messages""")
def _(t):
    made = ln.messages(t).select("event_id", tr.normalize_map(F.create_map(
        F.lit("MSG"), F.lit("overwritten"), F.lit("kind"), F.col("event_type"), F.lit("body"), F.col("text"),
        F.lit("sevx"), F.col("severity")), {"sevx": "custom"}).alias("m"))
    return made.select("event_id", F.col("m")["message"].alias("message"), F.col("m")["kind"].alias("kept"),
                       F.col("m")["custom"].alias("custom"))


@suite.query("flatten_nested", ln.with_(ln.MESSAGES) + """
SELECT event_id, user_id AS "who.id", bridge_id AS "who.bridge.id", (props->>'$.k')::BIGINT AS "meta.k",
  value AS "readings[0].v", value * 2 AS "readings[1].v"
FROM messages""")
def _(t):
    m = ln.messages(t)
    nested = m.select(
        "event_id", F.struct(F.col("user_id").alias("id"), F.struct(F.col("bridge_id").alias("id")).alias("bridge")).alias("who"),
        F.from_json("props", "k bigint").alias("meta"),
        F.array(F.struct(F.col("value").alias("v")), F.struct((F.col("value") * 2).alias("v"))).alias("readings"))
    return tr.flatten_nested(nested, arrays=True)


@suite.query("flatten_json", ln.with_(ln.MESSAGES) + """
SELECT event_id, user_id::VARCHAR AS "a", (props->>'$.k') AS "b.p.k", event_type AS "b.e" FROM messages""")
def _(t):
    doc = F.concat(F.lit('{"a": '), F.col("user_id"), F.lit(', "b": {"p": '), F.col("props"), F.lit(', "e": "'),
                   F.col("event_type"), F.lit('", "none": {}}}'))
    flat = ln.messages(t).select("event_id", tr.flatten_json(doc).alias("m"))
    return flat.select("event_id", *[F.col("m").getItem(k).alias(k) for k in ("a", "b.p.k", "b.e")])


@suite.query("unflatten_dotted", """
SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS rf FROM lineitem""")
def _(t):
    dotted = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("key.part"), F.col("l_suppkey").alias("key.supplier"),
        F.col("l_returnflag").alias("flag.state.rf"))
    nested = tr.unflatten_dotted(dotted)
    return nested.select("l_orderkey", "l_linenumber", "key.part", "key.supplier", "flag.state.rf")


@suite.query("bytes_to_human", f"""
SELECT l_orderkey, l_linenumber, {ln.sql_human('l_extendedprice')} AS small,
  {ln.sql_human('l_extendedprice * l_partkey * l_partkey')} AS large, l_returnflag AS text FROM lineitem""")
def _(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", units.bytes_to_human(price).alias("small"),
        units.bytes_to_human(price * F.col("l_partkey") * F.col("l_partkey")).alias("large"),
        units.bytes_to_human(F.col("l_returnflag")).alias("text"))


@suite.query("celsius_to_fahrenheit", "SELECT event_id, round_even(value * 9 / 5 + 32, 4) AS f FROM events")
def _(t):
    return t.events.select("event_id", units.celsius_to_fahrenheit(F.col("value")).alias("f"))


@suite.query("fahrenheit_to_celsius", "SELECT event_id, round_even((value - 32) * 5 / 9, 4) AS c FROM events")
def _(t):
    return t.events.select("event_id", units.fahrenheit_to_celsius(F.col("value")).alias("c"))


@suite.query("unix_to_iso", ln.with_(ln.MESSAGES) + f"""
SELECT event_id, {ln.sql_iso('t')} AS fine, {ln.sql_iso('(t // 1000000 * 1000000)')} AS coarse, event_type AS text
FROM messages""")
def _(t):
    return ln.messages(t).select(
        "event_id", units.unix_to_iso(F.col("t") / 1000000.0).alias("fine"),
        units.unix_to_iso(F.floor(F.col("t") / 1000000)).alias("coarse"), units.unix_to_iso(F.col("event_type")).alias("text"))


@suite.query("iso_to_unix", ln.with_(ln.MESSAGES) + """
SELECT event_id, (t // 1000000)::DOUBLE AS zulu, (t // 1000000 - 5400)::DOUBLE AS zoned,
  (t // 1000000)::DOUBLE AS naive, user_id::DOUBLE AS numeric, 0.0::DOUBLE AS bad FROM messages""")
def _(t):
    second = F.date_trunc("second", "ts")
    text = lambda pattern: F.date_format(second, pattern)
    iso = units.iso_to_unix
    return t.events.select(
        "event_id", iso(F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("zulu"),
        iso(F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))).alias("zoned"),
        iso(text("yyyy-MM-dd HH:mm:ss")).alias("naive"), iso(F.col("user_id").cast("string")).alias("numeric"),
        iso(F.col("event_type")).alias("bad"))


LABEL = f"{ln.sql_list(fixed.SEVERITY_LABELS)}[{ln.sql_level('severity')} + 1]"


@suite.query("normalize_severity", ln.with_(ln.MESSAGES) + f"""
SELECT event_id, {LABEL} AS label, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS other FROM messages""")
def _(t):
    padded = F.concat(F.lit("  "), F.upper("severity"), F.lit("\t"))
    return ln.messages(t).select("event_id", units.normalize_severity(padded).alias("label"),
                                 units.normalize_severity(F.col("event_type")).alias("other"))


@suite.query("convert_units", ln.with_(ln.MESSAGES) + f"""
SELECT event_id, {ln.sql_iso('(t // 1000000 * 1000000)')} AS "at", round_even(value * 9 / 5 + 32, 4) AS temp_c,
  {ln.sql_human('value * 5000')} AS size, {LABEL} AS severity, event_type FROM messages""")
def _(t):
    rows = ln.messages(t).select("event_id", F.floor(F.col("t") / 1000000).alias("at"), F.col("value").alias("temp_c"),
                                 (F.col("value") * 5000).alias("size"), "severity", "event_type")
    return tr.convert_units(rows, {
        "at": "unix_to_iso", "temp_c": "c_to_f", "size": "bytes_to_human", "severity": "normalize_severity",
        "event_type": "c_to_f", "absent": "c_to_f"})


@suite.query("keep_fields", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    return tr.keep_fields(t.lineitem, {"l_orderkey", "l_linenumber", "l_quantity", "absent"})


@suite.query("drop_fields", "SELECT * EXCLUDE (l_shipdate, l_tax, l_discount) FROM lineitem")
def _(t):
    return tr.drop_fields(t.lineitem, {"l_shipdate", "l_tax", "l_discount", "absent"})


@suite.query("filter_severity", ln.with_(ln.MESSAGES) + f"""
SELECT event_id, severity FROM messages WHERE {ln.sql_level('severity')} >= 3""")
def _(t):
    return tr.filter_severity(ln.messages(t).select("event_id", "severity"), "warning")


@suite.query("suppress_empty", """
SELECT o_orderkey, status, priority FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN '  ' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority ELSE '' END AS priority FROM orders)
WHERE coalesce(trim(status), '') <> '' OR coalesce(trim(priority), '') <> ''""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", None).when(F.col("o_orderstatus") == "O", "  ").otherwise(F.col("o_orderstatus"))
    rows = t.orders.select("o_orderkey", status.alias("status"),
                           F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).otherwise("").alias("priority"))
    return tr.suppress_empty(rows, ["status", "priority"])


@suite.query("suppress_noise", ln.with_(ln.MESSAGES) + """
SELECT event_id, text AS message FROM messages
WHERE NOT (contains(lower(text), 'heartbeat') OR contains(lower(text), 'alive') OR contains(lower(text), 'ping'))""")
def _(t):
    return tr.suppress_noise(ln.messages(t).select("event_id", F.col("text").alias("message")))


@suite.query("enrich_provenance", ln.with_(ln.MESSAGES) + """
SELECT event_id, '2024-02-01T00:00:00+00:00' AS _ic_ingested_at, 'host' AS _ic_hostname, '1' AS _ic_pid,
  'br-1' AS _ic_bridge_id, 'http://src' AS _ic_source, 'late' AS zone FROM messages""")
def _(t):
    return tr.enrich_provenance(ln.messages(t).select("event_id", F.lit("early").alias("zone")), "br-1", "http://src",
                                {"zone": "late"}, **_stamp())


CHAIN_SQL = ln.with_(ln.MESSAGES) + f"""
SELECT event_id, {ln.sql_iso('(t // 1000000 * 1000000)')} AS "timestamp", user_id AS "user.id", {LABEL} AS severity,
  text AS message, (props->>'$.k')::BIGINT AS "meta.k", '2024-02-01T00:00:00+00:00' AS _ic_ingested_at,
  'host' AS _ic_hostname, '1' AS _ic_pid, 'br-1' AS _ic_bridge_id, 'events' AS _ic_source
FROM messages WHERE {ln.sql_level('severity')} >= 3"""


def _nested_records(t: Tables):
    return ln.messages(t).select(
        "event_id", F.floor(F.col("t") / 1000000).alias("ts"), F.col("user_id").alias("uid"), F.col("severity").alias("lvl"),
        F.col("text").alias("msg"), F.from_json("props", "k bigint").alias("meta"), F.col("value").alias("internal"))


@suite.query("convert_chain", CHAIN_SQL + " AND (props->>'$.k')::BIGINT > 10")
def _(t):
    chain = (
        tr.RecordConverter()
        .add_step("normalize", tr.normalize_fields)
        .add_step("flatten", tr.flatten_nested, valid=lambda d: F.col("meta.k") > 10)
        .add_step("units", lambda d: tr.convert_units(d, {"timestamp": "unix_to_iso", "severity": "normalize_severity"}))
        .add_step("severity", lambda d: tr.filter_severity(d, "warning"))
        .add_step("noise", tr.suppress_noise)
        .add_step("empty", tr.suppress_empty)
        .add_step("drop", lambda d: tr.drop_fields(d, {"internal"}))
        .add_step("enrich", lambda d: tr.enrich_provenance(d, "br-1", "events", **_stamp()))
    )
    return chain.apply(_nested_records(t))


@suite.query("convert_from_spec", CHAIN_SQL)
def _(t):
    spec = {
        "enrich": {"bridge_id": "br-1", "source": "events", **_stamp()},
        "suppress_noise": True, "suppress_empty": True, "filter_severity": "warning",
        "unit_conversions": {"timestamp": "unix_to_iso", "severity": "normalize_severity"},
        "drop_fields": ["internal"], "flatten": True, "normalize_fields": True,
    }
    return tr.RecordConverter.from_spec(spec).apply(_nested_records(t))
