"""Queries of field mappings, envelopes, plans and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import mapping as mp
from ..operators import transform as tr
from ..operators.mapping import FieldMapping as M
from . import lenses as ln
from .base import Suite

suite = Suite()
SECRET = b"change-me"


@suite.query("apply_mapping", """
SELECT o_orderkey AS id, o_custkey::VARCHAR AS customer, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS amount,
  o_totalprice::BIGINT AS whole, o_orderpriority, 'lens' AS _ic_source, 'host' AS _ic_hostname, '1' AS _ic_pid, 't' AS _ic_ingested_at
FROM (SELECT * REPLACE (trunc(o_totalprice) AS o_totalprice) FROM orders)""")
def _(t):
    price = F.expr("floor(o_totalprice)").cast("double")
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", price).alias("price"),
                           price.alias("total"), F.col("o_orderpriority"))
    post = tr.RecordConverter().add_step("enrich", lambda d: tr.enrich_provenance(
        d, source="lens", ingested_at=F.lit("t"), hostname="host", pid="1"))
    return mp.apply_mapping(rows, [M("o_orderkey", "id"), M("o_custkey", "customer", "cast:str"), M("price", "amount"),
                                   M("total", "whole", "cast:int"), M("absent", "gone")], post=post)


@suite.query("map_direct_rename", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders")
def _(t):
    return mp.apply_mapping(t.orders.select("o_orderkey", "o_orderstatus"),
                            [M("o_orderkey", "id", "direct"), M("o_orderstatus", "state", "rename:x")])


@suite.query("map_cast", r"""
SELECT event_id, CASE WHEN event_type = 'view' THEN user_id WHEN event_type = 'click' THEN -user_id ELSE 0 END::BIGINT AS i,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN CASE event_type WHEN 'click' THEN -user_id WHEN 'view' THEN user_id ELSE user_id + 0.5 END ELSE 0 END::DOUBLE AS f,
  event_type <> 'error' AS b, CASE WHEN value < 10 THEN 'True' ELSE 'False' END AS s, trunc(value)::BIGINT AS n, value::VARCHAR AS u
FROM events""")
def _(t):
    user, kind = F.col("user_id"), F.col("event_type")
    text = (F.when(kind == "view", F.concat(F.lit(" "), user, F.lit("\n"))).when(kind == "click", F.concat(F.lit("-"), user))
            .when(kind == "signup", F.concat(user, F.lit(".5"))).when(kind == "purchase", F.lit("false")).otherwise(""))
    rows = t.events.select("event_id", text.alias("a"), text.alias("b_"), text.alias("c"), (F.col("value") < 10).alias("d"),
                           F.col("value").alias("e"), F.col("value").alias("g"))
    return mp.apply_mapping(rows, [M("a", "i", "cast:int"), M("b_", "f", "cast:float"), M("c", "b", "cast:bool"),
                                   M("d", "s", "cast:str"), M("e", "n", "cast:int"), M("g", "u", "cast:other")])


@suite.query("map_extract", """
SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS kind, NULL::VARCHAR AS missing, NULL::VARCHAR AS plain FROM events""")
def _(t):
    body = F.parse_json(F.concat(F.lit('{"p": '), F.col("props"), F.lit("}")))
    rows = t.events.select("event_id", body.alias("v"), F.struct(F.struct(F.col("event_type").alias("y")).alias("x")).alias("s"),
                           F.struct(F.lit(1).alias("x")).alias("s2"), F.col("event_type").alias("txt"))
    out = mp.apply_mapping(rows, [M("v", "k", "extract:p.k"), M("s", "kind", "extract:x.y"), M("s2", "missing", "extract:x.y.z"),
                                  M("txt", "plain", "extract:a")])
    return out.withColumn("k", F.try_variant_get("k", "$", "long"))


@suite.query("map_flatten", """
SELECT event_id, user_id AS m_user, event_type AS m_kind, value AS v FROM events""")
def _(t):
    rows = t.events.select("event_id", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("s"), "value")
    return mp.apply_mapping(rows, [M("s", "m", "flatten"), M("value", "v", "flatten")])


@suite.query("map_enrich_literal", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'bridge' END AS origin FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("s"))
    return mp.apply_mapping(rows, [M("s", "origin", "enrich:bridge")])


@suite.query("map_passthrough", """
SELECT o_orderkey AS id, o_orderpriority AS state, o_totalprice AS total FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("state"), F.col("o_totalprice").alias("total"))
    return mp.apply_mapping(rows, [M("o_orderkey", "id"), M("o_orderstatus", "state")])


@suite.query("map_aliased_sources", ln.with_(ln.MESSAGES) + """
SELECT event_id, severity AS priority_label, text AS body_text, user_id AS "user.id" FROM messages""")
def _(t):
    rows = ln.messages(t).select("event_id", F.col("severity").alias("lvl"), F.col("text").alias("msg"), F.col("user_id").alias("uid"))
    pre = tr.RecordConverter.from_spec({"normalize_fields": True})
    return mp.apply_mapping(rows, [M("lvl", "priority_label"), M("msg", "body_text")], pre=pre)


@suite.query("envelope_mqtt_kafka", ln.with_(ln.MESSAGES) + """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS "key", 'mqtt' AS source,
  '{' || CASE WHEN event_type = 'error' THEN '' ELSE '"topic":"' || event_type || '",' END || '"user_id":' || user_id || '}' AS value
FROM messages""")
def _(t):
    rows = ln.messages(t).select("event_id", F.when(~F.col("is_error"), F.col("event_type")).alias("topic"), "user_id")
    return mp.mqtt_to_kafka(rows, ["topic", "user_id"]).select(
        "event_id", "key", F.col("value").cast("string").alias("value"), F.col("headers")["source"].alias("source"))


@suite.query("envelope_kafka_rest", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN props->>'$.k' END AS k, CASE WHEN event_type = 'error' THEN 'error!' END AS data FROM events""")
def _(t):
    raw = F.when(F.col("event_type") == "error", F.lit("error!")).otherwise(F.col("props"))
    out = mp.kafka_to_rest(t.events.select("event_id", F.encode(raw, "UTF-8").alias("value")))
    return out.select("event_id", F.try_variant_get("payload", "$.k", "string").alias("k"), F.try_variant_get("payload", "$.data", "string").alias("data"))


@suite.query("envelope_mavlink_grpc", """
SELECT l_orderkey AS sys_id, l_linenumber AS comp_id, 0 AS msg_id, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_partkey END AS "timestamp",
  '{"l_suppkey":' || l_suppkey || ',"l_linestatus":"' || l_linestatus || '"}' AS fields FROM lineitem""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("sys_id"), F.col("l_linenumber").alias("comp_id"),
                             F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("time_usec"), "l_suppkey", "l_linestatus")
    return mp.mavlink_to_grpc(rows).withColumn("fields", F.to_json("fields"))


@suite.query("envelope_rest_bytes", """
SELECT event_id, hex('{"user_id":' || user_id || ',"kind":"' || event_type || '"}') AS body FROM events""")
def _(t):
    rows = t.events.select("event_id", "user_id", F.col("event_type").alias("kind"))
    return mp.rest_to_bytes(rows, keep=["event_id"]).select("event_id", F.hex("body").alias("body"))


@suite.query("envelope_file_kafka", "SELECT doc_id, sha256(text) AS value, 'file' AS source FROM documents")
def _(t):
    out = mp.file_to_kafka(t.documents.select("doc_id", F.col("text").alias("line")))
    return out.select("doc_id", F.sha2("value", 256).alias("value"), F.col("headers")["source"].alias("source"))


LOOKUP = " ".join(f"WHEN p.protocol = '{a}' AND c.protocol = '{b}' THEN '{n}'" for (a, b), (n, _) in mp.ENVELOPES.items())


@suite.query("envelope_lookup", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS) + f"""
SELECT producer_id, consumer_id, CASE {LOOKUP} END AS envelope
FROM links JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id""")
def _(t):
    ends = mp._two_ends(ln.links(t), ln.nodes(t), ["protocol"])
    return ends.select("producer_id", "consumer_id", mp.envelope_name(F.col("p_protocol"), F.col("c_protocol")).alias("envelope"))


def sql_grams(x: str) -> str:
    return (f"list_distinct(list_concat(CASE WHEN length({x}) >= 3 THEN list_transform(range(1, length({x}) - 1), "
            f"lambda g: substring(lower({x}), g, 3)) ELSE []::VARCHAR[] END, [lower({x})]))")


TYPE_ROWS = ", ".join(f"('{a}', '{b}', {s}::DOUBLE)" for a, row in fixed.TYPE_COMPAT.items() for b, s in zip(fixed.LOGICAL_TYPES, row))

# field scores per distinct pair of contracts, then the greedy walk over source fields
ALIGN = f"""type_compat(src, dst, s) AS (VALUES {TYPE_ROWS}),
ends AS (
  SELECT producer_id, consumer_id, p.names AS sn, p.types AS st, c.names AS dn, c.types AS dt
  FROM links JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id),
cpairs AS (SELECT row_number() OVER () AS cp, * FROM (SELECT DISTINCT sn, st, dn, dt FROM ends)),
cells AS (
  SELECT cp, i, j, sn[i] AS a, dn[j] AS b, st[i] AS ta, dt[j] AS tb
  FROM (SELECT *, unnest(range(1, len(sn) + 1)) AS i FROM cpairs) x, unnest(range(1, len(dn) + 1)) AS u(j)),
scored AS (
  SELECT cp, i, j, 0.6::DOUBLE * (len(list_intersect(ga, gb))::DOUBLE / (len(ga) + len(gb) - len(list_intersect(ga, gb)))) + 0.4::DOUBLE * coalesce(s, 0.2) AS s
  FROM (SELECT *, {sql_grams('a')} AS ga, {sql_grams('b')} AS gb FROM cells) LEFT JOIN type_compat ON src = ta AND dst = tb),
score_rows AS (SELECT cp, i, list(s ORDER BY j) AS row FROM scored GROUP BY cp, i),
walk AS (
  SELECT cp, 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS tg, []::DOUBLE[] AS conf FROM cpairs
  UNION ALL
  SELECT cp, i, CASE WHEN m > 0 THEN list_append(used, list_position(masked, m)::BIGINT) ELSE used END,
    list_append(tg, CASE WHEN m > 0 THEN list_position(masked, m)::BIGINT ELSE 0 END), list_append(conf, m)
  FROM (SELECT *, list_max(masked) AS m FROM (
    SELECT w.cp, r.i, w.used, w.tg, w.conf,
      list_transform(r.row, lambda s, j: CASE WHEN list_contains(w.used, j) OR s <= 0.3 THEN -1.0 ELSE s END) AS masked
    FROM walk w JOIN score_rows r ON r.cp = w.cp AND r.i = w.i + 1))),
aligned AS (
  SELECT c.*, tg, conf, list_filter(range(1, len(tg) + 1), lambda i: tg[i] > 0) AS hits
  FROM cpairs c JOIN walk w ON w.cp = c.cp AND w.i = len(c.sn))"""
MAPPING_TEXT = """array_to_string(list_transform(hits, lambda i: sn[i] || '>' || dn[tg[i]] || '>' ||
    CASE WHEN st[i] = dt[tg[i]] THEN 'direct' ELSE 'cast:' || dt[tg[i]] END || '>' || round(conf[i], 6)), ',')"""


def mapping_text(c):
    return F.array_join(F.transform(c, lambda m: F.concat_ws(
        ">", m["src_field"], m["dst_field"], m["transform"], F.round(m["confidence"], 6).cast("string"))), ",")


PLAN_SQL = ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, ALIGN, recursive=True)


@suite.query("plan_adapters", PLAN_SQL + f"""
SELECT producer_id, consumer_id, p.protocol AS producer_protocol, c.protocol AS consumer_protocol, {MAPPING_TEXT} AS mappings,
  CASE {LOOKUP} END AS envelope, list_contains(sn, 'x') OR list_contains(st, 'object') AS flatten,
  CASE WHEN CASE {LOOKUP} END IS NOT NULL THEN CASE WHEN len(hits) > 0 THEN 'envelope+mapping' ELSE 'envelope' END
    WHEN len(hits) > 0 THEN 'mapping' ELSE 'same' END AS kind,
  coalesce(p.rate, 0) > 1.5 * coalesce(c.rate, p.rate, 0) AS limited
FROM ends JOIN aligned USING (sn, st, dn, dt) JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id""")
def _(t):
    return mp.plan_adapters(ln.links(t), ln.nodes(t)).select(
        "producer_id", "consumer_id", "producer_protocol", "consumer_protocol", mapping_text(F.col("mappings")).alias("mappings"),
        "envelope", "flatten", "kind", "limited")


ALIAS = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.FIELD_ALIASES.items()) + " ELSE x END"
SAMPLED = f"""samples AS (
  SELECT producer_id, consumer_id, {MAPPING_TEXT} AS mappings, CASE {LOOKUP} END AS env, sn[1:5] AS f0,
    list_transform(st[1:5], lambda x: CASE x WHEN 'int' THEN '42' WHEN 'float' THEN '3.14' WHEN 'bool' THEN 'True' ELSE 'test' END) AS v0,
    list_transform(sn, lambda x: {ALIAS}) AS src, dn, st, dt, tg, hits,
    coalesce(p.rate, 0) > 1.5 * coalesce(c.rate, p.rate, 0) AND c.rate < 1 AS starved
  FROM ends JOIN aligned USING (sn, st, dn, dt) JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id),
texts AS (SELECT *, '{{' || array_to_string(list_transform(range(1, len(f0) + 1), lambda i: '"' || f0[i] || '":' || CASE v0[i] WHEN 'test' THEN '"test"' WHEN 'True' THEN 'true' ELSE v0[i] END), ',') || '}}' AS body,
  '{{' || array_to_string(list_transform(list_sort(list_filter(range(1, len(f0) + 1), lambda i: f0[i] NOT IN ('sys_id', 'comp_id', 'msg_id', 'time_usec')).list_transform(lambda i: f0[i] || chr(1) || v0[i])),
    lambda x: '"' || split_part(x, chr(1), 1) || '":' || CASE split_part(x, chr(1), 2) WHEN 'test' THEN '"test"' WHEN 'True' THEN 'true' ELSE split_part(x, chr(1), 2) END), ',') || '}}' AS rest_body FROM samples),
wrapped AS (SELECT *, CASE env WHEN 'mqtt_to_kafka' THEN ['key', 'value', 'headers'] WHEN 'file_to_kafka' THEN ['value', 'headers']
    WHEN 'mavlink_to_grpc' THEN ['sys_id', 'comp_id', 'msg_id', 'timestamp', 'fields'] WHEN 'rest_to_bytes' THEN CASE WHEN len(hits) = 0 THEN ['body'] ELSE f0 END ELSE f0 END AS f1,
  CASE env WHEN 'mqtt_to_kafka' THEN ['unknown', body, '{{"source":"mqtt"}}'] WHEN 'file_to_kafka' THEN [body, '{{"source":"file"}}']
    WHEN 'mavlink_to_grpc' THEN ['0', '0', '0', '0', rest_body] WHEN 'rest_to_bytes' THEN CASE WHEN len(hits) = 0 THEN [body] ELSE v0 END ELSE v0 END AS v FROM texts),
named AS (SELECT *, list_transform(f1, lambda x: {ALIAS}) AS f FROM wrapped),
parted AS (SELECT *, list_filter(hits, lambda i: list_contains(f, src[i])) AS moved,
  list_filter(range(1, len(f) + 1), lambda i: NOT list_contains(list_transform(hits, lambda h: src[h]), f[i])) AS rest FROM named),
valued AS (SELECT *, list_transform(moved, lambda i: v[list_position(f, src[i])]) AS mv FROM parted),
written AS (SELECT *, CASE WHEN len(hits) = 0 THEN list_transform(range(1, len(f1) + 1), lambda i: f1[i] || '=' || v[i]) ELSE list_concat(
  list_transform(list_filter(range(1, len(moved) + 1), lambda m: NOT list_contains(list_transform(rest, lambda r: f[r]), dn[tg[moved[m]]])),
    lambda m: dn[tg[moved[m]]] || '=' || CASE WHEN st[moved[m]] = dt[tg[moved[m]]] THEN mv[m]
      WHEN dt[tg[moved[m]]] = 'int' THEN CASE mv[m] WHEN '3.14' THEN '3' WHEN '42' THEN '42' ELSE '0' END
      WHEN dt[tg[moved[m]]] = 'float' THEN CASE mv[m] WHEN '42' THEN '42.0' WHEN '3.14' THEN '3.14' ELSE '0.0' END ELSE mv[m] END),
  list_transform(rest, lambda r: f[r] || '=' || v[r])) END AS output FROM valued)"""


def _output_text():
    return F.array_join(F.transform("output", lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@suite.query("validate_plans", PLAN_SQL + f", {SAMPLED} SELECT producer_id, consumer_id, NOT coalesce(starved, false) AS valid, CASE WHEN NOT coalesce(starved, false) THEN array_to_string(output, ',') END AS output FROM written")
def _(t):
    plans, contracts = mp.plan_adapters(ln.links(t), ln.nodes(t), apart=True)
    checked = mp.validate_plans(plans, True, contracts)
    return checked.select("producer_id", "consumer_id", "valid", _output_text().alias("output"))


@suite.query("synthesis_events", PLAN_SQL + f", {SAMPLED} SELECT 'synthesis_failed' AS type, producer_id, consumer_id FROM written WHERE starved")
def _(t):
    plans, contracts = mp.plan_adapters(ln.links(t), ln.nodes(t), apart=True)
    return mp.synthesis_events(mp.validate_plans(plans, True, contracts))


def sql_hmac(message: str, key: bytes = SECRET) -> str:
    block = key.ljust(64, b"\0")
    blob = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in block) + "'::BLOB"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({message}))))"


@suite.query("sign_provenance", f"""
SELECT o_orderkey, {sql_hmac("'p' || o_orderkey || ':c' || o_custkey || ':0.1.0:' || epoch_us(o_orderdate) // 1000000")} AS provenance FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", F.concat(F.lit("p"), F.col("o_orderkey")).alias("p"), F.concat(F.lit("c"), F.col("o_custkey")).alias("c"),
                           F.lit("0.1.0").alias("v"), F.floor(ln.epoch_micros(F.col("o_orderdate")) / 1000000).alias("at"))
    return mp.sign_provenance(rows, mp.provenance_message("p", "c", "v", "at"), SECRET).select("o_orderkey", "provenance")


@suite.query("verify_provenance", "SELECT o_orderkey, o_orderstatus <> 'F' AS verified FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("string").alias("body"))
    signed = mp.sign_provenance(rows, F.col("body"), SECRET)
    forged = signed.withColumn("body", F.when(F.col("o_orderstatus") == "F", F.concat("body", F.lit("0"))).otherwise(F.col("body")))
    return mp.verify_provenance(forged, F.col("body"), SECRET).select("o_orderkey", "verified")


@suite.query("select_backpressure", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS) + """
SELECT producer_id, consumer_id, coalesce(p.rate, 0) > 1.5 * coalesce(c.rate, p.rate, 0) AS limited,
  CASE WHEN coalesce(p.rate, 0) > 1.5 * coalesce(c.rate, p.rate, 0) THEN c.rate END AS limit_hz
FROM links JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id""")
def _(t):
    ends = mp._two_ends(ln.links(t), ln.nodes(t), ["rate"])
    return mp.select_backpressure(ends, "p_rate", "c_rate").select("producer_id", "consumer_id", "limited", "limit_hz")
