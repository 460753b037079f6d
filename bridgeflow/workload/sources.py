"""Queries of payload decoding, encoding and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import fixed
from ..sources import decode as dc
from ..sources import files as fl
from . import lenses as ln
from .base import Suite

suite = Suite()
PROTOCOL = f"{ln.sql_list(fixed.PROTOCOLS)}[user_id % 13 + 1]"


def _protocol(key: str = "user_id"):
    return F.element_at(F.array(*[F.lit(p) for p in fixed.PROTOCOLS]), (F.col(key) % 13 + 1).cast("int"))


@suite.query("decode_payload", ln.with_(ln.MESSAGES) + f"""
, raws AS (SELECT event_id, {PROTOCOL} AS protocol, event_type, props,
    CASE event_type WHEN 'view' THEN props WHEN 'click' THEN '[' || user_id || ']' ELSE '  ' || text || ' ' END AS raw FROM messages)
SELECT event_id, protocol, event_type IN ('view', 'click') AS decode_ok,
  CASE WHEN event_type = 'view' THEN props->>'$.k' END AS k,
  CASE WHEN event_type = 'click' THEN raw WHEN event_type = 'view' OR protocol IN ('file', 'socket') THEN NULL
    WHEN protocol = 'zeromq' THEN lower(hex(raw)) ELSE raw END AS data,
  CASE WHEN event_type NOT IN ('view', 'click') AND protocol IN ('file', 'socket') THEN trim(raw) END AS line FROM raws""")
def _(t):
    raw = (F.when(F.col("event_type") == "view", F.col("props"))
           .when(F.col("event_type") == "click", F.concat(F.lit("["), F.col("user_id"), F.lit("]")))
           .otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" "))))
    rows = ln.messages(t).select("event_id", _protocol().alias("protocol"), F.encode(raw, "UTF-8").alias("raw"))
    got = lambda path: F.try_variant_get("payload", path, "string")
    return dc.decode_payload(rows).select("event_id", "protocol", "decode_ok", got("$.k").alias("k"),
                                          got("$.data").alias("data"), got("$.line").alias("line"))


@suite.query("mqtt_topic_tag", ln.with_(ln.MESSAGES) + """
SELECT event_id, props->>'$.k' AS k, 'sensors/' || event_type AS _mqtt_topic FROM messages""")
def _(t):
    rows = ln.messages(t).select("event_id", F.encode("props", "UTF-8").alias("raw"), F.lit("mqtt").alias("protocol"),
                                 F.concat(F.lit("sensors/"), F.col("event_type")).alias("topic"))
    tagged = dc.mqtt_topic_tag(dc.decode_payload(rows))
    return tagged.select("event_id", F.try_variant_get("payload", "$.k", "string").alias("k"), "_mqtt_topic")


@suite.query("jsonl_source", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
  UNION ALL SELECT event_id, props FROM events UNION ALL SELECT event_id, '   ' FROM events)
SELECT doc_id, line[1] = '{' AS is_json, CASE WHEN line[1] = '{' THEN NULL ELSE regexp_replace(line, '^\\s+|\\s+$', '', 'g') END AS line,
  CASE WHEN line[1] = '{' THEN (line->>'$.k')::BIGINT END AS k
FROM lines WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    lines = lines.unionByName(t.events.select(F.col("event_id").alias("doc_id"), F.col("props").alias("value")))
    lines = lines.unionByName(t.events.select(F.col("event_id").alias("doc_id"), F.lit("   ").alias("value")))
    got = dc.line_records(lines)
    return got.select("doc_id", "is_json", F.try_variant_get("payload", "$.line", "string").alias("line"),
                      F.try_variant_get("payload", "$.k", "long").alias("k"))


@suite.query("encode_payload", ln.with_(ln.MESSAGES) + f"""
SELECT event_id, '{{"user_id":' || user_id || ',"kind":"' || event_type || '","k":' || (props->>'$.k') || '}}' ||
  CASE WHEN {PROTOCOL} = 'socket' THEN chr(10) ELSE '' END AS body FROM messages""")
def _(t):
    rows = ln.messages(t).select("event_id", _protocol().alias("protocol"), "user_id", F.col("event_type").alias("kind"),
                                 F.get_json_object("props", "$.k").cast("long").alias("k"))
    return dc.encode_payload(rows, ["user_id", "kind", "k"]).select("event_id", F.col("body").cast("string").alias("body"))


@suite.query("csv_to_records", """
SELECT l_orderkey, l_linenumber, 2::BIGINT AS n, l_quantity::VARCHAR AS qty, l_extendedprice::VARCHAR AS price,
  l_returnflag || ', "' || l_linestatus || '"' AS note, NULL::VARCHAR AS gap FROM lineitem""")
def _(t):
    row = F.concat(F.col("l_quantity").cast("string"), F.lit(","), F.col("l_extendedprice").cast("string"),
                   F.lit(',"'), F.col("l_returnflag"), F.lit(', ""'), F.col("l_linestatus"), F.lit('"""'))
    text = F.concat(F.lit("qty,price,note,gap\n"), row, F.lit("\n\n"), row, F.lit("\n"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", fl.csv_to_records(text).alias("r"))
    first = lambda name: F.get("r", F.lit(1))[name]
    return rows.select("l_orderkey", "l_linenumber", F.size("r").cast("long").alias("n"),
                       *[first(x).alias(x) for x in ("qty", "price", "note", "gap")])


@suite.query("records_to_csv", """
SELECT o_orderkey, 'absent,note,o_orderkey,o_orderpriority' || chr(13) || chr(10) || ',"a ""' || o_orderstatus || '"", b",' ||
  o_orderkey || ',' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END || chr(13) || chr(10) AS csv FROM orders""")
def _(t):
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.concat(F.lit('a "'), F.col("o_orderstatus"), F.lit('", b')).alias("note"), F.lit("x").alias("unused"))
    return fl.records_to_csv(rows, ["absent", "note", "o_orderkey", "o_orderpriority"]).select("o_orderkey", "csv")


@suite.query("xml_to_records", """
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'part' ELSE 'item' END AS root,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_partkey::VARCHAR END AS id,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name END AS name,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type || '|' || p_size END AS tags, CASE WHEN p_size % 10 = 0 THEN '<part>' || p_name END AS raw
FROM part""")
def _(t):
    good = F.concat(F.lit('<x:item xmlns:x="urn:x" id="'), F.col("p_partkey"), F.lit('" brand="'), F.col("p_brand"), F.lit('"><name>'),
                    F.col("p_name"), F.lit("</name><x:tag>"), F.col("p_type"), F.lit("</x:tag><x:tag>"), F.col("p_size"),
                    F.lit("</x:tag></x:item>"))
    text = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("<part>"), F.col("p_name"))).otherwise(good)
    schema = T.StructType([
        T.StructField("@id", T.StringType()), T.StructField("@brand", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("tag", T.ArrayType(T.StringType()))])
    rows = t.part.select("p_partkey", text.alias("x")).select(
        "p_partkey", fl.xml_root(F.col("x")).alias("root"), fl.xml_to_records(F.col("x"), schema).alias("r"))
    return rows.select("p_partkey", "root", F.col("r")["@id"].alias("id"), F.col("r")["@brand"].alias("brand"),
                       F.col("r")["name"].alias("name"), F.array_join(F.col("r")["tag"], "|").alias("tags"),
                       F.col("r")["_raw_xml"].alias("raw"))


@suite.query("xml_to_variant", """
SELECT p_partkey, kind, CASE kind WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_size::VARCHAR END AS first, CASE kind WHEN 0 THEN '["' || p_type || '",{"@n":"' || p_size || '"}]' END AS tags,
  CASE WHEN kind = 2 THEN '<part>' || p_name END AS raw FROM (SELECT *, p_size % 3 AS kind FROM part)""")
def _(t):
    """Documents of different roots, and malformed ones, in one table."""
    c = F.col
    text = (F.when(c("p_size") % 3 == 0, F.concat(F.lit('<x:item xmlns:x="urn:x" id="'), "p_partkey", F.lit('"><tag> '), "p_type", F.lit('</tag><x:tag n="'), "p_size", F.lit('"/>tail</x:item>')))
            .when(c("p_size") % 3 == 1, F.concat(F.lit("<?xml version='1.0'?><box><size>"), "p_size", F.lit("</size><empty/></box>"))).otherwise(F.concat(F.lit("<part>"), "p_name")))
    rows = t.part.select("p_partkey", (c("p_size") % 3).cast("long").alias("kind"), fl.xml_to_variant(text).alias("v"))
    at = lambda path: F.try_variant_get("v", path, "string")
    return rows.select("p_partkey", "kind", F.coalesce(at("$.item['@id']"), at("$.box.size")).alias("first"), at("$.item.tag").alias("tags"), at("$._raw_xml").alias("raw"))


@suite.query("parse_endpoint", r"""
WITH e AS (SELECT page_id, page_id % 5 AS kind, regexp_extract(url, '^https?://([^/]+)', 1) AS h, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS p FROM pages)
SELECT page_id,
  CASE kind WHEN 0 THEN h || ':9092' WHEN 1 THEN h || ':x1' WHEN 2 THEN h || ':7001' WHEN 3 THEN 'amqp://guest:guest@' || h || '/' ELSE h || '/Svc/Get' END AS address,
  CASE kind WHEN 3 THEN NULL ELSE h END AS host,
  CASE kind WHEN 0 THEN 9092 WHEN 1 THEN 1883 WHEN 2 THEN 7001 END AS port,
  CASE kind WHEN 0 THEN 'topic' || page_id WHEN 1 THEN p || '/#' WHEN 2 THEN NULL WHEN 3 THEN 'default' ELSE 'Svc/Get' END AS path,
  CASE WHEN kind = 1 THEN rtrim(p, '/#') END AS publish
FROM e""")
def _(t):
    host, path = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1)
    kind = F.col("page_id") % 5
    text = (F.when(kind == 0, F.concat(host, F.lit(":9092/topic"), F.col("page_id")))
            .when(kind == 1, F.concat(F.lit("mqtt://"), host, F.lit(":x1/"), path, F.lit("/#")))
            .when(kind == 2, F.concat(host, F.lit(":7001"))).when(kind == 3, host).otherwise(F.concat(host, F.lit("/Svc/Get"))))
    name = F.element_at(F.array(*[F.lit(x) for x in ("kafka", "mqtt", "socket", "amqp", "grpc")]), (kind + 1).cast("int"))
    rows = t.pages.select("page_id", text.alias("endpoint"), name.alias("protocol"))
    return rows.select("page_id", dc.parse_endpoint(F.col("endpoint"), F.col("protocol")).alias("e")).select("page_id", "e.*")


@suite.query("message_id", ln.with_(ln.MESSAGES) + """
SELECT event_id, CASE event_type WHEN 'view' THEN user_id::VARCHAR WHEN 'click' THEN 'True' WHEN 'purchase' THEN 'None'
  WHEN 'signup' THEN (user_id + 0.5)::DOUBLE::VARCHAR END AS msg_id FROM messages""")
def _(t):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    doc = (F.when(kind == "view", F.concat(F.lit('{"seq": 1, "id": "'), user, F.lit('"}')))
           .when(kind == "click", F.lit('{"sequence": "s", "msg_id": true}'))
           .when(kind == "purchase", F.lit('{"uuid": null}'))
           .when(kind == "signup", F.concat(F.lit('{"seq": '), user, F.lit(".50}"))).otherwise(F.col("props")))
    return ln.messages(t).select("event_id", dc.message_id(doc).alias("msg_id"))
