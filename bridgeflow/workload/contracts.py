"""Queries of contract inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import contracts as ct
from . import lenses as ln
from .base import Suite

suite = Suite()


def fields_text(c):
    return F.array_join(F.transform(c, lambda f: F.concat(
        f["name"], F.lit(":"), f["type"], F.when(f["nullable"], "?").otherwise(""))), ",")


def names(c):
    return F.transform(c, lambda f: f["name"])


def _document():
    """A nested JSON document per event; every type of event lacks or changes something."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    nested = F.concat(F.lit('{"z": '), user, F.lit(', "meta": '), F.col("props"), F.lit(', "ok": true, "v": '), F.col("value").cast("string"),
                      F.lit(', "a": {"b": {"t": "'), kind, F.lit('", "none": null}, "e": {}}, "l": [1], "w": 2.0}'))
    return F.when(kind == "view", F.col("props")).when(kind == "click", F.lit("{}")).when(kind == "error", F.concat(F.lit("["), user, F.lit("]"))).otherwise(nested)


DEEP = "z:int,meta.k:int,ok:bool,v:float,a.b.t:str,a.b.none:str?,data:object,l:array?,w:float"
SHALLOW = "z:int,meta:object,ok:bool,v:float,a:object,l:array,w:float"


def sql_fields(deep: str) -> str:
    return f"CASE event_type WHEN 'view' THEN 'k:int' WHEN 'click' THEN 'data:object' WHEN 'error' THEN 'data:object' ELSE '{deep}' END"


@suite.query("infer_fields", f"SELECT event_id, {sql_fields(DEEP)} AS fields FROM events")
def _(t):
    return t.events.select("event_id", _document().alias("doc")).select("event_id", fields_text(ct.infer_fields(F.col("doc"))).alias("fields"))


@suite.query("infer_fields_shallow", f"SELECT event_id, {sql_fields(SHALLOW)} AS fields FROM events")
def _(t):
    return t.events.select("event_id", _document().alias("doc")).select("event_id", fields_text(ct.infer_fields_shallow(F.col("doc"))).alias("fields"))


@suite.query("infer_fields_openapi", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'id:integer,' || lower(p_type) || ':object,name:string' ELSE 'data:object' END AS fields FROM part""")
def _(t):
    spec = F.concat(F.lit('{"components": {"schemas": {"A": {"properties": {"id": {"type": "integer"}, "'), F.lower("p_type"),
                    F.lit('": {}}}, "B": {}, "C": {"properties": {"name": {"type": "string"}}}, "D": {"properties": {"x": {"type": "string"}}}}}}'))
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, spec).otherwise(F.lit('{"paths": {}}')).alias("spec"))
    return rows.select("p_partkey", fields_text(ct.infer_fields_openapi(F.col("spec"))).alias("fields"))


def sql_tags(names_sql: str, words: dict) -> str:
    text = f"lower(array_to_string({names_sql}, ' '))"
    parts = ", ".join("CASE WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{tag}' END" for tag, ws in words.items())
    hits = f"list_filter([{parts}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({hits}) = 0 THEN 'generic' ELSE array_to_string({hits}, ',') END"


@suite.query("semantic_tags", ln.with_(ln.NODES) + f"SELECT node_id, {sql_tags('names', fixed.TAG_WORDS)} AS tags FROM nodes")
def _(t):
    return ln.nodes(t).select("node_id", F.array_join(ct.semantic_tags(names("fields")), ",").alias("tags"))


@suite.query("semantic_tags_short", ln.with_(ln.NODES) + f"SELECT node_id, {sql_tags('names', fixed.SHORT_TAG_WORDS)} AS tags FROM nodes")
def _(t):
    return ln.nodes(t).select("node_id", F.array_join(ct.semantic_tags_short(names("fields")), ",").alias("tags"))


@suite.query("contract_from_topic", ln.with_(ln.MESSAGES) + """
SELECT event_type AS topic, CASE WHEN event_type = 'error' THEN 'data:bytes' ELSE 'k:int,price:int' END AS fields,
  CASE WHEN event_type = 'error' THEN 'kafka' ELSE 'market,kafka' END AS tags, CASE WHEN event_type = 'error' THEN 'binary' ELSE 'json' END AS encoding,
  CASE WHEN event_type = 'error' THEN 0.4 ELSE 0.8 END::DOUBLE AS confidence, 1.0::DOUBLE AS rate,
  round(count(*) / ((max(t) - min(t)) / 1000000.0), 6)::DOUBLE AS measured_rate,
  CASE WHEN event_type <> 'error' THEN '{"k": ' || (arg_max(props, t)->>'$.k') || ', "price": ' || arg_max(user_id, t) || '}' END AS raw_sample
FROM messages GROUP BY event_type""")
def _(t):
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "price": '), F.col("user_id"), F.lit("}"))
    value = F.encode(F.when(F.col("is_error"), F.lit("plain")).otherwise(body), "UTF-8")
    rows = ln.messages(t).select(F.col("event_type").alias("topic"), value.alias("value"), "t")
    made = ct.contract_from_topic(rows, "topic", "value", "t")
    return made.select("topic", fields_text("fields").alias("fields"), F.array_join("tags", ",").alias("tags"), "encoding", "confidence",
                       "rate", F.round("measured_rate", 6).alias("measured_rate"), "raw_sample")


@suite.query("contract_from_files", """
SELECT 'd' || doc_id AS file, 'line:str' AS fields, 'file,text' AS tags, 'text' AS encoding, 0.5::DOUBLE AS confidence FROM documents
UNION ALL SELECT 'e' || event_id, 'k:int', 'generic,file', 'json', 0.7 FROM events""")
def _(t):
    files = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("file"), "text").unionByName(
        t.events.select(F.concat(F.lit("e"), F.col("event_id")).alias("file"), F.col("props").alias("text")))
    made = ct.contract_from_files(files, "text")
    return made.select("file", fields_text("fields").alias("fields"), F.array_join("tags", ",").alias("tags"), "encoding", "confidence")


@suite.query("contract_from_rest_sample", f"""
SELECT event_id, {sql_fields(DEEP.replace('w:', 'w_ts:'))} AS fields, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'generic' ELSE 'time-series' END AS tags,
  0.7::DOUBLE AS confidence FROM events""")
def _(t):
    doc = F.replace(_document(), F.lit('"w"'), F.lit('"w_ts"'))
    rows = t.events.select("event_id", "event_type", doc.alias("body"))
    broken = rows.select("event_id", "event_type", F.lit("<html>").alias("body"))
    made = ct.contract_from_rest_sample(rows.unionByName(broken), "body")
    return made.select("event_id", fields_text("fields").alias("fields"), F.array_join("tags", ",").alias("tags"), "confidence")


@suite.query("contract_from_http_capture", """
WITH captured AS (SELECT page_id, CASE WHEN url LIKE '%#top' THEN 503 ELSE 200 END AS status,
  CASE WHEN contains(url, '.com/') THEN 'json' WHEN contains(url, '.net/') THEN 'broken' ELSE 'html' END AS kind FROM pages)
SELECT page_id, CASE WHEN kind = 'json' THEN 'url:str,user_log:int' ELSE 'data:object' END AS fields,
  CASE WHEN kind = 'json' THEN 'identity,observability,rest,process' ELSE 'rest,process' END AS tags,
  CASE WHEN kind = 'html' THEN 'text' ELSE 'json' END AS encoding, CASE WHEN kind = 'json' THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence
FROM captured WHERE status < 500""")
def _(t):
    url = F.col("url")
    body = F.concat(F.lit('{"url": "'), url, F.lit('", "user_log": '), F.col("page_id"), F.lit("}"))
    rows = t.pages.select(
        "page_id", F.when(url.endswith("#top"), 503).otherwise(200).alias("status"),
        F.when(url.contains(".com/") | url.contains(".net/"), "application/json").otherwise("text/html").alias("ct"),
        F.when(url.contains(".com/"), body).otherwise(F.col("html")).alias("body"))
    made = ct.contract_from_http_capture(rows, "status", "ct", "body")
    return made.select("page_id", fields_text("fields").alias("fields"), F.array_join("tags", ",").alias("tags"), "encoding", "confidence")


@suite.query("classify_banner", """
WITH b AS (
  SELECT 'e' || event_id AS id, encode(props) AS raw FROM events UNION ALL SELECT 'c' || conv_id || '-' || turn, encode(text) FROM conversations
  UNION ALL SELECT 'm' || event_id, '\\x20\\x02\\x00\\x00'::BLOB FROM events UNION ALL SELECT 's' || event_id, ''::BLOB FROM events)
SELECT id, CASE WHEN octet_length(raw) = 0 THEN 'bytes|socket,process|binary|0.3'
  WHEN id[1] = 'm' THEN 'object|mqtt,process|binary|0.7'
  WHEN decode(raw)[1] = '{' OR contains(decode(raw)[1:20], '"') THEN 'object|socket,json,process|json|0.55'
  ELSE 'bytes|socket,process|binary|0.35' END AS contract FROM b""")
def _(t):
    rows = t.events.select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.encode("props", "UTF-8").alias("raw"))
    rows = rows.unionByName(t.conversations.select(
        F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), F.encode("text", "UTF-8").alias("raw")))
    for tag, raw in (("m", b"\x20\x02\x00\x00"), ("s", b"")):
        rows = rows.unionByName(t.events.select(F.concat(F.lit(tag), F.col("event_id")).alias("id"), F.lit(raw).alias("raw")))
    made = ct.classify_banner(rows, "raw")
    return made.select("id", F.concat_ws("|", F.col("fields")[0]["type"], F.array_join("tags", ","), "encoding", F.col("confidence").cast("string")).alias("contract"))


PORT_CASE = "CASE " + " ".join(f"WHEN port IN ({', '.join(map(str, ps))}) THEN '{p}'" for p, ps in fixed.PORT_PROTOCOLS.items()) + " ELSE 'socket' END"


@suite.query("protocol_from_port", f"""
SELECT o_orderkey, port, {PORT_CASE} AS protocol FROM (SELECT o_orderkey, o_orderkey % 65536 AS port FROM orders)
WHERE port >= 1024 AND port NOT IN ({', '.join(map(str, fixed.SKIPPED_PORTS))})""")
def _(t):
    return ct.protocol_from_port(t.orders.select("o_orderkey", (F.col("o_orderkey") % 65536).alias("port")), "port")


@suite.query("refine_protocol", ln.with_(ln.NODES) + """
SELECT node_id, CASE WHEN k % 4 = 0 THEN 'mqtt' WHEN k % 4 = 1 THEN 'grpc' WHEN k % 4 = 2 THEN 'rest' ELSE protocol END AS protocol,
  array_to_string(list_sort(list_distinct(list_concat(tags, [['mqtt', 'grpc', 'json', 'x'][k % 4 + 1]],
    CASE WHEN k % 3 = 0 THEN ['nginx'] ELSE []::VARCHAR[] END))), ',') AS tags,
  CASE WHEN k % 4 = 2 OR (k % 4 = 3 AND protocol = 'rest') THEN 'http://' ELSE '' END || 'h' || k || ':' || (8000 + k) AS endpoint FROM nodes""")
def _(t):
    k = F.col("k")
    extra = F.element_at(F.array(*[F.lit(x) for x in ("mqtt", "grpc", "json", "x")]), (k % 4 + 1).cast("int"))
    rows = ln.nodes(t).select("node_id", "protocol", F.concat("tags", F.array(extra)).alias("tags"), F.concat(F.lit("h"), k).alias("host"),
                              (8000 + k).alias("port"), F.when(k % 3 == 0, "NGINX").alias("process"))
    return ct.refine_protocol(rows).select("node_id", "protocol", F.array_join(F.array_sort("tags"), ",").alias("tags"), "endpoint")


def _catalog(t):
    k = F.col("k")
    none = F.lit(None).cast("string")
    meta = F.map_filter(F.create_map(
        F.lit("protocol"), F.when(k % 3 == 0, F.upper("protocol")).otherwise(none), F.lit("address"), F.when(k % 2 == 0, F.concat(F.lit("h"), k)).otherwise(none),
        F.lit("field.price"), F.when(k % 5 != 0, "float").otherwise(none), F.lit("field.symbol"), F.when(k % 5 != 0, "").otherwise(none),
        F.lit("rate_hz"), F.when(k % 4 == 0, "fast").when(k % 4 == 1, F.concat(k, F.lit(".5"))).otherwise(none),
        F.lit("confidence"), F.when(k % 6 == 0, "2.0").when(k % 6 == 1, "-1.0").when(k % 6 == 2, "high").otherwise(none),
        F.lit("role"), F.when(k % 7 == 0, "Producer").when(k % 7 == 1, "consumer").when(k % 7 == 2, "boss").otherwise(none)), lambda _, v: v.isNotNull())
    tags = F.when(k % 11 == 0, F.array(F.upper("protocol"))).otherwise(F.concat(F.array("protocol"), "tags"))
    return ln.nodes(t).select("node_id", F.concat(F.lit("My-Service-"), k).alias("service"), tags.alias("tags"), meta.alias("meta"), (9000 + k).alias("port"))


SIX = "'grpc', 'mqtt', 'kafka', 'websocket', 'amqp', 'zeromq'"
SCHEME = "CASE " + " ".join(f"WHEN proto = '{p}' THEN '{s}'" for p, s in fixed.SCHEMES.items()) + " END"


@suite.query("catalog_protocol_endpoint", ln.with_(ln.NODES) + f"""
SELECT node_id, proto AS protocol, {SCHEME} || '://' || CASE WHEN k % 2 = 0 THEN 'h' || k ELSE 'localhost' END || ':' || (9000 + k) AS endpoint
FROM (SELECT *, CASE WHEN protocol IN ({SIX}) THEN protocol ELSE 'rest' END AS proto FROM nodes)""")
def _(t):
    return ct.catalog_protocol_endpoint(_catalog(t)).select("node_id", "protocol", "endpoint")


@suite.query("catalog_contract", ln.with_(ln.NODES) + f"""
SELECT node_id, CASE WHEN k % 5 <> 0 THEN 'price:float,symbol:object' ELSE 'data:object' END AS fields,
  CASE WHEN k % 11 = 0 THEN CASE WHEN protocol IN ({SIX}, 'rest') THEN 'my_service_' || k ELSE upper(protocol) END
    WHEN protocol IN ({SIX}, 'rest') THEN tags[1] ELSE protocol || ',' || tags[1] END AS tags,
  'json' AS encoding, CASE WHEN k % 4 = 1 THEN k + 0.5 END::DOUBLE AS rate,
  least(1.0, greatest(0.1, try_cast(given AS DOUBLE))) AS confidence
FROM (SELECT *, CASE k % 6 WHEN 0 THEN '2.0' WHEN 1 THEN '-1.0' WHEN 2 THEN 'high' ELSE '0.85' END AS given FROM nodes) WHERE try_cast(given AS DOUBLE) IS NOT NULL""")
def _(t):
    made = ct.catalog_contract(_catalog(t))
    return made.select("node_id", fields_text("fields").alias("fields"), F.array_join("semantic_tags", ",").alias("tags"), "encoding", "rate", "confidence")


@suite.query("catalog_role", ln.with_(ln.NODES) + """
SELECT node_id, CASE k % 7 WHEN 0 THEN 'producer' WHEN 1 THEN 'consumer' ELSE 'both' END AS role FROM nodes""")
def _(t):
    return _catalog(t).select("node_id", ct.catalog_role(F.col("meta")).alias("role"))


@suite.query("descriptor_fields", """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z][a-z_0-9]{2,}')) AS w, generate_subscripts(regexp_extract_all(text, '[a-z][a-z_0-9]{2,}'), 1) AS i FROM documents),
firsts AS (SELECT doc_id, w, min(i) AS i FROM words WHERE NOT starts_with(w, 'grpc') GROUP BY doc_id, w),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM firsts)
SELECT d.doc_id, coalesce(f.fields, 'data:object') AS fields, CASE WHEN f.fields IS NULL THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w || ':object', ',' ORDER BY i) AS fields FROM top WHERE r <= 15 GROUP BY doc_id) f USING (doc_id)""")
def _(t):
    made = ct.descriptor_contract(t.documents.select("doc_id", F.encode("text", "UTF-8").alias("raw")))
    return made.select("doc_id", fields_text("fields").alias("fields"), "confidence")


@suite.query("infer_role", ln.with_(ln.NODES) + "SELECT node_id, CASE WHEN rate > 0 THEN 'producer' ELSE 'both' END AS role FROM nodes")
def _(t):
    return ln.nodes(t).select("node_id", ct.infer_role(F.col("rate")).alias("role"))


def sql_quote(x: str) -> str:
    unit = "CASE WHEN unicode({c}) < 65536 THEN '\\u' || printf('%04x', unicode({c})) ELSE '\\u' || printf('%04x', (unicode({c}) - 65536) // 1024 + 55296) || '\\u' || printf('%04x', (unicode({c}) - 65536) % 1024 + 56320) END".format(c="ch")
    return (f"'\"' || CASE WHEN regexp_full_match({x}, '[ !#-\\[\\]-~]*') THEN {x} ELSE array_to_string(list_transform(string_split({x}, ''), lambda ch: "
            f"CASE WHEN ch IN ('\"', '\\') THEN '\\' || ch WHEN ch = '' THEN '' WHEN unicode(ch) BETWEEN 32 AND 126 THEN ch ELSE {unit} END), '') END || '\"'")


@suite.query("contract_fingerprint", f"""
SELECT doc_id, substr(sha256('{{"encoding": "json", "fields": [' || array_to_string(list_transform(list_sort(toks), lambda x: {sql_quote('x')}), ', ')
  || '], "tags": [' || CASE WHEN lang < source THEN '"' || lang || '", "' || source || '"' ELSE '"' || source || '", "' || lang || '"' END || ']}}'), 1, 16) AS fingerprint
FROM (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda x: x <> '') AS toks FROM documents)""")
def _(t):
    tokens = F.filter(F.split("text", "[ \n\r\t]+"), lambda x: x != "")
    rows = t.documents.select("doc_id", tokens.alias("names"), F.array("source", "lang").alias("tags"))
    return rows.select("doc_id", ct.contract_fingerprint(F.col("names"), F.col("tags"), F.lit("json")).alias("fingerprint"))


@suite.query("node_id", "SELECT page_id, substr(sha256('rest:' || url), 1, 16) AS node_id FROM pages")
def _(t):
    return t.pages.select("page_id", ct.node_id(F.lit("rest"), F.col("url")).alias("node_id"))
