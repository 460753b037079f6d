"""Domain tables derived from the given tables, once for Spark and once as SQL.

Messages come from events, nodes from suppliers and customers, links between nodes from the
orders that connect them, contract samples from conversations and endpoints from pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from .base import Tables

# ---- fixed values: field vocabulary and tags of the node lens ----------------
VOCABULARY = [
    ("price", "float"), ("symbol", "str"), ("volume", "int"), ("timestamp", "int"),
    ("device_id", "str"), ("temp_c", "float"), ("humidity", "float"), ("user_id", "int"),
    ("message", "str"), ("level", "str"), ("lat", "float"), ("lon", "float"), ("alt", "float"),
    ("status", "str"), ("host", "str"), ("port", "int"), ("bytes_sent", "int"),
    ("latency_ms", "float"), ("event_type", "str"), ("seq", "int"),
]
NODE_TAGS = ["market", "telemetry", "geospatial", "identity", "observability", "drone", "generic", "data"]


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), c) * 1000000).cast("long")


def messages(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        "event_id", "user_id", "event_type", "value", "props",
        epoch_micros(F.col("ts")).alias("t"),
        (F.col("user_id") % 20).alias("bridge_id"),
        F.concat_ws("-", F.col("user_id"), kind).alias("msg_id"),
        (kind == "error").alias("is_error"),
        F.when(kind == "view", "heartbeat").when(kind == "click", "keepalive from user")
        .otherwise(F.concat(kind, F.lit(" event"))).alias("text"),
        F.when(kind == "click", "debug").when(kind == "view", "info").when(kind == "signup", "notice")
        .when(kind == "purchase", "warn").otherwise("err").alias("severity"),
    )


MESSAGES = """messages AS (
  SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t, user_id % 20 AS bridge_id,
    user_id || '-' || event_type AS msg_id, event_type = 'error' AS is_error,
    CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'keepalive from user'
      ELSE event_type || ' event' END AS text,
    CASE event_type WHEN 'click' THEN 'debug' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'notice'
      WHEN 'purchase' THEN 'warn' ELSE 'err' END AS severity
  FROM events)"""


def _node_columns(prefix: str, k: Column, role: str) -> list[Column]:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    names, types = [v[0] for v in VOCABULARY], [v[1] for v in VOCABULARY]
    fields = F.transform(F.sequence(F.lit(0).cast("long"), 2 + k % 4), lambda i: F.struct(
        pick(names, (k * 7 + i) % 20).alias("name"), pick(types, (k * 7 + i) % 20).alias("type")))
    protocol = pick(fixed.PROTOCOLS, k % 13)
    return [
        F.concat(F.lit(prefix), k.cast("string")).alias("node_id"), k.alias("k"),
        F.lit(role).alias("role"), protocol.alias("protocol"),
        F.concat(protocol, F.lit("://host"), k.cast("string"), F.lit(":"), (8000 + k % 5).cast("string")).alias("endpoint"),
        fields.alias("fields"), F.array(pick(NODE_TAGS, k % 8)).alias("tags"), F.lit("json").alias("encoding"),
        F.when(k % 7 != 0, pick([0.1, 1.0, 10.0, 100.0, 1000.0], k % 5)).alias("rate"),
        ((k % 10 + 1) / 10.0).alias("confidence"),
    ]


def nodes(t: Tables) -> DataFrame:
    made = t.supplier.select(*_node_columns("p", F.col("s_suppkey"), "producer"))
    return made.unionByName(t.customer.select(*_node_columns("c", F.col("c_custkey"), "consumer")))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


NODES = f"""raw_nodes AS (
  SELECT 'p' || s_suppkey AS node_id, s_suppkey AS k, 'producer' AS role FROM supplier
  UNION ALL SELECT 'c' || c_custkey, c_custkey, 'consumer' FROM customer),
nodes AS (
  SELECT node_id, k, role, {sql_list(fixed.PROTOCOLS)}[k % 13 + 1] AS protocol,
    {sql_list(fixed.PROTOCOLS)}[k % 13 + 1] || '://host' || k || ':' || (8000 + k % 5) AS endpoint,
    list_transform(range(0, 3 + k % 4), lambda i: {sql_list([v[0] for v in VOCABULARY])}[(k * 7 + i) % 20 + 1]) AS names,
    list_transform(range(0, 3 + k % 4), lambda i: {sql_list([v[1] for v in VOCABULARY])}[(k * 7 + i) % 20 + 1]) AS types,
    [{sql_list(NODE_TAGS)}[k % 8 + 1]] AS tags, 'json' AS encoding,
    CASE WHEN k % 7 <> 0 THEN ([0.1, 1.0, 10.0, 100.0, 1000.0]::DOUBLE[])[k % 5 + 1] END AS rate,
    ((k % 10 + 1) / 10.0)::DOUBLE AS confidence
  FROM raw_nodes)"""


def pairs(t: Tables) -> DataFrame:
    """Every order line as a supplier-to-customer candidate with a score and a time."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("producer_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("consumer_id"),
        F.round(F.col("o_totalprice") / 1000000.0, 6).alias("score"),
        epoch_micros(F.col("o_orderdate")).alias("created"),
        # text in arrival order, unique per line
        F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_orderkey", 12), ("l_linenumber", 2), ("l_partkey", 11), ("l_suppkey", 10))]).alias("seq"),
        F.col("o_orderstatus").alias("status"),
        F.col("l_extendedprice").alias("price"),
    )


PAIRS = """pairs AS (
  SELECT 'p' || l_suppkey AS producer_id, 'c' || o_custkey AS consumer_id,
    round(o_totalprice / 1000000.0, 6) AS score, epoch_us(o_orderdate) AS created,
    concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), lpad(l_linenumber::VARCHAR, 2, '0'), lpad(l_partkey::VARCHAR, 11, '0'), lpad(l_suppkey::VARCHAR, 10, '0')) AS seq, o_orderstatus AS status, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _distinct_pairs(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Pairs of the joined lines and orders, told apart by their numbers before they get their names."""
    keys = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    return keys.select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("producer_id"),
                       F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("consumer_id"))


def links(t: Tables) -> DataFrame:
    """Distinct candidate pairs."""
    return _distinct_pairs(t.lineitem, t.orders)


LINKS = "links AS (SELECT DISTINCT producer_id, consumer_id FROM pairs)"


def active(t: Tables) -> DataFrame:
    """Active bridges: pairs with an order in state F."""
    return _distinct_pairs(t.lineitem, t.orders.filter("o_orderstatus = 'F'"))


ACTIVE = "active AS (SELECT DISTINCT producer_id, consumer_id FROM pairs WHERE status = 'F')"


def samples(t: Tables) -> DataFrame:
    """Contract samples: the letters of a turn are the field names of the conversation's node."""
    letters = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("node_id"), "turn",
        F.array_sort(F.array_distinct(letters)).alias("names"), F.array("role").alias("tags"),
        F.length("text").alias("n_chars"),
    )


SAMPLES = """samples AS (
  SELECT conv_id::VARCHAR AS node_id, turn,
    list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]'))) AS names, [role] AS tags,
    length(text) AS n_chars
  FROM conversations)"""


def endpoints(t: Tables) -> DataFrame:
    """Page addresses, two thirds as they are and the rest pointing at guarded places."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    case = F.col("page_id") % 6
    return t.pages.select(
        F.col("page_id").cast("string").alias("node_id"), "page_id",
        F.when(case == 0, F.concat(F.lit("https://"), host, F.lit("/admin/x")))
        .when(case == 1, F.concat(F.lit("tcp://"), host, F.lit(":22")))
        .when(case == 2, F.concat(host, F.lit("/OAuth/token"))).otherwise(F.col("url")).alias("endpoint"),
    )


ENDPOINTS = r"""endpoints AS (
  SELECT page_id::VARCHAR AS node_id, page_id,
    CASE page_id % 6 WHEN 0 THEN 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/admin/x'
      WHEN 1 THEN 'tcp://' || regexp_extract(url, '^https?://([^/]+)', 1) || ':22'
      WHEN 2 THEN regexp_extract(url, '^https?://([^/]+)', 1) || '/OAuth/token' ELSE url END AS endpoint
  FROM pages)"""


def outcomes(t: Tables) -> DataFrame:
    pick = lambda i: F.element_at(F.array(*[F.lit(p) for p in fixed.PROTOCOLS]), (i + 1).cast("int"))
    return t.labels.select(
        "doc_id", pick(F.col("doc_id") % 13).alias("producer_protocol"),
        pick(F.col("doc_id") % 5).alias("consumer_protocol"), (F.col("quality") == 1).alias("success"))


OUTCOMES = f"""outcomes AS (
  SELECT doc_id, {sql_list(fixed.PROTOCOLS)}[doc_id % 13 + 1] AS producer_protocol,
    {sql_list(fixed.PROTOCOLS)}[doc_id % 5 + 1] AS consumer_protocol, quality = 1 AS success
  FROM labels)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# ---- rules shared by several SQL twins -----------------------------------------
def sql_case_map(expr: str, values: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def sql_level(expr: str) -> str:
    return sql_case_map(f"lower({expr})", fixed.SEVERITY_LEVELS, "2")


def sql_iso(micros: str) -> str:
    """ISO text with +00:00 of an epoch in microseconds."""
    return (f"(strftime(make_timestamp({micros}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} % 1000000 = 0 THEN '' "
            f"ELSE '.' || lpad(({micros} % 1000000)::VARCHAR, 6, '0') END || '+00:00')")


def sql_human(x: str) -> str:
    steps = " ".join(
        f"WHEN abs({x}) < {1024 ** (p + 1)} THEN printf('%.2f {u}', ({x}) / {1024 ** p}.0)"
        for p, u in enumerate(["B", "KB", "MB", "GB", "TB"]))
    return f"CASE {steps} ELSE printf('%.2f PB', ({x}) / {1024 ** 5}.0) END"
