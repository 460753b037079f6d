"""Queries of fan-out and fan-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping as mp
from ..operators import records as rc
from ..operators import topology as tp
from ..operators import transform as tr
from ..operators.mapping import FieldMapping as M
from . import lenses as ln
from .base import Suite

suite = Suite()
SINKS = [
    tp.Sink("warehouse", lambda d: mp.apply_mapping(d.select("event_id", "user_id", "value"), [M("value", "amount", "cast:int")])),
    tp.Sink("alerts", lambda d: tr.filter_severity(d.select("event_id", "severity"), "warning")),
    tp.Sink("feed", lambda d: tr.suppress_noise(d.select("event_id", F.col("text").alias("message")))),
]
BRANCHES = """branches AS (
  SELECT event_id, 'warehouse' AS bridge_id, '{"amount":' || trunc(value)::BIGINT || ',"user_id":' || user_id || '}' AS payload FROM messages
  UNION ALL SELECT event_id, 'alerts', '{"severity":"' || severity || '"}' FROM messages WHERE severity IN ('warn', 'err')
  UNION ALL SELECT event_id, 'feed', '{"message":"' || text || '"}' FROM messages WHERE event_type NOT IN ('view', 'click'))"""


@suite.query("fan_out", ln.with_(ln.MESSAGES, BRANCHES) + "SELECT * FROM branches")
def _(t):
    return tp.fan_out(ln.messages(t), SINKS, "event_id")


# a row per bridge; the last one has an envelope that records do not know
BRIDGES = [("*", "ledger", None, [("cents", "amount", "cast:str")]), ("error", "alerts", None, [("severity", "level", "direct"), ("gone", "x", "direct")]),
           ("error", "bus", "mqtt_to_kafka", []), ("signup", "grpc", "mavlink_to_grpc", []), ("signup", "lost", "no_such_envelope", [("cents", "c", "direct")])]


@suite.query("fan_out_plans", ln.with_(ln.MESSAGES, """m AS (SELECT *, floor(value * 100)::BIGINT AS cents FROM messages)""") + """
SELECT event_id, 'ledger' AS bridge_id, '{"amount":"' || cents || '","user_id":' || user_id || ',"severity":"' || severity || '"}' AS payload, true AS delivered FROM m
UNION ALL SELECT event_id, 'alerts', '{"level":"' || severity || '","user_id":' || user_id || ',"cents":' || cents || '}', true FROM m WHERE event_type = 'error'
UNION ALL SELECT event_id, 'bus', '{"key":"unknown","value":"' || base64(encode('{"user_id":' || user_id || ',"cents":' || cents || ',"severity":"' || severity || '"}')) || '","headers":{"source":"mqtt"}}', true
  FROM m WHERE event_type = 'error'
UNION ALL SELECT event_id, 'grpc', '{"sys_id":0,"comp_id":0,"msg_id":0,"timestamp":0,"fields":{"cents":' || cents || ',"severity":"' || severity || '","user_id":' || user_id || '}}', true FROM m WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'lost', NULL, false FROM m WHERE event_type = 'signup'""")
def _(t):
    m = ln.messages(t).withColumn("cents", F.floor(F.col("value") * 100))
    rows = [(p, b, e, [(*x, 1.0) for x in maps], False, False) for kind, b, e, maps in BRIDGES
            for p in (["view", "click", "signup", "purchase", "error"] if kind == "*" else [kind])]
    plans = t.spark.createDataFrame(rows, "producer_id string, bridge_id string, envelope string, mappings array<struct<src_field:string,dst_field:string,transform:string,confidence:double>>, "
                                    "normalize boolean, flatten boolean")
    messages = m.select("event_id", F.col("event_type").alias("producer_id"), rc.as_record(m, ["user_id", "cents", "severity"]).alias("record"))
    return tp.fan_out_plans(messages, plans, "event_id")


def outcomes(t):
    m = ln.messages(t)
    return tp.fan_out_outcomes(m, tp.fan_out(m, SINKS[1:], "event_id"), "event_id")


OUTCOMES = """outcomes AS (SELECT event_id, (severity IN ('warn', 'err'))::BIGINT + (event_type NOT IN ('view', 'click'))::BIGINT AS delivered FROM messages)"""


@suite.query("fanout_outcomes", ln.with_(ln.MESSAGES, OUTCOMES) + "SELECT event_id, delivered, delivered > 0 AS success FROM outcomes")
def _(t):
    return outcomes(t)


@suite.query("fanout_stats", ln.with_(ln.MESSAGES, OUTCOMES) + """
SELECT 'fan_out' AS type, 'alerts,feed' AS bridge_ids, 2 AS consumers, count(*) FILTER (delivered > 0) AS messages, count(*) FILTER (delivered = 0) AS errors FROM outcomes""")
def _(t):
    return tp.fanout_stats(outcomes(t), SINKS[1:]).withColumn("bridge_ids", F.array_join("bridge_ids", ","))


def _by_kind(t):
    m = ln.messages(t)
    kind = lambda k: m.filter(F.col("event_type") == k)
    others = m.filter(~F.coalesce(F.col("event_type").isin("view", "error", "click"), F.lit(False)))
    return tp.fan_in({
        "p1": (kind("view"), lambda d: d.select("event_id", F.col("value").alias("v"))),
        "p2": (kind("error"), lambda d: mp.apply_mapping(d.select("event_id", "user_id"), [M("user_id", "user")])),
        "p3": (kind("click"), lambda d: d.select("event_id", F.col("value").alias("v"), F.col("user_id").alias("user"))),
        "p4": (others, lambda d: d.select("event_id", F.col("user_id").alias("user"))),
    })


@suite.query("fan_in", ln.with_(ln.MESSAGES) + """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN value END AS v, CASE WHEN event_type IS DISTINCT FROM 'view' THEN user_id END AS user,
  CASE event_type WHEN 'view' THEN 'p1' WHEN 'error' THEN 'p2' WHEN 'click' THEN 'p3' ELSE 'p4' END AS _ic_source_producer FROM messages""")
def _(t):
    return _by_kind(t)


@suite.query("fanin_stats", ln.with_(ln.MESSAGES) + """
SELECT 'fan_in' AS type, 'b1' AS bridge_ids, 4 AS producers, count(*) FILTER (value >= 5) AS messages, count(*) FILTER (value < 5) AS errors
FROM messages""")
def _(t):
    written = _by_kind(t).join(ln.messages(t).select("event_id", "value"), "event_id").withColumn("success", F.col("value") >= 5)
    return tp.fanin_stats(written, ["b1"], 4).withColumn("bridge_ids", F.array_join("bridge_ids", ","))


@suite.query("active_fanout", ln.with_(ln.PAIRS, ln.ACTIVE) + "SELECT producer_id, count(*) AS bridges FROM active GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return tp.active_fanout(ln.active(t))
