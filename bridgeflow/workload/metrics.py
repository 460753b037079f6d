"""Queries of metrics, health and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mx
from ..operators import registry as rg
from ..operators import resilience as rs
from . import lenses as ln
from .base import Suite
from .matching import MONTH, QUEUE, queue
from .policy import APPROVALS, HOUR, MID_JANUARY, _approvals
from .registry import DAY, END_OF_JANUARY, SEEN, SNAPSHOTS, _heartbeats, snapshots
from .resilience import BREAKER_WALK, breaker

suite = Suite()


def sql_percentiles(source: str, name: str = "pct") -> str:
    return f"""{name} AS (SELECT bridge_id, list_sort(list(value)) AS s FROM {source} GROUP BY bridge_id)"""


def last(n: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bridge_id ORDER BY t DESC, event_id DESC) AS r FROM messages) WHERE r <= {n})"


P50, P99 = "s[len(s) // 2 + 1]", "s[(len(s) * 0.99)::DOUBLE::INT + CASE WHEN (len(s) * 0.99)::DOUBLE::INT > len(s) * 0.99 THEN 0 ELSE 1 END]"


@suite.query("latency_percentiles", ln.with_(ln.MESSAGES, sql_percentiles(last(200))) + f"SELECT bridge_id, {P50} AS p50, {P99} AS p99 FROM pct")
def _(t):
    return mx.latency_percentiles(ln.messages(t), "bridge_id", "value", ["t", "event_id"], 200)


@suite.query("runtime_error_rate", ln.with_(ln.MESSAGES) + "SELECT bridge_id, round(avg(is_error::INT), 6) AS error_rate FROM messages GROUP BY bridge_id")
def _(t):
    return mx.runtime_error_rate(ln.messages(t), "bridge_id", "is_error").withColumn("error_rate", F.round("error_rate", 6))


SNAP = f"""snap AS (SELECT bridge_id, count(*) FILTER (NOT is_error) AS messages, count(*) FILTER (is_error) AS errors, avg(is_error::INT) AS error_rate FROM messages GROUP BY bridge_id)"""


def snapshot(t):
    return mx.bridge_snapshot(ln.messages(t), "bridge_id", "is_error", "value", ["t", "event_id"])


@suite.query("bridge_snapshot", ln.with_(ln.MESSAGES, sql_percentiles(last(1000)), SNAP) + f"""
SELECT bridge_id, messages, errors, round(error_rate, 6) AS error_rate, {P50} AS p50, {P99} AS p99 FROM snap JOIN pct USING (bridge_id)""")
def _(t):
    return snapshot(t).withColumn("error_rate", F.round("error_rate", 6))


FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bridge_id ORDER BY t, event_id) AS r FROM messages) WHERE r <= 100)"


@suite.query("latency_baseline", ln.with_(ln.MESSAGES, sql_percentiles(FIRST, "early"), sql_percentiles(last(50))) + f"""
, both_ AS (SELECT bridge_id, CASE WHEN len(e.s) >= 100 THEN e.s[len(e.s) // 2 + 1] END AS baseline, p.s[len(p.s) // 2 + 1] AS p50 FROM early e JOIN pct p USING (bridge_id))
SELECT bridge_id, baseline, p50, coalesce(p50 > baseline * 1.1, false) AS degraded FROM both_""")
def _(t):
    return mx.latency_baseline(ln.messages(t), "bridge_id", "value", ["t", "event_id"], factor=1.1, samples=50)


@suite.query("throughput", ln.with_(ln.MESSAGES) + """
SELECT bridge_id, t // 3600000000 * 3600000000 AS window_start, round(count(*) / 3600.0, 6)::DOUBLE AS msg_s, round(sum(length(props)) / 3600.0, 6)::DOUBLE AS byte_s
FROM messages GROUP BY 1, 2""")
def _(t):
    out = mx.throughput(ln.messages(t), "bridge_id", "t", F.octet_length("props"), HOUR)
    return out.withColumn("msg_s", F.round("msg_s", 6)).withColumn("byte_s", F.round("byte_s", 6))


def bridges(t):
    """Active pairs as bridges; the retry count is the number of pairs' expensive order lines, at most 3."""
    rows = ln.pairs(t).filter("status = 'F'").groupBy("producer_id", "consumer_id").agg(
        F.least(F.count_if(F.col("price") > 50000), F.lit(3)).alias("retry_count"), F.min("created").alias("created_at"))
    return rows.withColumn("bridge_id", F.concat_ws(":", "producer_id", "consumer_id"))


def error_rates(t):
    """Share of returned lines per active pair."""
    return ln.pairs(t).filter("status = 'F'").groupBy("producer_id", "consumer_id").agg(
        F.avg((F.col("price") > 30000).cast("double")).alias("error_rate")).select(F.concat_ws(":", "producer_id", "consumer_id").alias("bridge_id"), "error_rate")


BRIDGES = """bridges AS (SELECT producer_id, consumer_id, least(count(*) FILTER (price > 50000), 3) AS retry_count, min(created) AS created_at,
    avg((price > 30000)::INT) AS error_rate, producer_id || ':' || consumer_id AS bridge_id FROM pairs WHERE status = 'F' GROUP BY producer_id, consumer_id),
stale AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_acctbal < -500)"""


def stale(t):
    return t.customer.filter("c_acctbal < -500").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"))


DECIDED = """decided AS (SELECT *, CASE WHEN consumer_id IN (SELECT node_id FROM stale) THEN 'teardown' WHEN error_rate > 0.4 AND retry_count < 3 THEN 'retry'
    WHEN error_rate > 0.4 THEN 'teardown' ELSE 'keep' END AS decision,
  CASE WHEN consumer_id IN (SELECT node_id FROM stale) THEN 'node-gone' WHEN error_rate > 0.4 AND retry_count >= 3 THEN 'persistent-errors' END AS reason FROM bridges)"""


def decided(t):
    return mx.health_decisions(bridges(t), stale(t), error_rates(t))


@suite.query("health_decisions", ln.with_(ln.PAIRS, BRIDGES, DECIDED) + """
SELECT bridge_id, decision, reason, retry_count + (decision = 'retry')::INT AS retry_count FROM decided""")
def _(t):
    return decided(t).select("bridge_id", "decision", "reason", "retry_count")


@suite.query("teardown_effects", ln.with_(ln.NODES, ln.PAIRS, BRIDGES, DECIDED, "torn AS (SELECT * FROM decided WHERE decision = 'teardown')") + f"""
SELECT 'bridges' AS effect, producer_id AS a, consumer_id AS b, '' AS c FROM decided WHERE decision <> 'teardown'
UNION ALL SELECT 'edges', producer_id, consumer_id, CASE WHEN producer_id IN (SELECT producer_id FROM torn) THEN '0.0' ELSE '1.0' END FROM bridges
UNION ALL SELECT 'audit', producer_id, consumer_id, 'reason=' || reason || ' bridge_id=' || bridge_id FROM torn
UNION ALL SELECT 'outcomes', p.protocol, c.protocol, CASE WHEN reason = 'persistent-errors' THEN 'false' ELSE 'true' END
  FROM torn JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id
UNION ALL SELECT 'events', 'bridge_torn', bridge_id, reason FROM torn
UNION ALL SELECT 'requeue', producer_id, consumer_id, '0.5' FROM torn WHERE reason <> 'node-gone'""")
def _(t):
    torn = decided(t).filter("decision = 'teardown'")
    b = bridges(t)
    out = mx.teardown_effects(torn, b, b.select("producer_id", "consumer_id", F.lit(1.0).alias("weight")), ln.nodes(t), END_OF_JANUARY)
    columns = {"bridges": ("producer_id", "consumer_id", None), "edges": ("producer_id", "consumer_id", "weight"), "audit": ("producer_id", "consumer_id", "reason"),
               "outcomes": ("producer_protocol", "consumer_protocol", "success"), "events": ("type", "bridge_id", "payload"),
               "requeue": ("producer_id", "consumer_id", "composite")}
    row = lambda kind, a, b_, c: out[kind].select(F.lit(kind).alias("effect"), F.col(a).alias("a"), F.col(b_).alias("b"),
                                                  (F.col(c).cast("string") if c else F.lit("")).alias("c"))
    return mx.union_all([row(kind, *cols) for kind, cols in columns.items()])


@suite.query("event_counters", BREAKER_WALK.rstrip() + ",\n" + ",\n".join([ln.SAMPLES, SNAPSHOTS, ln.NODES, ln.PAIRS, ln.ACTIVE]) + """
, holds AS (SELECT bridge_id, trips, least(count(*), 5) AS n FROM walk WHERE on_arrival = 'open' GROUP BY ALL)
SELECT 'drift_events' AS metric, node_id AS key, count(*)::DOUBLE AS value FROM snapshots WHERE delta >= 0.15 GROUP BY node_id
UNION ALL SELECT 'circuit_trips', bridge_id::VARCHAR, max(trips)::DOUBLE FROM walk GROUP BY bridge_id
UNION ALL SELECT 'active_bridges', '', count(*)::DOUBLE FROM active
UNION ALL SELECT 'registered_nodes', '', count(*)::DOUBLE FROM nodes
UNION ALL SELECT 'buffer_fill', bridge_id::VARCHAR, (arg_max(n, trips) / 5)::DOUBLE FROM holds GROUP BY bridge_id""")
def _(t):
    stated = breaker(t)
    held = rs.hold_while_open(stated, "bridge_id", "t", "event_id", capacity=5)
    return mx.event_counters(snapshots(t).filter("delta >= 0.15"), stated, ln.active(t), ln.nodes(t), held, capacity=5)


@suite.query("status_report", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, ln.ACTIVE, ln.MESSAGES, APPROVALS, SEEN) + f"""
SELECT 'nodes' AS metric, count(*)::DOUBLE AS value FROM nodes UNION ALL SELECT 'active_bridges', count(*) FROM active UNION ALL SELECT 'bridge_queue', count(*) FROM links
UNION ALL SELECT unnest(['staged_approvals', 'pending_approvals']), count(*) FROM decided WHERE kind IS NULL AND t <= {MID_JANUARY} AND t + {24 * HOUR} > {MID_JANUARY}
UNION ALL SELECT 'catalog_nodes', count(*) FROM nodes WHERE protocol = 'rest'
UNION ALL SELECT 'degraded_services', count(*) FROM nodes LEFT JOIN seen USING (node_id) WHERE last_seen IS NULL OR {END_OF_JANUARY} - last_seen > {DAY}
UNION ALL SELECT 'durable', (count(*) = 0)::INT FROM nodes LEFT JOIN seen USING (node_id) WHERE last_seen IS NULL OR {END_OF_JANUARY} - last_seen > {DAY}""")
def _(t):
    from ..operators.policy import approval_queue

    n = ln.nodes(t)
    waiting = approval_queue(*_approvals(t), ["user_id"], MID_JANUARY, timeout=24 * HOUR)
    away = rg.stale_nodes(n, rg.registry_touch(_heartbeats(t)), END_OF_JANUARY, DAY)
    return mx.status_report(n, ln.active(t), queue(t), waiting, n.filter("protocol = 'rest'"), away)


@suite.query("bridge_listing", ln.with_(ln.MESSAGES, SNAP, "users AS (SELECT DISTINCT user_id % 25 AS bridge_id FROM messages)") + """
SELECT bridge_id, messages, errors, round(error_rate, 6) AS error_rate FROM users LEFT JOIN snap USING (bridge_id)""")
def _(t):
    made = ln.messages(t).select((F.col("user_id") % 25).alias("bridge_id")).distinct()
    out = mx.bridge_listing(made, snapshot(t))
    return out.select("bridge_id", "messages", "errors", F.round("error_rate", 6).alias("error_rate"))


@suite.query("node_listing", ln.with_(ln.NODES) + """
SELECT node_id AS id, protocol, role, endpoint, '{"fields":[' || array_to_string(list_transform(range(1, len(names) + 1), lambda i: '{"name":"' || names[i] || '","type":"' || types[i] || '"}'), ',')
  || '],"tags":["' || array_to_string(tags, '","') || '"],"encoding":"json","emission_rate":' || coalesce(rate::VARCHAR, 'null') || ',"confidence":' || confidence || '}' AS contract FROM nodes""")
def _(t):
    return mx.node_listing(ln.nodes(t))


@suite.query("queue_report", ln.with_(ln.PAIRS, ln.LINKS, ln.MESSAGES, APPROVALS) + f"""
SELECT 'bridge_queue_depth' AS metric, count(*)::DOUBLE AS value FROM links
UNION ALL SELECT 'pending_approvals', count(*) FROM decided WHERE kind IS NULL AND t <= {MID_JANUARY} AND t + {24 * HOUR} > {MID_JANUARY}""")
def _(t):
    from ..operators.policy import approval_queue

    return mx.queue_report(queue(t), approval_queue(*_approvals(t), ["user_id"], MID_JANUARY, timeout=24 * HOUR))
