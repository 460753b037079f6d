"""Queries of the registry, drift and graph tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import registry as rg
from ..session import shared_folder
from . import lenses as ln
from .base import Suite
from .policy import LISTS, blacklist

suite = Suite()
DELTA = "(len(list_distinct(list_concat({o}, {n}))) - len(list_intersect({o}, {n})))::DOUBLE / greatest(len(list_distinct(list_concat({o}, {n}))), 1)"


@suite.query("register_or_drift", ln.with_(ln.SAMPLES, f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY turn) AS rn FROM samples),
walk AS (
  SELECT node_id, turn, rn, names AS accepted, tags AS accepted_tags, 'new' AS action, 0.0::DOUBLE AS delta FROM numbered WHERE rn = 1
  UNION ALL
  SELECT node_id, turn, rn, CASE WHEN d >= 0.15 THEN names ELSE accepted END, CASE WHEN d >= 0.15 THEN tags ELSE accepted_tags END,
    CASE WHEN d >= 0.15 THEN 'drift' ELSE 'touch' END, d
  FROM (SELECT n.*, w.accepted, w.accepted_tags, CASE WHEN n.names = w.accepted AND n.tags = w.accepted_tags THEN 0.0 ELSE {DELTA.format(o='w.accepted', n='n.names')} END AS d
    FROM walk w JOIN numbered n ON n.node_id = w.node_id AND n.rn = w.rn + 1))""", recursive=True) + """
SELECT node_id, turn, action, round(delta, 6) AS delta FROM walk""")
def _(t):
    made = rg.register_or_drift(ln.samples(t), ["turn"])
    return made.select("node_id", "turn", "action", F.round("delta", 6).alias("delta"))


def snapshots(t):
    return rg.drift_delta(ln.samples(t), "turn", F.floor(F.col("turn") / 1000)).select(
        "node_id", "turn", F.round("delta", 6).alias("delta"), "n_chars")


SNAPSHOTS = f"""lagged AS (SELECT *, lag(names) OVER (PARTITION BY node_id ORDER BY turn) AS old FROM samples),
snapshots AS (SELECT node_id, turn, round(CASE WHEN old IS NULL THEN 0.0 ELSE {DELTA.format(o='old', n='names')} END, 6)::DOUBLE AS delta, n_chars FROM lagged)"""


@suite.query("drift_delta", ln.with_(ln.SAMPLES, SNAPSHOTS) + "SELECT * FROM snapshots")
def _(t):
    return snapshots(t)


def sql_last(n: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY turn DESC) AS age FROM snapshots) WHERE age <= {n}"


@suite.query("drift_history", ln.with_(ln.SAMPLES, SNAPSHOTS) + sql_last(256))
def _(t):
    return rg.drift_history(snapshots(t), "turn")


@suite.query("drift_recent", ln.with_(ln.SAMPLES, SNAPSHOTS) + sql_last(2))
def _(t):
    return rg.drift_recent(snapshots(t), "turn", 2)


LATEST = "latest AS (SELECT node_id, max(turn) AS turn, arg_max(delta, turn) AS delta, arg_max(n_chars, turn) AS n_chars FROM snapshots GROUP BY node_id)"


@suite.query("drift_latest", ln.with_(ln.SAMPLES, SNAPSHOTS, LATEST) + "SELECT * FROM latest")
def _(t):
    return rg.drift_latest(snapshots(t), "turn")


@suite.query("drifted_nodes", ln.with_(ln.SAMPLES, SNAPSHOTS, LATEST) + "SELECT node_id, delta FROM latest WHERE delta >= 0.15")
def _(t):
    return rg.drifted_nodes(snapshots(t), "turn")


END_OF_JANUARY = 1706659200000000
WEEK = 7 * 86_400_000_000


@suite.query("drift_retention", ln.with_(ln.MESSAGES) + f"SELECT event_id, t FROM messages WHERE t >= {END_OF_JANUARY - WEEK}")
def _(t):
    log = ln.messages(t).select("event_id", "t")
    return rg.write_retained(log, f"{shared_folder(t.spark)}/log-{uuid4().hex}", "t", END_OF_JANUARY)


@suite.query("drift_purge_report", ln.with_(ln.MESSAGES) + f"""
SELECT t // 86400000000 AS day, count(*) FILTER (t >= {END_OF_JANUARY - WEEK}) AS kept, count(*) FILTER (t < {END_OF_JANUARY - WEEK}) AS deleted FROM messages GROUP BY 1""")
def _(t):
    return rg.purge_report(ln.messages(t), "t", END_OF_JANUARY)


@suite.query("registry_upsert", ln.with_(ln.NODES, ln.PAIRS) + """
, versions AS (SELECT node_id, '' AS version, endpoint FROM nodes UNION ALL SELECT producer_id, seq, 'order://' || seq FROM pairs)
SELECT node_id, max(version) AS version, arg_max(endpoint, version) AS endpoint FROM versions GROUP BY node_id""")
def _(t):
    base = ln.nodes(t).select("node_id", F.lit("").alias("version"), "endpoint")
    updates = ln.pairs(t).select(F.col("producer_id").alias("node_id"), F.col("seq").alias("version"), F.concat(F.lit("order://"), "seq").alias("endpoint"))
    return rg.registry_upsert(base, updates, "version")


ASKED = "asked AS (SELECT DISTINCT producer_id AS node_id FROM pairs UNION ALL SELECT DISTINCT 'x' || consumer_id FROM pairs)"


@suite.query("registry_lookup", ln.with_(ln.NODES, ln.PAIRS, ASKED) + """
SELECT node_id, protocol, endpoint, n.k IS NOT NULL AS found FROM asked LEFT JOIN nodes n USING (node_id)""")
def _(t):
    p = ln.pairs(t)
    asked = p.select(F.col("producer_id").alias("node_id")).distinct().unionByName(p.select(F.concat(F.lit("x"), "consumer_id").alias("node_id")).distinct())
    return rg.registry_lookup(asked, ln.nodes(t).select("node_id", "protocol", "endpoint"))


def _mixed_roles(t):
    return ln.nodes(t).select("node_id", F.when(F.col("protocol") == "kafka", "both").otherwise(F.col("role")).alias("role"))


@suite.query("registry_roles", ln.with_(ln.NODES, "mixed AS (SELECT node_id, CASE WHEN protocol = 'kafka' THEN 'both' ELSE role END AS role FROM nodes)") + """
SELECT node_id, 'producer' AS side FROM mixed WHERE role IN ('producer', 'both') UNION ALL SELECT node_id, 'consumer' FROM mixed WHERE role IN ('consumer', 'both')""")
def _(t):
    n = _mixed_roles(t)
    side = lambda df, name: df.select("node_id", F.lit(name).alias("side"))
    return side(rg.producers(n), "producer").unionByName(side(rg.consumers(n), "consumer"))


def _heartbeats(t):
    return ln.messages(t).select(F.concat(F.lit("c"), F.col("user_id")).alias("node_id"), "t")


SEEN = "seen AS (SELECT 'c' || user_id AS node_id, max(t) AS last_seen FROM messages GROUP BY user_id)"


@suite.query("registry_touch", ln.with_(ln.MESSAGES, SEEN) + "SELECT * FROM seen")
def _(t):
    return rg.registry_touch(_heartbeats(t))


DAY = 86_400_000_000


@suite.query("stale_nodes", ln.with_(ln.MESSAGES, ln.NODES, SEEN) + f"""
SELECT node_id, last_seen FROM nodes LEFT JOIN seen USING (node_id) WHERE last_seen IS NULL OR {END_OF_JANUARY} - last_seen > {DAY}""")
def _(t):
    return rg.stale_nodes(ln.nodes(t), rg.registry_touch(_heartbeats(t)), END_OF_JANUARY, DAY)


GONE = "NOT IN (SELECT node_id FROM blacklist)"


@suite.query("deregister_cascade", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, ln.ACTIVE, LISTS) + f"""
SELECT 'nodes' AS kind, node_id AS a, '' AS b FROM nodes WHERE node_id {GONE}
UNION ALL SELECT 'edges', producer_id, consumer_id FROM links WHERE producer_id {GONE} AND consumer_id {GONE}
UNION ALL SELECT 'snapshots', node_id, '0' FROM nodes WHERE node_id {GONE}
UNION ALL SELECT 'affected', producer_id, consumer_id FROM active WHERE NOT (producer_id {GONE} AND consumer_id {GONE})""")
def _(t):
    n = ln.nodes(t)
    snaps = n.select("node_id", F.lit("0").alias("delta"))
    out = rg.deregister_cascade(blacklist(t), n.select("node_id"), ln.links(t), snaps, ln.active(t))
    row = lambda kind, a, b: out[kind].select(F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b"))
    return (row("nodes", "node_id", None).unionByName(row("edges", "producer_id", "consumer_id"))
            .unionByName(row("snapshots", "node_id", "delta")).unionByName(row("affected", "producer_id", "consumer_id")))


def edges(t):
    return rg.edges_upsert(ln.pairs(t).withColumnRenamed("score", "weight"), ["created", "seq"])


EDGES = "edges AS (SELECT producer_id, consumer_id, arg_max(score, (created, seq)) AS weight FROM pairs GROUP BY ALL)"


@suite.query("edges_upsert", ln.with_(ln.PAIRS, EDGES) + "SELECT * FROM edges")
def _(t):
    return edges(t)


@suite.query("edge_weight", ln.with_(ln.PAIRS, ln.LINKS, EDGES) + """
, asked AS (SELECT * FROM links UNION ALL SELECT consumer_id, producer_id FROM links)
SELECT producer_id, consumer_id, coalesce(weight, 0.0) AS weight FROM asked LEFT JOIN edges USING (producer_id, consumer_id)""")
def _(t):
    l = ln.links(t)
    asked = l.unionByName(l.select(F.col("consumer_id").alias("producer_id"), F.col("producer_id").alias("consumer_id")))
    return rg.edge_weight(asked, edges(t))


@suite.query("reweight_edges", ln.with_(ln.PAIRS, EDGES, LISTS) + f"""
SELECT producer_id, consumer_id, CASE WHEN producer_id {GONE} AND consumer_id {GONE} THEN weight ELSE 0.0 END AS weight FROM edges""")
def _(t):
    return rg.reweight_edges(edges(t), blacklist(t))


@suite.query("graph_remove_node", ln.with_(ln.PAIRS, EDGES, LISTS) + f"SELECT * FROM edges WHERE producer_id {GONE} AND consumer_id {GONE}")
def _(t):
    return rg.graph_remove_node(edges(t), blacklist(t))


@suite.query("graph_pairs", ln.with_(ln.PAIRS, ln.LINKS) + "SELECT * FROM links")
def _(t):
    return rg.graph_pairs(ln.pairs(t))


@suite.query("graph_neighbors", ln.with_(ln.PAIRS, ln.LINKS) + "SELECT producer_id AS node_id, consumer_id AS neighbor FROM links")
def _(t):
    return rg.graph_neighbors(ln.pairs(t))


@suite.query("graph_nodes", ln.with_(ln.NODES, ln.PAIRS) + """
SELECT node_id FROM nodes UNION SELECT 'x' || producer_id FROM pairs UNION SELECT consumer_id FROM pairs""")
def _(t):
    e = ln.pairs(t).select(F.concat(F.lit("x"), "producer_id").alias("producer_id"), "consumer_id")
    return rg.graph_nodes(ln.nodes(t), e)
