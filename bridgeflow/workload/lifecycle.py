"""Queries of bridge creation, durable bridge state, re-planning and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from . import lenses as ln
from .base import Suite
from .mapping import ALIGN, LOOKUP, SAMPLED, SECRET, mapping_text, sql_hmac
from .policy import LISTS, blacklist

suite = Suite()
NOW = 996710400000000
TOUCHED = "producer_id IN (SELECT node_id FROM blacklist) OR consumer_id IN (SELECT node_id FROM blacklist)"


@suite.query("drift_affected", ln.with_(ln.PAIRS, ln.ACTIVE, LISTS) + f"SELECT * FROM active WHERE {TOUCHED}")
def _(t):
    return lc.drift_affected(ln.active(t), blacklist(t))


ACTIVE_AS_LINKS = "links AS (SELECT * FROM active WHERE " + TOUCHED + ")"


@suite.query("replan_drifted", ln.with_(ln.NODES, ln.PAIRS, ln.ACTIVE, LISTS, ACTIVE_AS_LINKS, ALIGN, recursive=True) + f"""
, {SAMPLED}
SELECT 'plans' AS kind, producer_id, consumer_id, mappings AS detail FROM written WHERE NOT coalesce(starved, false)
UNION ALL SELECT 'events', producer_id, consumer_id, CASE WHEN starved THEN 'bridge_torn' ELSE 'adapter_reloaded' END FROM written
UNION ALL SELECT 'requeue', producer_id, consumer_id, '0.5' FROM written WHERE starved""")
def _(t):
    out = lc.replan_drifted(ln.active(t), blacklist(t), ln.nodes(t), NOW, compat=True)
    row = lambda kind, detail: out[kind].select(F.lit(kind).alias("kind"), "producer_id", "consumer_id", detail.alias("detail"))
    return (row("plans", mapping_text(F.col("mappings"))).unionByName(row("events", F.col("type")))
            .unionByName(row("requeue", F.col("composite").cast("string"))))


def approved(t):
    """Pairs of open orders, approved at the score of their best order."""
    return ln.pairs(t).filter("status = 'O'").groupBy("producer_id", "consumer_id").agg(F.max("score").alias("composite"))


APPROVED = "approved AS (SELECT producer_id, consumer_id, max(score) AS composite FROM pairs WHERE status = 'O' GROUP BY ALL)"
NEW_LINKS = "links AS (SELECT * FROM approved a WHERE NOT EXISTS (SELECT 1 FROM active x WHERE x.producer_id = a.producer_id AND x.consumer_id = a.consumer_id))"


@suite.query("create_bridges", ln.with_(ln.NODES, ln.PAIRS, ln.ACTIVE, APPROVED, NEW_LINKS, ALIGN, recursive=True) + f"""
SELECT producer_id, consumer_id, composite, substr(sha256(producer_id || ':' || consumer_id), 1, 16) AS bridge_id, 'live' AS state,
  {sql_hmac(f"producer_id || ':' || consumer_id || ':0.1.0:{NOW // 1000000}'")} AS provenance, len(hits) AS n_mappings, CASE {LOOKUP} END AS envelope
FROM ends JOIN aligned USING (sn, st, dn, dt) JOIN links USING (producer_id, consumer_id) JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id""")
def _(t):
    made = lc.create_bridges(approved(t), ln.active(t), ln.nodes(t), NOW, SECRET)["bridges"]
    return made.select("producer_id", "consumer_id", "composite", "bridge_id", "state", "provenance", F.size("mappings").cast("long").alias("n_mappings"), "envelope")


def stored(t, status, mark):
    """Bridges as of one order state: the newest line of each pair describes the bridge."""
    rows = ln.pairs(t).filter(F.col("status") == status).groupBy("producer_id", "consumer_id").agg(
        F.max_by(F.struct("seq", "score"), F.struct("created", "seq")).alias("x"), F.min("created").alias("created_at"), F.max("created").alias("updated_at"))
    return rows.select("producer_id", "consumer_id", F.concat(F.lit(mark), F.col("x.seq")).alias("bridge_id"), F.concat(F.lit("adapter-"), F.col("x.seq")).alias("adapter"),
                       F.col("x.score").alias("score"), F.concat(F.lit(mark), F.lit("key")).alias("provenance"), "created_at", "updated_at")


def sql_stored(name: str, status: str, mark: str) -> str:
    return f"""{name} AS (SELECT producer_id, consumer_id, '{mark}' || arg_max(seq, (created, seq)) AS bridge_id, 'adapter-' || arg_max(seq, (created, seq)) AS adapter,
    arg_max(score, (created, seq)) AS score, '{mark}key' AS provenance, min(created) AS created_at, max(created) AS updated_at FROM pairs WHERE status = '{status}' GROUP BY producer_id, consumer_id)"""


@suite.query("bridge_checkpoint", ln.with_(ln.PAIRS, sql_stored("old", "F", "a"), sql_stored("new", "O", "b")) + """
SELECT producer_id, consumer_id, coalesce(n.bridge_id, o.bridge_id) AS bridge_id, coalesce(n.adapter, o.adapter) AS adapter, coalesce(n.score, o.score) AS score,
  coalesce(o.provenance, n.provenance) AS provenance, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
FROM old o FULL JOIN new n USING (producer_id, consumer_id)""")
def _(t):
    return lc.bridge_checkpoint(stored(t, "F", "a"), stored(t, "O", "b"))


@suite.query("bridge_delete", ln.with_(ln.PAIRS, sql_stored("old", "F", "a")) + """
SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.status = 'P' AND p.producer_id = o.producer_id AND p.consumer_id = o.consumer_id)""")
def _(t):
    return lc.bridge_delete(stored(t, "F", "a"), ln.pairs(t).filter("status = 'P'"))


REGISTERED = "producer_id NOT IN (SELECT node_id FROM blacklist) AND consumer_id NOT IN (SELECT node_id FROM blacklist)"


@suite.query("bridge_restore", ln.with_(ln.PAIRS, LISTS, sql_stored("old", "F", "a")) + f"""
SELECT producer_id, consumer_id, bridge_id, created_at, {REGISTERED} AS restored FROM old""")
def _(t):
    nodes = ln.nodes(t).select("node_id").join(blacklist(t), "node_id", "left_anti")
    kept, stale = lc.bridge_restore(stored(t, "F", "a"), nodes)
    part = lambda df, flag: df.select("producer_id", "consumer_id", "bridge_id", "created_at", F.lit(flag).alias("restored"))
    return part(kept, True).unionByName(part(stale, False))


KINDS = {"view": "new_node", "click": "bridge_live", "purchase": "contract_drift", "signup": "bridge_torn", "error": "circuit_trip"}


def log(t):
    m = ln.messages(t)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in KINDS.items()])
    node = m.filter("event_type IN ('view', 'purchase')").select(kind.alias("type"), F.concat(F.lit("u"), F.col("user_id")).alias("node_id"), "t", "event_id")
    bridge = m.filter("event_type NOT IN ('view', 'purchase')").select(kind.alias("type"), F.concat(F.lit("b"), F.col("bridge_id")).alias("bridge_id"), "t", "event_id")
    return lc.event_log([node, bridge])


LOG = f"""log AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS type, t, event_id,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'u' || user_id END AS node_id, CASE WHEN event_type NOT IN ('view', 'purchase') THEN 'b' || bridge_id END AS bridge_id FROM messages)"""


@suite.query("event_log", ln.with_(ln.MESSAGES, LOG) + "SELECT * FROM log")
def _(t):
    return log(t)


@suite.query("events_by_type", ln.with_(ln.MESSAGES, LOG) + "SELECT * FROM log WHERE type IN ('bridge_torn', 'contract_drift')")
def _(t):
    return lc.events_by_type(log(t), "bridge_torn", "contract_drift")
