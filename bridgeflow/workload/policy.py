"""Queries of the gates, approvals and audit."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import mapping as mp
from ..operators import policy as pl
from ..session import shared_folder
from . import lenses as ln
from .base import Suite
from .matching import ENDS, RISK

suite = Suite()
HOUR = 3_600_000_000
ZONES = {"internal": ["*.net*"], "partner": ["*.com*", "1?7"]}
AUTO = [("internal", "partner")]
ALLOWED = ["*example.net*", "http://*.com/*", "1[0-4]?", "2[!0-4]*"]
RULES = pl.SecurityRules(extra_refused=["*/FR/*"], allowlist=ALLOWED, zones=ZONES, auto_approved=AUTO)


def sql_refuse(endpoint: str) -> str:
    globs = fixed.REFUSED_GLOBS + RULES.extra_refused
    return "CASE " + " ".join(f"WHEN lower({endpoint}) GLOB '{g.lower()}' THEN 'hard-refuse-pattern:{g}'" for g in globs) + " END"


def sql_any(node: str, endpoint: str, globs: list[str]) -> str:
    return "(" + " OR ".join(f"{x} GLOB '{g}'" for g in globs for x in (node, endpoint)) + ")"


def sql_zone(node: str, endpoint: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(node, endpoint, globs)} THEN '{z}'" for z, globs in ZONES.items()) + " ELSE 'default' END"


@suite.query("hard_refuse", ln.with_(ln.ENDPOINTS) + f"SELECT node_id, endpoint, {sql_refuse('endpoint')} AS reason FROM endpoints")
def _(t):
    return ln.endpoints(t).select("node_id", "endpoint", pl.hard_refuse(F.col("endpoint"), RULES).alias("reason"))


@suite.query("allowlist", ln.with_(ln.ENDPOINTS) + f"""
SELECT node_id, CASE WHEN NOT {sql_any('node_id', 'endpoint', ALLOWED)} THEN 'not-in-source-allowlist:' || node_id[1:16] END AS reason FROM endpoints""")
def _(t):
    return ln.endpoints(t).select("node_id", pl.allowlist_reason(F.col("node_id"), F.col("endpoint"), RULES).alias("reason"))


@suite.query("zone_of", ln.with_(ln.ENDPOINTS) + f"SELECT node_id, {sql_zone('node_id', 'endpoint')} AS zone FROM endpoints")
def _(t):
    return ln.endpoints(t).select("node_id", pl.zone_of(F.col("node_id"), F.col("endpoint"), RULES).alias("zone"))


def _page_pairs(t):
    """Each page with the next one."""
    e = ln.endpoints(t)
    nxt = e.select((F.col("page_id") - 1).alias("page_id"), F.col("node_id").alias("consumer_id"), F.col("endpoint").alias("consumer_endpoint"))
    return e.withColumnsRenamed({"node_id": "producer_id", "endpoint": "producer_endpoint"}).join(nxt, "page_id").drop("page_id")


PAGE_PAIRS = f"""page_pairs AS (
  SELECT a.node_id AS producer_id, b.node_id AS consumer_id, a.endpoint AS pe, b.endpoint AS ce,
    {sql_zone('a.node_id', 'a.endpoint')} AS p_zone, {sql_zone('b.node_id', 'b.endpoint')} AS c_zone
  FROM endpoints a JOIN endpoints b ON b.page_id = a.page_id + 1),
zoned AS (SELECT *, p_zone <> c_zone AND NOT (least(p_zone, c_zone) = 'internal' AND greatest(p_zone, c_zone) = 'partner') AS needs FROM page_pairs)"""


@suite.query("cross_zone", ln.with_(ln.ENDPOINTS, PAGE_PAIRS) + """
SELECT producer_id, consumer_id, p_zone, c_zone, needs AS needs_approval,
  CASE WHEN needs THEN 'cross-zone-bridge:' || p_zone || '→' || c_zone ELSE 'same-zone-or-approved:' || p_zone || '↔' || c_zone END AS zone_reason FROM zoned""")
def _(t):
    return pl.cross_zone(_page_pairs(t), RULES).select("producer_id", "consumer_id", "p_zone", "c_zone", "needs_approval", "zone_reason")


@suite.query("security_gate", ln.with_(ln.ENDPOINTS, PAGE_PAIRS) + f"""
, marked AS (SELECT *, coalesce('producer:' || {sql_refuse('pe')}, 'consumer:' || {sql_refuse('ce')},
    CASE WHEN NOT {sql_any('producer_id', 'pe', ALLOWED)} THEN 'not-in-source-allowlist:' || producer_id[1:16] END) AS refused FROM zoned)
SELECT producer_id, consumer_id, CASE WHEN refused IS NOT NULL THEN 'hard_reject' WHEN needs THEN 'stage' ELSE 'allow' END AS security,
  coalesce(refused, CASE WHEN needs THEN 'cross-zone-bridge:' || p_zone || '→' || c_zone ELSE 'same-zone-or-approved:' || p_zone || '↔' || c_zone END) AS reason FROM marked""")
def _(t):
    return pl.security_gate(_page_pairs(t), RULES).select("producer_id", "consumer_id", "security", F.col("security_reason").alias("reason"))


LISTS = """blacklist AS (SELECT 'p' || s_suppkey AS node_id FROM supplier WHERE s_acctbal < 0 UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0),
whitelist AS (SELECT 'p' || s_suppkey AS node_id FROM supplier WHERE s_acctbal > 7000 UNION SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 7000)"""


def _listed(t, condition):
    ids = lambda df, prefix, key, balance: df.filter(condition(F.col(balance))).select(F.concat(F.lit(prefix), F.col(key)).alias("node_id"))
    return ids(t.supplier, "p", "s_suppkey", "s_acctbal").unionByName(ids(t.customer, "c", "c_custkey", "c_acctbal"))


def blacklist(t):
    return _listed(t, lambda b: b < 0)


def whitelist(t):
    return _listed(t, lambda b: b > 7000)


BLACK_REASON = """CASE WHEN producer_id IN (SELECT node_id FROM blacklist) THEN 'blacklisted-producer:' || producer_id
  WHEN consumer_id IN (SELECT node_id FROM blacklist) THEN 'blacklisted-consumer:' || consumer_id END"""
WHITE = "producer_id IN (SELECT node_id FROM whitelist) AND consumer_id IN (SELECT node_id FROM whitelist)"


@suite.query("gate_blacklist", ln.with_(ln.PAIRS, ln.LINKS, LISTS) + f"SELECT producer_id, consumer_id, {BLACK_REASON} AS blacklist_reason FROM links")
def _(t):
    return pl.gate_blacklist(ln.links(t), blacklist(t)).select("producer_id", "consumer_id", "blacklist_reason")


@suite.query("gate_whitelist", ln.with_(ln.PAIRS, ln.LINKS, LISTS) + f"SELECT producer_id, consumer_id, {WHITE} AS both_whitelisted FROM links")
def _(t):
    return pl.gate_whitelist(ln.links(t), whitelist(t)).select("producer_id", "consumer_id", "both_whitelisted")


CAP = 165
COUNTS = """node_bridges AS (SELECT node_id, count(*) AS n FROM (SELECT producer_id AS node_id FROM active UNION ALL SELECT consumer_id FROM active) GROUP BY node_id)"""


@suite.query("gate_bridge_cap", ln.with_(ln.PAIRS, ln.LINKS, ln.ACTIVE, COUNTS) + f"""
SELECT producer_id, consumer_id, coalesce(a.n, 0) AS p_bridges, coalesce(b.n, 0) AS c_bridges,
  CASE WHEN a.n >= {CAP} THEN 'producer-bridge-cap' WHEN b.n >= {CAP} THEN 'consumer-bridge-cap' END AS cap_reason
FROM links LEFT JOIN node_bridges a ON a.node_id = producer_id LEFT JOIN node_bridges b ON b.node_id = consumer_id""")
def _(t):
    return pl.gate_bridge_cap(ln.links(t), ln.active(t), CAP)


def _mesh(t):
    """Part-to-supplier traffic as pairs of one id space, and its reverse as active bridges."""
    name = lambda c: F.concat(F.lit("n"), F.col(c))
    rows = t.lineitem
    asked = rows.filter("l_linestatus = 'O'").select(name("l_suppkey").alias("producer_id"), name("l_partkey").alias("consumer_id")).distinct()
    live = rows.filter("l_linestatus = 'F'").select(name("l_suppkey").alias("producer_id"), name("l_partkey").alias("consumer_id")).distinct()
    return asked, live


MESH = """mesh_asked AS (SELECT DISTINCT 'n' || l_suppkey AS producer_id, 'n' || l_partkey AS consumer_id FROM lineitem WHERE l_linestatus = 'O'),
mesh_live AS (SELECT DISTINCT 'n' || l_suppkey AS producer_id, 'n' || l_partkey AS consumer_id FROM lineitem WHERE l_linestatus = 'F')"""


@suite.query("gate_circular", ln.with_(MESH) + """
SELECT producer_id, consumer_id, EXISTS (SELECT 1 FROM mesh_live l WHERE l.producer_id = a.consumer_id AND l.consumer_id = a.producer_id) AS is_circular FROM mesh_asked a""")
def _(t):
    return pl.gate_circular(*_mesh(t))


@suite.query("gate_confidence", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS) + f"SELECT producer_id, consumer_id, p.confidence < 0.3 AS too_weak FROM {ENDS}")
def _(t):
    return mp._two_ends(ln.links(t), ln.nodes(t), ["confidence"]).select("producer_id", "consumer_id", (F.col("p_confidence") < 0.3).alias("too_weak"))


RATIO = """greatest(coalesce(p.rate, 1.0), coalesce(c.rate, p.rate, 1.0)) / greatest(least(coalesce(p.rate, 1.0), coalesce(c.rate, p.rate, 1.0)), 1e-6)"""


@suite.query("gate_rate_mismatch", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS) + f"""
SELECT producer_id, consumer_id, round({RATIO}, 3) AS ratio, {RATIO} > 1000 AS mismatch FROM {ENDS}""")
def _(t):
    ends = mp._two_ends(ln.links(t), ln.nodes(t), ["rate"]).withColumn("ratio", pl.rate_ratio(F.col("p_rate"), F.col("c_rate")))
    return ends.select("producer_id", "consumer_id", F.round("ratio", 3).alias("ratio"), (F.col("ratio") > 1000).alias("mismatch"))


LISTED_RISK = RISK.replace("p.node_id IN ('p1', 'c1') OR c.node_id IN ('p1', 'c1')", "p.node_id IN (SELECT node_id FROM blacklist) OR c.node_id IN (SELECT node_id FROM blacklist)")


@suite.query("gate_risk", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, LISTS) + f"SELECT producer_id, consumer_id, {LISTED_RISK} >= 0.7 AS staged FROM {ENDS}")
def _(t):
    ends = pl.gate_blacklist(mp._two_ends(ln.links(t), ln.nodes(t), ["protocol", "confidence"]), blacklist(t))
    c = F.col
    risk = pl.quick_risk(c("p_listed"), c("c_listed"), c("p_protocol"), c("c_protocol"), c("p_confidence"), c("c_confidence"))
    return ends.select("producer_id", "consumer_id", (risk >= 0.7).alias("staged"))


# all attempts in time order; an accepted one is remembered for both ends
ATTEMPT_WALK = ln.with_(ln.MESSAGES, f"""numbered AS (SELECT 'u' || user_id AS producer_id, 'b' || bridge_id AS consumer_id, t, event_id AS seq,
    row_number() OVER (ORDER BY t, event_id) AS rn FROM messages),
walk AS (
  SELECT 0::BIGINT AS rn, NULL::VARCHAR AS blocked_by, []::STRUCT(n VARCHAR, t BIGINT)[] AS live
  UNION ALL
  SELECT rn, full_, CASE WHEN full_ IS NULL THEN list_concat(kept, [{{'n': producer_id, 't': t}}, {{'n': consumer_id, 't': t}}]) ELSE kept END
  FROM (SELECT *, CASE WHEN len(list_filter(kept, lambda x: x.n = producer_id)) >= 10 THEN producer_id
      WHEN len(list_filter(kept, lambda x: x.n = consumer_id)) >= 10 THEN consumer_id END AS full_
    FROM (SELECT n.*, list_filter(w.live, lambda x: n.t - x.t < {48 * HOUR}) AS kept FROM walk w JOIN numbered n ON n.rn = w.rn + 1)))""", recursive=True)


@suite.query("gate_attempt_rate", ATTEMPT_WALK + "SELECT producer_id, consumer_id, t, seq, blocked_by FROM walk JOIN numbered USING (rn)")
def _(t):
    rows = ln.messages(t).select(F.concat(F.lit("u"), F.col("user_id")).alias("producer_id"), F.concat(F.lit("b"), F.col("bridge_id")).alias("consumer_id"),
                                 "t", F.col("event_id").alias("seq"))
    return pl.gate_attempt_rate(rows, limit=10, window=48 * HOUR)


@suite.query("evaluate_policy", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, ln.ACTIVE, LISTS, COUNTS) + f"""
, zone_nodes AS (SELECT *, CASE WHEN endpoint GLOB 'kafka://*' THEN 'bus' WHEN endpoint GLOB 'database://*' THEN 'store' ELSE 'default' END AS zone FROM nodes),
asked AS (SELECT producer_id, consumer_id FROM links UNION ALL SELECT 'x' || producer_id, consumer_id FROM links),
facts AS (
  SELECT asked.*, p.node_id IS NULL OR c.node_id IS NULL AS missing, p.zone AS pz, c.zone AS cz, p.endpoint AS pe, c.endpoint AS ce,
    {BLACK_REASON} AS black, {WHITE} AS white, a.n AS pn, b.n AS cn, p.confidence AS conf, {RATIO} AS ratio, {LISTED_RISK} AS risk
  FROM asked LEFT JOIN zone_nodes p ON p.node_id = producer_id LEFT JOIN zone_nodes c ON c.node_id = consumer_id
  LEFT JOIN node_bridges a ON a.node_id = producer_id LEFT JOIN node_bridges b ON b.node_id = consumer_id),
coded AS (SELECT *, CASE WHEN missing THEN 0 WHEN pe GLOB 'mavlink://*' THEN 1 WHEN ce GLOB 'mavlink://*' THEN 2
    WHEN pz <> cz AND NOT (pz IN ('bus', 'default') AND cz IN ('bus', 'default')) THEN 3 WHEN black IS NOT NULL THEN 4 WHEN white THEN 5 WHEN pn >= {CAP} THEN 6
    WHEN cn >= {CAP} THEN 7 WHEN conf < 0.3 THEN 8 WHEN ratio > 1000 THEN 9 WHEN risk >= 0.3 THEN 10 ELSE 11 END AS code FROM facts)
SELECT producer_id, consumer_id, CASE WHEN code IN (3, 9, 10) THEN 'stage' WHEN code IN (5, 11) THEN 'approve' ELSE 'reject' END AS verdict,
  CASE code WHEN 0 THEN 'node-not-found' WHEN 1 THEN 'producer:hard-refuse-pattern:mavlink://*' WHEN 2 THEN 'consumer:hard-refuse-pattern:mavlink://*'
    WHEN 3 THEN 'cross-zone-bridge:' || pz || '→' || cz WHEN 4 THEN black WHEN 5 THEN 'both-whitelisted' WHEN 6 THEN 'producer-bridge-cap' WHEN 7 THEN 'consumer-bridge-cap'
    WHEN 8 THEN 'low-confidence-contract' WHEN 9 THEN 'extreme-rate-mismatch' WHEN 10 THEN 'risk:' || printf('%.2f', risk) ELSE 'all-checks-passed' END AS reason,
  CASE code WHEN 0 THEN 'node-not-found' WHEN 1 THEN 'producer:hard-refuse-pattern:mavlink://*' WHEN 2 THEN 'consumer:hard-refuse-pattern:mavlink://*'
    WHEN 3 THEN 'cross-zone-bridge:' || pz || '→' || cz WHEN 4 THEN black WHEN 5 THEN 'both-whitelisted' WHEN 6 THEN 'producer-bridge-cap:' || pn WHEN 7 THEN 'consumer-bridge-cap:' || cn
    WHEN 8 THEN 'low-confidence-producer-contract' WHEN 9 THEN 'extreme-rate-mismatch:' || round(ratio)::BIGINT || 'x' WHEN 10 THEN 'risk-threshold:' || printf('%.2f', risk) ELSE 'all-checks-passed' END AS audit_reason,
  round(CASE code WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0.8 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 0.5 WHEN 7 THEN 0.5 WHEN 8 THEN 0.6 WHEN 9 THEN 0.7 ELSE risk END, 6)::DOUBLE AS risk
FROM coded""")
def _(t):
    unknown = F.concat(F.lit("x"), "producer_id")
    asked = ln.links(t).select(F.explode(F.array("producer_id", unknown)).alias("producer_id"), "consumer_id")
    rules = pl.SecurityRules(extra_refused=["mavlink://*"], zones={"bus": ["kafka://*"], "store": ["database://*"]}, auto_approved=[("default", "bus")])
    made = pl.evaluate_policy(asked, ln.nodes(t), ln.active(t), rules, blacklist(t), whitelist(t), cap=CAP, stage_risk=0.3)
    return made.withColumn("risk", F.round("risk", 6))


def _approvals(t):
    """Purchases wait for the next signup (approve) or error (reject) of their user."""
    m = ln.messages(t).select("user_id", "t", F.col("event_id").alias("seq"), "event_type")
    staged = m.filter("event_type = 'purchase'").drop("event_type")
    decided = m.filter("event_type IN ('signup', 'error')").withColumn("approved", F.col("event_type") == "signup").drop("event_type")
    return staged, decided


APPROVALS = f"""staged AS (SELECT user_id, t, event_id AS seq FROM messages WHERE event_type = 'purchase'),
decided AS (SELECT s.*, arg_min(d.event_type, d.t) AS kind, min(d.t) AS at_ FROM staged s LEFT JOIN messages d ON d.user_id = s.user_id
  AND d.event_type IN ('signup', 'error') AND d.t > s.t AND d.t <= s.t + {24 * HOUR} GROUP BY ALL)"""


@suite.query("resolve_approvals", ln.with_(ln.MESSAGES, APPROVALS) + """
SELECT user_id, t, seq, at_ AS decided_at, CASE kind WHEN 'signup' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'timed_out' END AS outcome FROM decided""")
def _(t):
    return pl.resolve_approvals(*_approvals(t), ["user_id"], timeout=24 * HOUR)


MID_JANUARY = 1705276800000000


@suite.query("approval_queue", ln.with_(ln.MESSAGES, APPROVALS) + f"""
SELECT user_id, t, seq FROM decided WHERE kind IS NULL AND t <= {MID_JANUARY} AND t + {24 * HOUR} > {MID_JANUARY}""")
def _(t):
    return pl.approval_queue(*_approvals(t), ["user_id"], MID_JANUARY, timeout=24 * HOUR)


def audit_log(t):
    m = ln.messages(t)
    verdict = F.when(F.col("is_error"), "reject").when(F.col("event_type") == "signup", "stage").otherwise("approve")
    rows = m.select("event_id", "t", verdict.alias("verdict"), F.concat(F.lit("u"), F.col("user_id")).alias("producer_id"),
                    F.concat(F.lit("b"), F.col("bridge_id")).alias("consumer_id"), (F.col("value") / 1000).alias("composite"), F.col("text").alias("audit_reason"))
    return pl.audit_rows(rows, F.col("t"))


AUDIT = """audit AS (SELECT t AS recorded_at, CASE WHEN is_error THEN 'REJECT' WHEN event_type = 'signup' THEN 'STAGE' ELSE 'APPROVE' END AS verdict,
  'u' || user_id AS producer_id, 'b' || bridge_id AS consumer_id, value / 1000 AS score, text AS reason FROM messages)"""


@suite.query("audit_append", ln.with_(ln.MESSAGES, AUDIT) + "SELECT * FROM audit")
def _(t):
    log = audit_log(t)
    path = f"{shared_folder(t.spark)}/audit-{uuid4().hex}"
    for _ in range(2):  # a batch that runs again replaces its rows
        pl.audit_append(log, path, "first")
    return t.spark.read.parquet(path).select(*log.columns)


@suite.query("audit_recent", ln.with_(ln.MESSAGES, AUDIT) + """SELECT * FROM audit
ORDER BY recorded_at DESC, verdict NULLS FIRST, producer_id NULLS FIRST, consumer_id NULLS FIRST, score NULLS FIRST, reason NULLS FIRST LIMIT 100""")
def _(t):
    return pl.audit_recent(audit_log(t), 100)
