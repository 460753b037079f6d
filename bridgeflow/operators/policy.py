"""Security and policy gates, approvals and the audit log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.text import any_glob, matches_glob
from ..scale import next_match
from ..session import durable, shuffled
from .attempts import PAST, SURE, WANTS, ONLY_ASKS, gate_attempt_rate, settle
from .matching import first_pairs, node_classes, quick_risk


@dataclass
class SecurityRules:
    """Endpoint globs; lists are short, written by operators, and compiled to regular expressions."""

    refuse: bool = True
    extra_refused: list[str] = field(default_factory=list)
    allowlist: list[str] = field(default_factory=list)
    zones: dict[str, list[str]] = field(default_factory=dict)
    auto_approved: list[tuple[str, str]] = field(default_factory=list)


# ---- security ------------------------------------------------------------------

def hard_refuse(endpoint: Column, rules: SecurityRules) -> Column:
    """Reason for never bridging an endpoint, else null."""
    if not rules.refuse:
        return F.lit(None).cast("string")
    low = F.lower(endpoint)
    hits = [F.when(matches_glob(low, g.lower()), F.lit("hard-refuse-pattern:" + g)) for g in fixed.REFUSED_GLOBS + rules.extra_refused]
    return F.coalesce(*hits)


def allowlist_reason(node_id: Column, endpoint: Column, rules: SecurityRules) -> Column:
    """Reason for refusing a producer outside a non-empty allowlist, else null."""
    globs = [g.strip() for g in rules.allowlist if g.strip()]
    if not globs:
        return F.lit(None).cast("string")
    allowed = any_glob(node_id, globs) | any_glob(endpoint, globs)
    return F.when(~allowed, F.concat(F.lit("not-in-source-allowlist:"), F.substring(node_id, 1, 16)))


def zone_of(node_id: Column, endpoint: Column, rules: SecurityRules) -> Column:
    hits = [F.when(any_glob(node_id, globs) | any_glob(endpoint, globs), F.lit(zone)) for zone, globs in rules.zones.items()]
    return F.coalesce(*hits, F.lit("default"))


def needs_approval(p_zone: Column, c_zone: Column, rules: SecurityRules) -> Column:
    approved = [((p_zone == a) & (c_zone == b)) | ((p_zone == b) & (c_zone == a)) for a, b in rules.auto_approved]
    out = p_zone != c_zone
    for a in approved:
        out = out & ~a
    return out


def node_security(df: DataFrame, rules: SecurityRules, node_id: str, endpoint: str, mark: str) -> DataFrame:
    """``refused``, ``unlisted`` and ``zone`` of a node; they depend on the node alone."""
    n, e = F.col(node_id), F.col(endpoint)
    return df.withColumns({mark + "refused": hard_refuse(e, rules), mark + "unlisted": allowlist_reason(n, e, rules),
                           mark + "zone": zone_of(n, e, rules)})


def _pair_security(pairs: DataFrame, rules: SecurityRules) -> DataFrame:
    """``needs_approval``, ``security`` and reasons from the node columns of both ends."""
    needs = needs_approval(F.col("p_zone"), F.col("c_zone"), rules)
    crossed = F.concat(F.lit("cross-zone-bridge:"), "p_zone", F.lit("→"), "c_zone")
    inside = F.concat(F.lit("same-zone-or-approved:"), "p_zone", F.lit("↔"), "c_zone")
    refused = F.coalesce(F.concat(F.lit("producer:"), "p_refused"), F.concat(F.lit("consumer:"), "c_refused"), "p_unlisted")
    out = pairs.withColumns({"needs_approval": needs, "__refused": refused})
    out = out.withColumn("zone_reason", F.when(F.col("needs_approval"), crossed).otherwise(inside))
    return out.withColumns({
        "security": F.when(F.col("__refused").isNotNull(), "hard_reject").when(F.col("needs_approval"), "stage").otherwise("allow"),
        "security_reason": F.coalesce("__refused", "zone_reason")}).drop("__refused")


def cross_zone(pairs: DataFrame, rules: SecurityRules) -> DataFrame:
    """Zones of both ends, whether a human must approve, and the reason."""
    return security_gate(pairs, rules).drop("security", "security_reason")


def security_gate(pairs: DataFrame, rules: SecurityRules) -> DataFrame:
    """``security`` (hard_reject, stage, allow) and its reason: refused, not allowed, then zones."""
    marked = node_security(pairs, rules, "producer_id", "producer_endpoint", "p_")
    marked = node_security(marked, rules, "consumer_id", "consumer_endpoint", "c_")
    return _pair_security(marked, rules).drop("p_refused", "c_refused", "p_unlisted", "c_unlisted")


# ---- node gates ------------------------------------------------------------------

def _marked(pairs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Flags ``p_<name>`` and ``c_<name>``: whether each end is in ``ids`` (node_id)."""
    for end, key in (("p_", "producer_id"), ("c_", "consumer_id")):
        known = ids.select(F.col("node_id").alias(key), F.lit(True).alias(end + name)).distinct()
        pairs = pairs.join(shuffled(known), key, "left").withColumn(end + name, F.coalesce(end + name, F.lit(False)))
    return pairs


def gate_blacklist(pairs: DataFrame, blacklist: DataFrame) -> DataFrame:
    """``blacklist_reason`` of a pair with a blacklisted end, producer first."""
    return _marked(pairs, blacklist, "listed").withColumn("blacklist_reason", _blacklist_reason())


def _blacklist_reason() -> Column:
    return (F.when(F.col("p_listed"), F.concat(F.lit("blacklisted-producer:"), "producer_id"))
            .when(F.col("c_listed"), F.concat(F.lit("blacklisted-consumer:"), "consumer_id")))


def gate_whitelist(pairs: DataFrame, whitelist: DataFrame) -> DataFrame:
    marked = _marked(pairs, whitelist, "trusted")
    return marked.withColumn("both_whitelisted", F.col("p_trusted") & F.col("c_trusted"))


def bridges_per_node(active: DataFrame) -> DataFrame:
    """Active bridges touching each node; a bridge from a node to itself counts once."""
    ends = active.select("producer_id", "consumer_id").distinct().select(
        F.explode(F.array_distinct(F.array("producer_id", "consumer_id"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("bridges"))


def gate_bridge_cap(pairs: DataFrame, active: DataFrame, cap: int = fixed.MAX_BRIDGES_PER_NODE) -> DataFrame:
    """``cap_reason`` of a pair with a full end, producer first."""
    counts = bridges_per_node(active)
    for end, key in (("p_", "producer_id"), ("c_", "consumer_id")):
        pairs = pairs.join(counts.select(F.col("node_id").alias(key), F.col("bridges").alias(end + "bridges")), key, "left")
        pairs = pairs.withColumn(end + "bridges", F.coalesce(end + "bridges", F.lit(0)))
    return pairs.withColumn("cap_reason", _cap_reason(cap))


def _cap_reason(cap: int) -> Column:
    return F.when(F.col("p_bridges") >= cap, "producer-bridge-cap").when(F.col("c_bridges") >= cap, "consumer-bridge-cap")


def gate_circular(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """``is_circular``: the reverse bridge is active."""
    reverse = active.select(F.col("consumer_id").alias("producer_id"), F.col("producer_id").alias("consumer_id"), F.lit(True).alias("is_circular")).distinct()
    return pairs.join(reverse, ["producer_id", "consumer_id"], "left").withColumn("is_circular", F.coalesce("is_circular", F.lit(False)))


def rate_ratio(p_rate: Column, c_rate: Column) -> Column:
    p = F.when(F.coalesce(p_rate, F.lit(0.0)) == 0, 1.0).otherwise(p_rate)
    c = F.when(F.coalesce(c_rate, F.lit(0.0)) == 0, p).otherwise(c_rate)
    return F.when((p > 0) & (c > 0), F.greatest(p, c) / F.greatest(F.least(p, c), F.lit(1e-6)))


# ---- the chain -----------------------------------------------------------------------

#: What the gates know of a node beside its protocol, confidence, rate and listing.
NODE_FACTS = ("trusted", "bridges", "refused", "unlisted", "zone")


def node_facts(nodes: DataFrame, active: DataFrame, rules: SecurityRules, blacklist: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Everything the gates know per node, so that candidates are joined twice instead of eight times."""
    flag = lambda ids, name: ids.select("node_id", F.lit(True).alias(name)).distinct()
    known = F.coalesce
    facts = (
        nodes.select("node_id", "endpoint", "protocol", "confidence", "rate")
        .join(shuffled(flag(blacklist, "listed")), "node_id", "left").join(shuffled(flag(whitelist, "trusted")), "node_id", "left")
        .join(shuffled(bridges_per_node(active)), "node_id", "left")
        .withColumns({"listed": known("listed", F.lit(False)), "trusted": known("trusted", F.lit(False)), "bridges": known("bridges", F.lit(0))})
    )
    return node_security(facts, rules, "node_id", "endpoint", "").drop("endpoint")


def evaluate_policy(
    candidates: DataFrame,
    nodes: DataFrame,
    active: DataFrame,
    rules: SecurityRules,
    blacklist: DataFrame,
    whitelist: DataFrame,
    cap: int = fixed.MAX_BRIDGES_PER_NODE,
    stage_risk: float = 0.7,
    blocked: DataFrame | None = None,
    attempt: str | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Verdict, reason, audit reason and risk of each candidate pair.

    ``blocked`` (producer_id, consumer_id, blocked_by) brings in the attempt limit, by the column
    ``attempt`` of both tables; without one, a pair is blocked if none of its attempts passed.
    ``facts`` are ``node_facts`` that are known already.
    """
    # written once, as both ends read it
    facts = durable(node_facts(nodes, active, rules, blacklist, whitelist)) if facts is None else facts
    known_columns = ("protocol", "confidence", "rate", "listed", *NODE_FACTS)
    end = lambda mark, key: facts.select(F.col("node_id").alias(key), *[F.col(n).alias(mark + n) for n in known_columns])
    # reverse pairs first, while the rows are narrow; nothing is shuffled after the columns of the second end
    x = gate_circular(candidates, active)
    if blocked is None:
        x = x.withColumn("blocked_by", F.lit(None).cast("string"))
    else:
        keys = [attempt] if attempt else ["producer_id", "consumer_id"]
        passed = F.bool_or(F.col("blocked_by").isNull())
        refused = blocked.groupBy(*keys).agg(F.when(~passed, F.min("blocked_by")).alias("blocked_by"))
        x = x.join(refused, keys, "left")
    x = x.join(shuffled(end("p_", "producer_id")), "producer_id", "left").join(shuffled(end("c_", "consumer_id")), "consumer_id", "left")
    return judge_pairs(x, rules, cap, stage_risk).select(*candidates.columns, "__v.*")


def judge_pairs(x: DataFrame, rules: SecurityRules, cap: int, stage_risk: float = 0.7) -> DataFrame:
    """``__v``, the verdict of each pair with the facts of both ends, ``is_circular`` and ``blocked_by``."""
    x = _pair_security(x, rules)
    x = x.withColumns({"blacklist_reason": _blacklist_reason(), "both_whitelisted": F.col("p_trusted") & F.col("c_trusted"), "cap_reason": _cap_reason(cap)})
    c = F.col
    x = x.withColumn("__ratio", rate_ratio(c("p_rate"), c("c_rate"))).withColumn(
        "__risk", quick_risk(c("p_listed"), c("c_listed"), c("p_protocol"), c("c_protocol"), c("p_confidence"), c("c_confidence")))
    two = F.call_function("format_number", c("__risk"), F.lit("0.00"))
    lit = F.lit
    made = lambda verdict, reason, audit, risk: F.struct(
        lit(verdict).alias("verdict"), reason.alias("reason"), audit.alias("audit_reason"), risk.cast("double").alias("risk"))
    cap_audit = F.concat(c("cap_reason"), lit(":"), F.when(c("cap_reason") == "producer-bridge-cap", c("p_bridges")).otherwise(c("c_bridges")).cast("string"))
    result = (
        F.when(c("p_protocol").isNull() | c("c_protocol").isNull(), made("reject", lit("node-not-found"), lit("node-not-found"), lit(0.0)))
        .when(c("security") == "hard_reject", made("reject", c("security_reason"), c("security_reason"), lit(1.0)))
        .when(c("security") == "stage", made("stage", c("security_reason"), c("security_reason"), lit(0.8)))
        .when(c("blacklist_reason").isNotNull(), made("reject", c("blacklist_reason"), c("blacklist_reason"), lit(1.0)))
        .when(c("both_whitelisted"), made("approve", lit("both-whitelisted"), lit("both-whitelisted"), lit(0.0)))
        .when(c("cap_reason").isNotNull(), made("reject", c("cap_reason"), cap_audit, lit(0.5)))
        .when(c("blocked_by").isNotNull(), made("reject", F.concat(lit("rate-limit-exceeded:"), F.substring("blocked_by", 1, 8)), F.concat(lit("rate-limit:"), "blocked_by"), lit(0.3)))
        .when(c("is_circular"), made("reject", lit("circular-dependency"), lit("circular-dependency"), lit(0.8)))
        .when(c("p_confidence") < 0.3, made("reject", lit("low-confidence-contract"), lit("low-confidence-producer-contract"), lit(0.6)))
        .when(c("__ratio") > 1000, made("stage", lit("extreme-rate-mismatch"),
              F.concat(lit("extreme-rate-mismatch:"), F.bround(c("__ratio"), 0).cast("long").cast("string"), lit("x")), lit(0.7)))
        .when(c("__risk") >= stage_risk, made("stage", F.concat(lit("risk:"), two), F.concat(lit("risk-threshold:"), two), c("__risk")))
        .otherwise(made("approve", lit("all-checks-passed"), lit("all-checks-passed"), c("__risk")))
    )
    return x.withColumn("__v", result)


# ---- approvals and audit -----------------------------------------------------------------

def resolve_approvals(staged: DataFrame, decisions: DataFrame, keys: list[str], time: str = "t", tie: str = "seq",
                      timeout: int = 60_000_000) -> DataFrame:
    """First decision on each staged pair within the timeout: approved, rejected or timed_out.

    ``decisions`` has a boolean ``approved``; both sides are read in one pass per key and time bucket.
    """
    both = staged.withColumns({"approved": F.lit(None).cast("boolean"), "is_staged": F.lit(True)}).unionByName(
        decisions.withColumn("is_staged", F.lit(False)), allowMissingColumns=True)
    found = F.when(~F.col("is_staged"), F.struct(F.col(time).alias("at"), F.col("approved").alias("approved")))
    out = next_match(both, keys, time, tie, timeout, found, "decision").filter("is_staged")
    outcome = F.when(F.col("decision").isNull(), "timed_out").when(F.col("decision.approved"), "approved").otherwise("rejected")
    return out.withColumn("outcome", outcome).withColumn("decided_at", F.col("decision.at")).drop("decision", "approved", "is_staged")


def approval_queue(staged: DataFrame, decisions: DataFrame, keys: list[str], as_of: int, time: str = "t", tie: str = "seq",
                   timeout: int = 60_000_000) -> DataFrame:
    """Staged pairs that are still waiting at ``as_of``."""
    open_rows = resolve_approvals(staged, decisions, keys, time, tie, timeout).filter("outcome = 'timed_out'")
    return open_rows.filter((F.col(time) <= as_of) & (F.col(time) + timeout > as_of)).drop("outcome", "decided_at")


def audit_rows(verdicts: DataFrame, recorded_at: Column) -> DataFrame:
    return verdicts.select(recorded_at.alias("recorded_at"), F.upper("verdict").alias("verdict"), "producer_id", "consumer_id",
                           F.col("composite").alias("score"), F.col("audit_reason").alias("reason"))


def audit_append(rows: DataFrame, path: str, batch: str) -> None:
    """Write the audit rows of one batch, a folder per batch and per day of ``recorded_at`` (epoch microseconds).

    A batch that runs again replaces its own rows and no others.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("recorded_at") / 86_400_000_000).cast("int"))
    rows.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def audit_recent(log: DataFrame, n: int = 100, order: tuple[str, ...] = ("recorded_at",)) -> DataFrame:
    """The newest ``n`` rows; rows of the same time are ordered by their other columns, so the result is always the same."""
    ties = [F.col(c) for c in log.columns if c not in order]
    return log.orderBy(*[F.desc(c) for c in order], *ties).limit(n)


# ---- decisions that depend on earlier ones of the same batch -------------------------------

def settle_batch(verdicts: DataFrame, active: DataFrame, cap: int = fixed.MAX_BRIDGES_PER_NODE, score: str = "composite",
                 limit: int | None = None, window: int = fixed.ATTEMPT_WINDOW_S * 1_000_000, as_of: int = 0,
                 recorded: DataFrame | None = None) -> DataFrame:
    """Verdicts as if the candidates were decided one after another at ``as_of``, best score first, at nine digits (ties by ids).

    A bridge counts for both ends as soon as it is approved: a later pair with a full end, or whose
    reverse was approved earlier, is rejected. Pairs on the whitelist are approved in any case and
    count as well. With ``limit``, a pair that gets past lists and cap is an attempt of both ends,
    and one too many within the window is rejected; ``recorded`` (producer_id, consumer_id, t) are
    attempts before the batch.
    """
    c, lit = F.col, F.lit
    numbered = durable(verdicts.withColumn("__a", F.monotonically_increasing_id()))
    sure = is_sure(c("verdict"), c("reason"))
    # rows that an earlier gate decided stay as they are
    reached = is_reached(c("reason"))
    kind = F.when(sure, SURE).when(c("verdict") == "approve", WANTS).otherwise(ONLY_ASKS)
    rows = numbered.filter(reached | sure).select(
        "__a", "producer_id", "consumer_id", lit(as_of).cast("long").alias("__t"), (-F.round(c(score).cast("double"), 9)).alias("__rank"),
        c("producer_id").alias("__first"), c("consumer_id").alias("__second"), kind.alias("__kind"))
    if limit is not None and recorded is not None:
        before = _within(recorded, as_of, window).select(
            (-1 - F.monotonically_increasing_id()).alias("__a"), "producer_id", "consumer_id", c("t").cast("long").alias("__t"),
            lit(float("-inf")).alias("__rank"), c("producer_id").alias("__first"), c("consumer_id").alias("__second"), lit(PAST).alias("__kind"))
        rows = rows.unionByName(before)
    found = settle(rows, ["__t", "__rank", "__first", "__second"], bridges_per_node(active), cap, limit, window)
    judged = numbered.join(found.filter(c("__a") >= 0), "__a", "left").join(
        bridges_per_node(active).select(c("node_id").alias("producer_id"), c("bridges").alias("__pb")), "producer_id", "left").join(
        bridges_per_node(active).select(c("node_id").alias("consumer_id"), c("bridges").alias("__cb")), "consumer_id", "left")
    yes = lambda name: F.coalesce(c(name) == 2, lit(False))
    why = F.when(~sure & c("p_cap").isNotNull(), _overruled(yes("p_cap"), yes("c_cap"), yes("p_limited"), yes("c_limited"), yes("back"), c("__pb"), c("__cb"), cap))
    own = F.struct("verdict", "reason", "audit_reason", c("risk").cast("double").alias("risk"))
    return judged.withColumn("__v", F.coalesce(why, own)).select(*[c("__v")[n].alias(n) if n in ("verdict", "reason", "audit_reason", "risk") else c(n) for n in verdicts.columns])


def is_sure(verdict: Column, reason: Column) -> Column:
    """Pairs on the whitelist, which are approved in any case."""
    return (verdict == "approve") & (reason == "both-whitelisted")


def is_reached(reason: Column) -> Column:
    """Whether a pair got past lists and cap, so that it is an attempt."""
    return reason.isin("all-checks-passed", "circular-dependency", "low-confidence-contract", "extreme-rate-mismatch") | reason.startswith("risk:")


def _within(recorded: DataFrame, as_of: int, window: int) -> DataFrame:
    return recorded.filter((F.col("t") <= as_of) & (as_of - F.col("t") < window))


def _overruled(p_cap: Column, c_cap: Column, p_limited: Column, c_limited: Column, back: Column, p_bridges: Column, c_bridges: Column, cap: int) -> Column:
    """What earlier answers of the batch make of an attempt: the attempt limit comes before the gates that gave its verdict, the reverse pair after; null if nothing."""
    lit = F.lit
    held = lambda n: F.greatest(F.coalesce(n, lit(0)), lit(cap)).cast("string")
    made = lambda reason, audit, risk: F.struct(lit("reject").alias("verdict"), reason.alias("reason"), audit.alias("audit_reason"), lit(risk).alias("risk"))
    limited = lambda node: made(F.concat(lit("rate-limit-exceeded:"), F.substring(node, 1, 8)), F.concat(lit("rate-limit:"), node), 0.3)
    circular = lit("circular-dependency")
    return (F.when(p_cap, made(lit("producer-bridge-cap"), F.concat(lit("producer-bridge-cap:"), held(p_bridges)), 0.5))
            .when(c_cap, made(lit("consumer-bridge-cap"), F.concat(lit("consumer-bridge-cap:"), held(c_bridges)), 0.5))
            .when(p_limited, limited("producer_id")).when(c_limited, limited("consumer_id"))
            .when(back, made(circular, circular, 0.8)))


# ---- a batch that is not listed ----------------------------------------------------------------
#
# All attempts of a batch are of one time, so a node that is full, of bridges or of attempts, stays
# full: its later pairs are rejected and count for nobody. It is enough to settle the first pairs of
# each node, as many as fill it; where each node is full then decides every other pair by itself.

#: Pairs of a producer and pairs on the whitelist of a node that are tried at first, and how many times more if they do not fill it.
FIRST_PAIRS, FIRST_SURE, MORE = 128, 32, 4


def place(rank: Column) -> Column:
    """Place of a pair in the order of the batch."""
    return F.struct(rank.alias("rank"), F.col("producer_id").alias("producer_id"), F.col("consumer_id").alias("consumer_id"))


def attempts_per_node(recorded: DataFrame, as_of: int, window: int) -> DataFrame:
    """Attempts of each node within the window."""
    ends = _within(recorded, as_of, window).select(F.explode(F.array("producer_id", "consumer_id")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("attempts"))


def full_at(settled: DataFrame, load: DataFrame, cap: int, limit: int | None) -> DataFrame:
    """``cap_at`` and ``lim_at`` of each node: the place of the settled pair that gave it its last bridge and its last attempt.

    ``load`` (node_id, bridges, attempts) is what the nodes had before.
    """
    c, lit = F.col, F.lit
    start = F.struct(lit(float("-inf")).alias("rank"), lit("").alias("producer_id"), lit("").alias("consumer_id"))
    count = lambda cond: F.when(cond, 1).otherwise(0)
    done = settled.select("producer_id", "consumer_id", place(-F.round("composite", 9)).alias("at"), count(c("verdict") == "approve").alias("bridge"),
                          count(is_reached(c("reason"))).alias("attempt")).filter("bridge + attempt > 0")
    ends = done.select(F.explode(F.array("producer_id", "consumer_id")).alias("node_id"), "at", "bridge", "attempt")
    upto = W.partitionBy("node_id").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = ends.withColumns({"bridge": F.sum("bridge").over(upto), "attempt": F.sum("attempt").over(upto)}).join(load, "node_id", "left")
    had = lambda name: F.coalesce(c(name), lit(0))
    places = lambda bridges, attempts, at: [F.when(bridges >= cap, at).alias("cap_at"), (lit(None).cast(at_type) if limit is None else F.when(attempts >= limit, at)).alias("lim_at")]
    at_type = done.schema["at"].dataType
    rows = ends.select("node_id", *places(had("bridges") + c("bridge"), had("attempts") + c("attempt"), c("at")))
    rows = rows.unionByName(load.select("node_id", *places(had("bridges"), had("attempts"), start)))
    return rows.groupBy("node_id").agg(F.min("cap_at").alias("cap_at"), F.min("lim_at").alias("lim_at")).filter("cap_at IS NOT NULL OR lim_at IS NOT NULL")


def settle_first(profiles: DataFrame, met: Callable[[DataFrame, tuple[str, ...]], DataFrame], taken: DataFrame, nodes: DataFrame, active: DataFrame, rules: SecurityRules,
                 blacklist: DataFrame, whitelist: DataFrame, facts: DataFrame, cap: int, limit: int | None, as_of: int,
                 recorded: DataFrame | None, window: int = fixed.ATTEMPT_WINDOW_S * 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The settled first pairs of the nodes, and ``full_at`` of all pairs.

    ``profiles`` are the nodes with ``NODE_FACTS``; ``met`` gives the ``class_pairs`` of classified
    nodes. The pairs of a producer are listed up to a number, those on the whitelist also those of a
    consumer. If one that has more is not full by the last one listed, its class gets more and all is
    settled again, so the answers are those of the whole batch.
    """
    c, lit = F.col, F.lit
    load = bridges_per_node(active)
    if limit is None or recorded is None:
        load = load.withColumn("attempts", lit(0).cast("long"))
    else:
        load = load.join(attempts_per_node(recorded, as_of, window), "node_id", "full")
    load = durable(load)
    known = profiles.join(shuffled(load.select("node_id", "attempts")), "node_id", "left").withColumns({
        "full": c("bridges") >= cap, "spent": F.coalesce("attempts", lit(0)) >= limit if limit is not None else lit(False), "barred": c("unlisted").isNotNull()})
    alike = ("trusted", "full", "spent", "refused", "barred", "zone")
    classed = durable(node_classes(known, alike))
    pairs = met(classed, alike).withColumns({"producer_id": lit(""), "consumer_id": lit(""), "is_circular": lit(False), "blocked_by": lit(None).cast("string")})
    for m in ("p_", "c_"):
        pairs = pairs.withColumns({m + "unlisted": F.when(c(m + "barred"), "x"), m + "bridges": F.when(c(m + "full"), cap).otherwise(0)})
    judged = judge_pairs(pairs, rules, cap).withColumns({"sure": is_sure(c("__v.verdict"), c("__v.reason")), "reached": is_reached(c("__v.reason"))})
    judged = durable(judged.filter("sure OR reached").select("p_cls", "p_n", "c_cls", "c_n", "rank", "sure", "p_full", "c_full", "p_spent", "c_spent"))
    open_ones = judged.filter("NOT sure AND NOT p_spent AND NOT c_spent")
    # what is listed: for which side, of which pairs, how many at first, and what has to be full by its end
    lists = [("p", open_ones, FIRST_PAIRS, F.least("cap_at", "lim_at")), ("p", judged.filter("sure AND NOT p_full"), FIRST_SURE, c("cap_at")),
             ("c", judged.filter("sure AND NOT c_full"), FIRST_SURE, c("cap_at"))]
    most = [durable(rows.select(c(own + "_cls").alias("cls")).distinct().withColumn("k", lit(first))) for own, rows, first, _ in lists]
    keys = ["producer_id", "consumer_id"]
    while True:
        made = [first_pairs(classed, rows, own, k) for (own, rows, _, _), k in zip(lists, most)]
        some = made[0][0].unionByName(made[1][0]).unionByName(made[2][0]).distinct()
        some = some.join(taken.select(*keys), keys, "left_anti").select(*keys, (-c("rank")).alias("composite"))
        gated = evaluate_policy(some, nodes, active, rules, blacklist, whitelist, cap, facts=facts)
        settled = durable(settle_batch(gated, active, cap, limit=limit, window=window, as_of=as_of, recorded=recorded))
        full = durable(full_at(settled, load, cap, limit))
        enough = True
        for i, ((own, _, _, filled), (_, cut)) in enumerate(zip(lists, made)):
            me, other = (keys if own == "p" else keys[::-1])
            mine = classed.filter(c("role").isin("producer" if own == "p" else "consumer", "both")).select("cls", "node_id")
            last = cut.join(mine, "cls").join(full, "node_id", "left").withColumnsRenamed({"node_id": me, "node": other})
            # a pair of a node with itself is no pair
            short = durable(last.filter(F.coalesce(filled > place(c("rank")), lit(True))).select("cls", lit(MORE).alias("more")).distinct())
            if not short.isEmpty():
                enough = False
                most[i] = durable(most[i].join(short, "cls", "left").select("cls", (c("k") * F.coalesce("more", lit(1))).alias("k")))
        if enough:
            return settled, full


def settled_pairs(pairs: DataFrame, rules: SecurityRules, cap: int) -> DataFrame:
    """Verdicts of pairs that carry ``NODE_FACTS`` and ``full_at`` of both ends, and as ``mark`` whether the
    reverse pair is active (``circular``) and the place where it was approved (``at``)."""
    c, lit = F.col, F.lit
    x = pairs.withColumns({"is_circular": F.coalesce(c("mark.circular"), lit(False)), "blocked_by": lit(None).cast("string")})
    x = judge_pairs(x, rules, cap).withColumn("__at", place(-F.round("composite", 9)))
    past = lambda at: F.coalesce(c(at) < c("__at"), lit(False))
    why = F.when(is_reached(c("__v.reason")), _overruled(past("p_cap_at"), past("c_cap_at"), past("p_lim_at"), past("c_lim_at"), past("mark.at"), c("p_bridges"), c("c_bridges"), cap))
    x = x.withColumn("__w", F.coalesce(why, c("__v")))
    return x.select("producer_id", "consumer_id", "composite", "__w.*")
