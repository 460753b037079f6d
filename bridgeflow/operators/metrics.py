"""Bridge metrics, health decisions, teardown and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from .registry import PAIR, reweight_edges


# ---- latency and errors ------------------------------------------------------------

def nth_percentiles(samples: DataFrame, key: str, latency: str) -> DataFrame:
    """p50 and p99 by position, for keys with a bounded number of samples."""
    ordered = F.sort_array(F.collect_list(latency))
    n = F.size("s")
    at = lambda i: F.get("s", F.least(F.floor(i), n - 1).cast("int"))
    return samples.groupBy(key).agg(ordered.alias("s")).select(key, at(n / 2).alias("p50"), at(n * 0.99).alias("p99"))


def latency_percentiles(messages: DataFrame, key: str, latency: str, order: list[str], samples: int = fixed.LATENCY_SAMPLES) -> DataFrame:
    """Percentiles of the newest ``samples`` latencies of each bridge."""
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = messages.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= samples)
    return nth_percentiles(last, key, latency)


def latency_percentiles_all(messages: DataFrame, key: str, latency: str) -> DataFrame:
    """Approximate percentiles over all samples, merged map-side."""
    return messages.groupBy(key).agg(F.percentile_approx(latency, [0.5, 0.99]).alias("p")).select(
        key, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p99"))


def runtime_error_rate(outcomes: DataFrame, key: str, failed: str) -> DataFrame:
    return outcomes.groupBy(key).agg(F.coalesce(F.avg(F.col(failed).cast("double")), F.lit(0.0)).alias("error_rate"))


def bridge_snapshot(outcomes: DataFrame, key: str, failed: str, latency: str, order: list[str], samples: int = fixed.LATENCY_SAMPLES) -> DataFrame:
    """Messages, errors, error rate and latency percentiles of written messages per bridge."""
    counts = outcomes.groupBy(key).agg(
        F.count_if(~F.col(failed)).alias("messages"), F.count_if(failed).alias("errors"),
        F.avg(F.col(failed).cast("double")).alias("error_rate"))
    return counts.join(latency_percentiles(outcomes, key, latency, order, samples), key, "left")


def latency_baseline(messages: DataFrame, key: str, latency: str, order: list[str], warmup: int = 100,
                     factor: float = 2.0, samples: int = fixed.LATENCY_SAMPLES) -> DataFrame:
    """Baseline p50 of the first ``warmup`` messages, current p50, and whether the bridge is degraded."""
    oldest = W.partitionBy(key).orderBy(*[F.asc(c) for c in order])
    first = messages.withColumn("__r", F.row_number().over(oldest)).filter(F.col("__r") <= warmup)
    enough = first.groupBy(key).agg(F.max("__r").alias("n"))
    base = nth_percentiles(first, key, latency).select(key, F.col("p50").alias("early"))
    now = latency_percentiles(messages, key, latency, order, samples).select(key, "p50")
    out = enough.join(base, key).join(now, key)
    baseline = F.when(F.col("n") >= warmup, F.col("early"))
    return out.select(key, baseline.alias("baseline"), "p50", F.coalesce(F.col("p50") > baseline * factor, F.lit(False)).alias("degraded"))


def throughput(messages: DataFrame, key: str, time: str, size: Column, window: int = 60_000_000) -> DataFrame:
    """Messages and bytes per second in tumbling windows; ``time`` is in microseconds."""
    start = F.floor(F.col(time) / window) * window
    seconds = window / 1_000_000
    return messages.groupBy(key, start.alias("window_start")).agg(
        (F.count(F.lit(1)) / seconds).alias("msg_s"), (F.sum(size) / seconds).alias("byte_s"))


# ---- health -------------------------------------------------------------------------

def health_decisions(bridges: DataFrame, stale: DataFrame, error_rates: DataFrame, threshold: float = 0.4, retries: int = 3) -> DataFrame:
    """Decision per bridge: teardown of dead or failing ones, retry, or keep, with the new retry count."""
    x = bridges
    for mark, k in (("__p", "producer_id"), ("__c", "consumer_id")):
        x = x.join(stale.select(F.col("node_id").alias(k), F.lit(True).alias(mark)).distinct(), k, "left")
    x = x.join(error_rates.select("bridge_id", "error_rate"), "bridge_id", "left")
    gone = F.col("__p").isNotNull() | F.col("__c").isNotNull()
    bad = F.coalesce(F.col("error_rate") > threshold, F.lit(False))
    decision = (F.when(gone, "teardown").when(bad & (F.col("retry_count") < retries), "retry").when(bad, "teardown").otherwise("keep"))
    reason = F.when(gone, "node-gone").when(bad & (F.col("retry_count") >= retries), "persistent-errors")
    count = F.when(F.col("decision") == "retry", F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    return x.withColumn("decision", decision).withColumn("reason", reason).withColumn("retry_count", count).drop("__p", "__c")


def teardown_effects(torn: DataFrame, bridges: DataFrame, edges: DataFrame, nodes: DataFrame, as_of: int) -> dict[str, DataFrame]:
    """Everything a teardown changes. ``torn`` has the pair, bridge_id and reason."""
    ids = torn.select(F.col("producer_id").alias("node_id")).distinct()
    protocol = lambda k, name: nodes.select(F.col("node_id").alias(k), F.col("protocol").alias(name))
    known = torn.join(protocol("producer_id", "producer_protocol"), "producer_id").join(protocol("consumer_id", "consumer_protocol"), "consumer_id")
    detail = F.concat(F.lit("reason="), "reason", F.lit(" bridge_id="), "bridge_id")
    return {
        "bridges": bridges.join(torn.select(*PAIR), PAIR, "left_anti"),
        "edges": reweight_edges(edges, ids, 0.0),
        "audit": torn.select(F.lit(as_of).alias("recorded_at"), F.lit("BRIDGE_TORN").alias("verdict"), *PAIR, F.lit(0.0).alias("score"), detail.alias("reason")),
        "outcomes": known.select("producer_protocol", "consumer_protocol", (F.col("reason") != "persistent-errors").alias("success")),
        "events": torn.select(F.lit("bridge_torn").alias("type"), "bridge_id", F.col("reason").alias("payload"), F.lit(as_of).alias("t")),
        "requeue": torn.filter("reason <> 'node-gone'").select(*PAIR, F.lit(0.5).alias("composite"), F.lit(as_of).alias("created")),
    }


# ---- counters and reports ---------------------------------------------------------------

def _metric(df: DataFrame, metric: str, key: str, value: Column | str) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"), value.cast("double").alias("value"))


def count_metric(df: DataFrame, metric: str, by: str | None = None) -> DataFrame:
    if by is None:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), F.col("n").cast("double").alias("value"))
    return _metric(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), metric, by, "n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def event_counters(drifts: DataFrame, breaker: DataFrame, active: DataFrame, nodes: DataFrame, held: DataFrame,
                   capacity: int = fixed.HOLD_CAPACITY) -> DataFrame:
    """Drift events per node, trips and buffer fill per bridge, active bridges and registered nodes."""
    trips = breaker.groupBy("bridge_id").agg(F.max("trips").alias("n"))
    fill = held.filter("status = 'held'").groupBy("bridge_id", "trips").agg(F.count(F.lit(1)).alias("n")).groupBy("bridge_id").agg(
        (F.max_by("n", "trips") / capacity).alias("fill"))
    return union_all([
        count_metric(drifts, "drift_events", "node_id"), _metric(trips, "circuit_trips", "bridge_id", "n"),
        count_metric(active.select(*PAIR).distinct(), "active_bridges"), count_metric(nodes, "registered_nodes"),
        _metric(fill, "buffer_fill", "bridge_id", "fill"),
    ])


def status_report(nodes: DataFrame, active: DataFrame, queue: DataFrame, staged: DataFrame, catalog_nodes: DataFrame,
                  degraded_services: DataFrame) -> DataFrame:
    """One row per figure of the status page; ``durable`` is 1 while no service is degraded.

    Details per bridge come from ``bridge_listing``.
    """
    durable = degraded_services.agg((F.count(F.lit(1)) == 0).cast("double").alias("value")).select(
        F.lit("durable").alias("metric"), F.lit("").alias("key"), "value")
    return union_all([
        count_metric(nodes, "nodes"), count_metric(active.select(*PAIR).distinct(), "active_bridges"),
        count_metric(queue.select(*PAIR).distinct(), "bridge_queue"), count_metric(staged, "staged_approvals"),
        count_metric(catalog_nodes, "catalog_nodes"), count_metric(degraded_services, "degraded_services"),
        count_metric(staged, "pending_approvals"), durable,
    ]).drop("key")


def bridge_listing(bridges: DataFrame, runtime: DataFrame) -> DataFrame:
    """Bridges with their runtime figures, null for bridges that never ran."""
    return bridges.join(runtime, "bridge_id", "left")


def node_listing(nodes: DataFrame) -> DataFrame:
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type")))
    contract = F.struct(fields.alias("fields"), "tags", "encoding", F.col("rate").alias("emission_rate"), "confidence")
    return nodes.select(F.col("node_id").alias("id"), "protocol", "role", "endpoint", F.to_json(contract, {"ignoreNullFields": "false"}).alias("contract"))


def queue_report(queue: DataFrame, waiting: DataFrame) -> DataFrame:
    return union_all([count_metric(queue.select(*PAIR).distinct(), "bridge_queue_depth"), count_metric(waiting, "pending_approvals")]).drop("key")
