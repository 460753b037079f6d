"""Node registry, contract drift and the capability graph as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import fixed
from ..scale import Fold, ordered_fold, previous_value

PAIR = ["producer_id", "consumer_id"]


# ---- drift ------------------------------------------------------------------------

DRIFT_OUT = T.StructType([T.StructField("action", T.StringType()), T.StructField("delta", T.DoubleType())])


def drift_fold(threshold: float, include_types: bool = False) -> Fold:
    """State: fields and tags of the accepted contract."""
    def fold(state: tuple | None, rows: pd.DataFrame) -> tuple[dict, tuple]:
        actions, deltas = [], []
        typed = rows["types"] if include_types else [None] * len(rows)
        for names, tags, kinds in zip(rows["names"], rows["tags"], typed):
            fields = sorted(f"{n}:{k}" for n, k in zip(names, kinds)) if include_types else sorted(names)
            contract = (fields, sorted(tags))
            if state is None:
                action, delta, state = "new", 0.0, contract
            elif state == contract:
                action, delta = "touch", 0.0
            else:
                old, new = set(state[0]), set(fields)
                delta = len(old ^ new) / max(len(old | new), 1)
                action = "drift" if delta >= threshold else "touch"
                if action == "drift":
                    state = contract
            actions.append(action)
            deltas.append(delta)
        return {"action": actions, "delta": deltas}, state

    return fold


def register_or_drift(
    samples: DataFrame,
    order: list[str],
    threshold: float = fixed.DRIFT_THRESHOLD,
    include_types: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Compare each contract sample with the last accepted contract of its node.

    Adds ``action`` (new, drift, touch) and ``delta``. A change below the threshold does not
    replace the accepted contract, so small changes add up. Samples need node_id, names, tags;
    with ``include_types`` the names are paired with a ``types`` column.
    """
    return ordered_fold(samples, F.col("node_id"), order, drift_fold(threshold, include_types), lambda: None, DRIFT_OUT, partitions)


def drift_events(registered: DataFrame) -> DataFrame:
    """Events of accepted contracts: new nodes and drifts."""
    kind = F.when(F.col("action") == "new", "new_node").when(F.col("action") == "drift", "contract_drift")
    return registered.withColumn("type", kind).filter("type IS NOT NULL")


def delta(old: Column, new: Column) -> Column:
    """Share of names that differ between two name lists."""
    union = F.size(F.array_union(old, new))
    return (union - F.size(F.array_intersect(old, new))) / F.greatest(union, F.lit(1))


def drift_delta(samples: DataFrame, order: str, bucket: Column, names: str = "names") -> DataFrame:
    """``delta`` of each sample to the sample before it, 0 for the first of a node."""
    out = previous_value(samples, ["node_id"], [order], bucket, names, "__old")
    return out.withColumn("delta", F.coalesce(delta(F.col("__old"), F.col(names)), F.lit(0.0))).drop("__old")


def last_per_node(snapshots: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` snapshots of each node; the limit applies before rows are shuffled."""
    newest = W.partitionBy("node_id").orderBy(F.desc(order))
    return snapshots.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)


def drift_history(snapshots: DataFrame, order: str, n: int = fixed.HISTORY_PER_NODE) -> DataFrame:
    return last_per_node(snapshots, order, n)


def drift_recent(snapshots: DataFrame, order: str, n: int = 100) -> DataFrame:
    return last_per_node(snapshots, order, n)


def drift_latest(snapshots: DataFrame, order: str) -> DataFrame:
    rest = [c for c in snapshots.columns if c != "node_id"]
    return snapshots.groupBy("node_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select("node_id", "s.*")


def drifted_nodes(snapshots: DataFrame, order: str, threshold: float = fixed.DRIFT_THRESHOLD) -> DataFrame:
    return drift_latest(snapshots, order).filter(F.col("delta") >= threshold).select("node_id", "delta")


def drift_retention(log: DataFrame, time: str, as_of: int, days: int = 7) -> DataFrame:
    """Log rows that are kept; a log partitioned by day loses whole folders and part of one."""
    return log.filter(F.col(time) >= as_of - days * 86_400_000_000)


def write_retained(log: DataFrame, path: str, time: str, as_of: int, days: int = 7) -> DataFrame:
    """Write the rows that are kept as the log's next version and return it; older versions may then be deleted.

    A run that is repeated writes the same version again.
    """
    version = f"{path}/as_of={as_of}"
    drift_retention(log, time, as_of, days).write.mode("overwrite").parquet(version)
    return log.sparkSession.read.schema(log.schema).parquet(version)


def purge_report(log: DataFrame, time: str, as_of: int, days: int = 7) -> DataFrame:
    """Rows kept and deleted per day."""
    old = F.col(time) < as_of - days * 86_400_000_000
    day = F.floor(F.col(time) / 86_400_000_000)
    return log.groupBy(day.alias("day")).agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted"))


# ---- registry ----------------------------------------------------------------------

def registry_upsert(nodes: DataFrame, updates: DataFrame, version: str, key: str = "node_id") -> DataFrame:
    """Newest row per node; an update replaces the node as a whole."""
    both = nodes.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("s")).select(key, "s.*")


def registry_lookup(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requested nodes with their columns, null where the node is unknown, and ``found``."""
    return requests.join(nodes.withColumn("found", F.lit(True)), "node_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def producers(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("role").isin("producer", "both"))


def consumers(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("role").isin("consumer", "both"))


def registry_touch(heartbeats: DataFrame, time: str = "t", key: str = "node_id") -> DataFrame:
    return heartbeats.groupBy(key).agg(F.max(time).alias("last_seen"))


def stale_nodes(nodes: DataFrame, last_seen: DataFrame, as_of: int, limit: int = 30_000_000) -> DataFrame:
    """Nodes never seen or last seen more than ``limit`` microseconds before ``as_of``."""
    seen = nodes.select("node_id").join(last_seen, "node_id", "left")
    return seen.filter(F.col("last_seen").isNull() | (F.lit(as_of) - F.col("last_seen") > limit))


def _without(df: DataFrame, removed: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.join(removed.select(F.col("node_id").alias(k)).distinct(), k, "left_anti")
    return df


def touching(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with an end in ``ids``: two equi joins instead of an OR condition."""
    ends = [pairs.join(ids.select(F.col("node_id").alias(k)).distinct(), k, "left_semi").select(*pairs.columns) for k in PAIR]
    return ends[0].unionByName(_without(ends[1], ids, "producer_id").select(*pairs.columns))


def deregister_cascade(removed: DataFrame, nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, bridges: DataFrame) -> dict[str, DataFrame]:
    """Tables after removing nodes, and the bridges the removal affects."""
    gone = removed.join(nodes.select("node_id"), "node_id", "left_semi").select("node_id").distinct()
    return {
        "nodes": _without(nodes, gone, "node_id"), "edges": _without(edges, gone, *PAIR),
        "snapshots": _without(snapshots, gone, "node_id"), "affected": touching(bridges.select(*PAIR), gone),
    }


# ---- graph ---------------------------------------------------------------------------

def edges_upsert(edges: DataFrame, order: list[str]) -> DataFrame:
    """Last weight of each pair."""
    return edges.groupBy(*PAIR).agg(F.max_by("weight", F.struct(*order)).alias("weight"))


def edge_weight(requests: DataFrame, edges: DataFrame) -> DataFrame:
    return requests.join(edges.select(*PAIR, "weight"), PAIR, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def reweight_edges(edges: DataFrame, touched: DataFrame, weight: float = 0.0) -> DataFrame:
    """Set the weight of every edge that has an end in ``touched``."""
    for i, k in enumerate(PAIR):
        ids = touched.select(F.col("node_id").alias(k), F.lit(True).alias(f"__{i}")).distinct()
        edges = edges.join(ids, k, "left")
    hit = F.col("__0").isNotNull() | F.col("__1").isNotNull()
    return edges.withColumn("weight", F.when(hit, weight).otherwise(F.col("weight"))).drop("__0", "__1")


def graph_remove_node(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return _without(edges, removed, *PAIR)


def graph_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(*PAIR).distinct()


def graph_neighbors(edges: DataFrame) -> DataFrame:
    """Out-neighbours, one row each."""
    return graph_pairs(edges).select(F.col("producer_id").alias("node_id"), F.col("consumer_id").alias("neighbor"))


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All node ids, isolated ones included."""
    ends = [edges.select(F.col(k).alias("node_id")) for k in PAIR]
    return nodes.select("node_id").unionByName(ends[0]).unionByName(ends[1]).distinct()
