"""Queries of deduplication, breaking, holding and limiting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resilience as rs
from . import lenses as ln
from .base import Suite

suite = Suite()
HOUR = 3_600_000_000
BREAKER = rs.BreakerOptions(window=6 * HOUR, half_open=24 * HOUR)


def _walk(key: str, start: str, step: str, inner: str) -> str:
    """A walk over the rows of each key in time order; ``step`` selects from rows n joined to the walk w."""
    return ln.with_(ln.MESSAGES, f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS rn FROM source),
walk AS ({start} FROM numbered n WHERE rn = 1 UNION ALL {step} FROM (SELECT {inner} FROM walk w JOIN numbered n ON n.{key} = w.{key} AND n.rn = w.rn + 1))""", recursive=True)


SOURCE = "source AS (SELECT * FROM messages)"


@suite.query("dedupe_ttl", _walk(
    "msg_id", "SELECT event_id, msg_id, rn, t AS first, false AS dup",
    f"SELECT event_id, msg_id, rn, CASE WHEN t - first <= {24 * HOUR} THEN first ELSE t END, t - first <= {24 * HOUR}",
    "n.event_id, n.msg_id, n.rn, n.t, w.first").replace("numbered AS", "source AS (SELECT * FROM messages WHERE event_type <> 'signup'),\nnumbered AS") + """
SELECT event_id, dup AS is_duplicate FROM walk UNION ALL SELECT event_id, false FROM messages WHERE event_type = 'signup'""")
def _(t):
    rows = ln.messages(t).select("event_id", "t", F.when(F.col("event_type") != "signup", F.col("msg_id")).alias("msg_id"))
    return rs.dedupe_ttl(rows, ttl=24 * HOUR).select("event_id", "is_duplicate")


RATED = f"""rated AS (SELECT *, count(*) OVER w AS n, sum(is_error::INT) OVER w AS bad FROM messages
  WINDOW w AS (PARTITION BY bridge_id ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW))"""


@suite.query("window_error_rate", ln.with_(ln.MESSAGES, RATED) + """
SELECT event_id, n AS events, bad::BIGINT AS failures, CASE WHEN n >= 5 THEN round(bad / n, 6) END AS error_rate FROM rated""")
def _(t):
    out = rs.window_error_rate(ln.messages(t).select("event_id", "bridge_id", "t", "is_error"), "bridge_id", "t", "is_error", 6 * HOUR)
    return out.select("event_id", "events", "failures", F.round("error_rate", 6).alias("error_rate"))


def breaker(t):
    rows = ln.messages(t).select("event_id", "bridge_id", "t", "is_error")
    return rs.circuit_breaker(rows, "bridge_id", "t", "event_id", "is_error", BREAKER)


BREAKER_WALK = _walk(
    "bridge_id",
    "SELECT event_id, bridge_id, rn, t, 'closed' AS on_arrival, 'closed' AS state, 0::BIGINT AS tripped, 0::BIGINT AS trips",
    """SELECT event_id, bridge_id, rn, t, mode, CASE WHEN opens THEN 'open' WHEN mode = 'half_open' THEN 'closed' ELSE mode END,
  CASE WHEN opens THEN t ELSE tripped END, trips + opens::INT FROM (SELECT *, (mode = 'half_open' AND is_error) OR (mode = 'closed' AND n >= 5 AND bad / n >= 0.4) AS opens""",
    f"n.*, w.tripped, w.trips, CASE WHEN w.state = 'open' AND n.t - w.tripped >= {24 * HOUR} THEN 'half_open' ELSE w.state END AS mode",
).replace("numbered AS", RATED + ",\nsource AS (SELECT * FROM rated),\nnumbered AS").replace("n.rn = w.rn + 1))", "n.rn = w.rn + 1)))")


@suite.query("circuit_breaker", BREAKER_WALK + "SELECT event_id, bridge_id, on_arrival, state, trips FROM walk")
def _(t):
    return breaker(t).select("event_id", "bridge_id", "on_arrival", "state", "trips")


@suite.query("hold_while_open", BREAKER_WALK + """
SELECT event_id, bridge_id, trips, p AS position, CASE WHEN p <= 5 THEN 'held' ELSE 'overflow' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY bridge_id, trips ORDER BY t, event_id) AS p FROM walk WHERE on_arrival = 'open')""")
def _(t):
    held = rs.hold_while_open(breaker(t), "bridge_id", "t", "event_id", capacity=5)
    return held.select("event_id", "bridge_id", "trips", "position", "status")


RATE = 2.0 / 86400


@suite.query("token_bucket", _walk(
    "user_id", "SELECT event_id, user_id, rn, t, 0.0::DOUBLE AS tokens, true AS passed",
    "SELECT event_id, user_id, rn, t, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1",
    f"n.event_id, n.user_id, n.rn, n.t, least(1.0, w.tokens + (n.t - w.t) / 1000000.0::DOUBLE * {RATE!r}::DOUBLE) AS have").replace("numbered AS", SOURCE + ",\nnumbered AS") + """
SELECT event_id, passed FROM walk""")
def _(t):
    rows = ln.messages(t).select("event_id", "user_id", "t")
    return rs.token_bucket(rows, "user_id", "t", "event_id", RATE).select("event_id", "passed")


@suite.query("sliding_rate_limit", _walk(
    "user_id", "SELECT event_id, user_id, rn, CASE WHEN cost = 2 THEN [t, t] ELSE [t] END AS hits, true AS allowed",
    "SELECT event_id, user_id, rn, CASE WHEN len(live) < 4 THEN list_concat(live, CASE WHEN cost = 2 THEN [t, t] ELSE [t] END) ELSE live END, len(live) < 4",
    f"n.event_id, n.user_id, n.rn, n.t, n.cost, list_filter(w.hits, lambda h: n.t - h < {48 * HOUR}) AS live").replace(
    "numbered AS", "source AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS cost FROM messages WHERE event_type <> 'view'),\nnumbered AS") + """
SELECT event_id, allowed FROM walk UNION ALL SELECT event_id, true FROM messages WHERE event_type = 'view'""")
def _(t):
    rows = ln.messages(t).select("event_id", "user_id", "t", "event_type", F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("cost"))
    out = rs.sliding_rate_limit(rows, "user_id", "t", "event_id", "cost", F.col("event_type") == "view", limit=4, window=48 * HOUR)
    return out.select("event_id", "allowed")


def processed(t):
    rows = ln.messages(t).select("event_id", "bridge_id", "t", "msg_id", (F.col("event_type") != "signup").alias("transform_ok"),
                                 (~F.col("is_error")).alias("write_ok"))
    options = rs.PathOptions(breaker=BREAKER, ttl=24 * HOUR, capacity=5, rate_hz=1.0 / 600)
    return rs.process_messages(rows, "bridge_id", "t", "event_id", "msg_id", "transform_ok", "write_ok", options)


# one bridge after the other, message by message: breaker, window, remembered ids and tokens as columns
PATH_WALK = ln.with_(ln.MESSAGES, f"""numbered AS (SELECT *, event_type <> 'signup' AS tok, NOT is_error AS wok,
    row_number() OVER (PARTITION BY bridge_id ORDER BY t, event_id) AS rn FROM messages),
walk AS (
  SELECT DISTINCT bridge_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, '' AS outcome, 'closed' AS mode, 0::BIGINT AS tripped, 0::BIGINT AS held, []::BIGINT[] AS win,
    []::STRUCT(id VARCHAR, t BIGINT)[] AS seen, 1.0::DOUBLE AS tokens, NULL::BIGINT AS last FROM messages
  UNION ALL
  SELECT bridge_id, rn, event_id,
    CASE WHEN shut THEN CASE WHEN held < 5 THEN 'held' ELSE 'overflow' END WHEN dup THEN 'duplicate' WHEN limited THEN 'limited'
      WHEN NOT tok THEN 'transform_error' WHEN wok THEN 'delivered' ELSE 'write_failed' END,
    CASE WHEN NOT take THEN m WHEN m = 'half_open' THEN CASE WHEN good THEN 'closed' ELSE 'open' END WHEN trips THEN 'open' ELSE m END,
    CASE WHEN take AND ((m = 'half_open' AND NOT good) OR trips) THEN t WHEN take AND m = 'half_open' THEN 0 ELSE tripped END,
    CASE WHEN shut THEN held + 1 WHEN take AND m = 'half_open' AND good THEN 0 ELSE held END,
    CASE WHEN take THEN win1 ELSE win END,
    CASE WHEN take THEN list_append(list_filter(seen, lambda s: s.id <> msg_id AND t - s.t <= {24 * HOUR}), {{'id': msg_id, 't': t}}) ELSE seen END,
    CASE WHEN take THEN have - (NOT limited)::INT ELSE tokens END, CASE WHEN take THEN t ELSE last END
  FROM (SELECT *, m = 'closed' AND len(win1) >= 5 AND len(list_filter(win1, lambda x: x % 2 = 0)) / len(win1) >= 0.4 AS trips
    FROM (SELECT *, list_append(list_filter(win, lambda x: x // 2 >= t - {6 * HOUR}), t * 2 + good::INT) AS win1
      FROM (SELECT *, take AND have < 1 AS limited, (take AND have < 1) OR (tok AND wok) AS good
        FROM (SELECT *, NOT shut AND NOT dup AS take, CASE WHEN last IS NULL THEN 1.0 ELSE least(1.0, tokens + (t - last) / 1000000.0::DOUBLE * {1.0 / 600!r}::DOUBLE) END AS have
          FROM (SELECT *, m = 'open' AS shut, m <> 'open' AND len(list_filter(seen, lambda s: s.id = msg_id AND t - s.t <= {24 * HOUR})) > 0 AS dup
            FROM (SELECT n.bridge_id, n.rn, n.event_id, n.t, n.msg_id, n.tok, n.wok, w.tripped, w.held, w.win, w.seen, w.tokens, w.last,
                CASE WHEN w.mode = 'open' AND n.t - w.tripped >= {24 * HOUR} THEN 'half_open' ELSE w.mode END AS m
              FROM walk w JOIN numbered n ON n.bridge_id = w.bridge_id AND n.rn = w.rn + 1))))))
)""", recursive=True)


@suite.query("process_messages", PATH_WALK + "SELECT event_id, bridge_id, outcome FROM walk WHERE rn > 0")
def _(t):
    return processed(t).select("event_id", "bridge_id", "outcome")


@suite.query("runner_counts", PATH_WALK + """
SELECT bridge_id, count(*) FILTER (outcome = 'delivered') AS messages, count(*) FILTER (outcome <> 'delivered') AS errors FROM walk WHERE rn > 0 GROUP BY bridge_id""")
def _(t):
    return rs.runner_counts(processed(t), "bridge_id")
