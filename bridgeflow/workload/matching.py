"""Queries of embeddings, similarity, scoring and the candidate queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import name_similarity
from ..operators import contracts as ct
from ..operators import mapping as mp
from ..operators import matching as mt
from ..session import counted
from . import lenses as ln
from .base import Suite
from .mapping import ALIGN, MAPPING_TEXT, TYPE_ROWS, mapping_text, sql_grams

suite = Suite()
AS_OF = 996710400000000  # 2001-08-02, the day after the last order
MONTH = 30 * 86400 * 1000000
TEXT = "'encoding:json fields:' || array_to_string(names, ' ') || ' tags:' || array_to_string(tags, ' ')"


def names(c):
    return F.transform(c, lambda f: f["name"])


def node_text():
    return mt.contract_text(F.col("encoding"), names("fields"), F.col("tags"))


@suite.query("contract_text", ln.with_(ln.NODES) + f"SELECT node_id, {TEXT} AS text FROM nodes")
def _(t):
    return ln.nodes(t).select("node_id", node_text().alias("text"))


def sql_embedding(source: str, key: str, text: str) -> str:
    """CTEs ending in ``emb(key, dim, weight)``."""
    return f"""words AS (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '[\\s\\x{{85}}\\x{{a0}}]+')) AS w FROM {source}),
wordn AS (SELECT id, w, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL),
grams AS (SELECT id, substring(w, i, k) AS g, n FROM wordn, unnest([1, 2, 3]) AS kk(k), unnest(range(1, length(w) - k + 2)) AS ii(i) WHERE length(w) >= k),
buckets AS (SELECT id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 4096 AS b, sum(n)::BIGINT AS n FROM grams GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM buckets GROUP BY id),
emb AS (SELECT id, b // 10 AS dim, sum(n) / max(norm) / 10 AS weight FROM buckets JOIN norms USING (id) WHERE b < 3840 GROUP BY id, b // 10)"""


@suite.query("ngram_embedding", "WITH " + sql_embedding("documents", "doc_id", "text") + """
SELECT id AS doc_id, dim, round(weight, 6) AS weight FROM emb""")
def _(t):
    return mt.ngram_embedding(t.documents, "doc_id", "text").withColumn("weight", F.round("weight", 6))


@suite.query("cosine_similarity", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
  round(list_inner_product((a.embedding[1:10])::DOUBLE[], (b.embedding[1:10])::DOUBLE[])
    / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product((b.embedding[1:10])::DOUBLE[], (b.embedding[1:10])::DOUBLE[])), 6) AS truncated, 0.0::DOUBLE AS zero
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    zero = F.array_repeat(F.lit(0.0), 4)
    return t.embeddings.join(other, "vec_id").select(
        "vec_id", F.round(mt.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("cosine"),
        F.round(mt.cosine_similarity(F.col("embedding"), F.slice("other", 1, 10)), 6).alias("truncated"),
        mt.cosine_similarity(F.col("embedding"), zero).alias("zero"))


@suite.query("embed_by_fingerprint", ln.with_(ln.NODES, f"texts AS (SELECT DISTINCT {TEXT} AS text FROM nodes)", sql_embedding("texts", "text", "text")) + f"""
SELECT node_id, count(*) AS dims, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM (SELECT node_id, {TEXT} AS text FROM nodes) n JOIN emb ON emb.id = n.text GROUP BY node_id""")
def _(t):
    n = ln.nodes(t).select("node_id", node_text().alias("text"),
                           ct.contract_fingerprint(names("fields"), F.col("tags"), F.col("encoding")).alias("fingerprint"))
    summary = mt.embed_by_fingerprint(n, "fingerprint", "text").groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("dims"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))
    return n.select("node_id", "fingerprint").join(summary, "fingerprint").drop("fingerprint")


def sql_similarity(a: str, b: str) -> str:
    ga, gb = sql_grams(a), sql_grams(b)
    return f"len(list_intersect({ga}, {gb}))::DOUBLE / (len({ga}) + len({gb}) - len(list_intersect({ga}, {gb})))"


@suite.query("name_similarity", f"""
SELECT p_partkey, round({sql_similarity('p_name', 'p_type')}, 6) AS by_type, round({sql_similarity('p_name', "'small ' || p_name")}, 6) AS longer FROM part""")
def _(t):
    return t.part.select("p_partkey", F.round(name_similarity(F.col("p_name"), F.col("p_type")), 6).alias("by_type"),
                         F.round(name_similarity(F.col("p_name"), F.concat(F.lit("small "), "p_name")), 6).alias("longer"))


ENDS = "links JOIN nodes p ON p.node_id = producer_id JOIN nodes c ON c.node_id = consumer_id"
COMPAT_ROWS = ", ".join(f"('{a}', '{b}', {s}::DOUBLE)" for a, row in fixed.PROTOCOL_COMPAT.items() for b, s in zip(fixed.PROTOCOLS, row))
COMPAT = f"proto_compat(pp, cp, compat) AS (VALUES {COMPAT_ROWS})"


def ends(t, columns):
    return mp._two_ends(ln.links(t), ln.nodes(t), columns)


@suite.query("type_similarity", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, f"type_compat(src, dst, s) AS (VALUES {TYPE_ROWS})") + f"""
SELECT producer_id, consumer_id, s AS score, 0.2::DOUBLE AS other FROM {ENDS} JOIN type_compat ON src = p.types[1] AND dst = c.types[1]""")
def _(t):
    return ends(t, ["fields"]).select("producer_id", "consumer_id", mt.type_similarity(F.col("p_fields")[0]["type"], F.col("c_fields")[0]["type"]).alias("score"),
                                      mt.type_similarity(F.lit("integer"), F.col("c_fields")[0]["type"]).alias("other"))


@suite.query("align_fields", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, ALIGN, recursive=True) + f"""
SELECT producer_id, consumer_id, {MAPPING_TEXT} AS mappings FROM ends JOIN aligned USING (sn, st, dn, dt)""")
def _(t):
    n = ln.nodes(t).withColumn("ck", mp.contract_key(F.col("fields")))
    pairs = mp._two_ends(ln.links(t), n, ["ck"])
    aligned = mt.align_contracts(pairs.select("p_ck", "c_ck"), n.select("ck", "fields").dropDuplicates(["ck"]))
    # texts are made once a contract pair
    texts = counted(aligned.select("p_ck", "c_ck", mapping_text(F.col("mappings")).alias("mappings")))
    return pairs.join(texts, ["p_ck", "c_ck"]).select("producer_id", "consumer_id", "mappings")


RISK = """least(1.0, CASE WHEN p.node_id IN ('p1', 'c1') OR c.node_id IN ('p1', 'c1') THEN 1.0 ELSE 0.0 END
  + CASE WHEN p.protocol = 'unknown' OR c.protocol = 'unknown' THEN 0.4 ELSE 0.0 END
  + CASE WHEN p.confidence < 0.4 OR c.confidence < 0.4 THEN 0.3 ELSE 0.0 END)::DOUBLE"""
PR, CR = "coalesce(p.rate, 1.0)", "coalesce(c.rate, p.rate, 1.0)"
LATENCY = f"greatest(0.0, least(1.0, 0.5 + 0.5 * log10(greatest(least({PR}, {CR}) / greatest({PR}, {CR}), 1e-4) * 10000) / 4))"


@suite.query("latency_score", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS) + f"""
SELECT producer_id, consumer_id, round({LATENCY}, 6)::DOUBLE AS latency FROM {ENDS}""")
def _(t):
    return ends(t, ["rate"]).select("producer_id", "consumer_id", F.round(mt.latency_score(F.col("p_rate"), F.col("c_rate")), 6).alias("latency"))


@suite.query("quick_risk", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS) + f"SELECT producer_id, consumer_id, round({RISK}, 6) AS risk FROM {ENDS}")
def _(t):
    listed = lambda key: F.col(key).isin("p1", "c1")
    risk = mt.quick_risk(listed("producer_id"), listed("consumer_id"), F.col("p_protocol"), F.col("c_protocol"), F.col("p_confidence"), F.col("c_confidence"))
    return ends(t, ["protocol", "confidence"]).select("producer_id", "consumer_id", F.round(risk, 6).alias("risk"))


HISTORY = "history AS (SELECT producer_protocol AS hp, consumer_protocol AS hc, avg(success::INT) AS h, count(*) AS n FROM outcomes GROUP BY ALL)"


@suite.query("bridge_history", ln.with_(ln.OUTCOMES, HISTORY, ln.NODES, ln.PAIRS, ln.LINKS) + f"""
SELECT producer_id, consumer_id, round(coalesce(h, 0.5), 6) AS history FROM {ENDS} LEFT JOIN history ON hp = p.protocol AND hc = c.protocol""")
def _(t):
    pairs = mt.with_history(ends(t, ["protocol"]), mt.bridge_history(ln.outcomes(t)), "p_protocol", "c_protocol")
    return pairs.select("producer_id", "consumer_id", F.round("history", 6).alias("history"))


@suite.query("protocol_compat", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, COMPAT) + f"""
SELECT producer_id, consumer_id, compat, 0.2::DOUBLE AS other FROM {ENDS} JOIN proto_compat ON pp = p.protocol AND cp = c.protocol""")
def _(t):
    return ends(t, ["protocol"]).select("producer_id", "consumer_id", mt.protocol_compat(F.col("p_protocol"), F.col("c_protocol")).alias("compat"),
                                        mt.protocol_compat(F.lit("coap"), F.col("c_protocol")).alias("other"))


BROAD = ln.sql_list(fixed.BROAD_TAGS)
W = fixed.SCORE_WEIGHTS
# the naive form: every producer with every consumer
ALL_PAIRS = f"""all_pairs AS (
  SELECT p.node_id AS producer_id, c.node_id AS consumer_id, p.protocol AS pp, c.protocol AS cp, p.confidence AS pc, c.confidence AS cc,
    list_has_any(p.tags, c.tags) OR list_has_any(p.tags, {BROAD}) OR list_has_any(c.tags, {BROAD}) AS tagged,
    array_to_string(p.tags, ',') AS p_tags, array_to_string(c.tags, ',') AS c_tags, p.rate AS p_rate, c.rate AS c_rate,
    'encoding:json fields:' || array_to_string(p.names, ' ') || ' tags:' || array_to_string(p.tags, ' ') AS pt,
    'encoding:json fields:' || array_to_string(c.names, ' ') || ' tags:' || array_to_string(c.tags, ' ') AS ct,
    {LATENCY} AS latency, 1.0 - {RISK} AS risk
  FROM nodes p, nodes c WHERE p.role = 'producer' AND c.role = 'consumer'
    AND NOT EXISTS (SELECT 1 FROM active a WHERE a.producer_id = p.node_id AND a.consumer_id = c.node_id)),
parts AS (
  SELECT a.*, compat, coalesce(h, 0.5) AS history, least(pc, cc) AS conf,
    {W['protocol']} * compat + {W['latency']} * latency + {W['risk']} * risk + {W['history']} * coalesce(h, 0.5) AS rest
  FROM all_pairs a JOIN proto_compat x ON x.pp = a.pp AND x.cp = a.cp LEFT JOIN history ON hp = a.pp AND hc = a.cp
  WHERE tagged AND pc >= 0.2 AND cc >= 0.2)"""
PAIR_PARTS = (ln.NODES, ln.PAIRS, ln.ACTIVE, ln.OUTCOMES, HISTORY, COMPAT, ALL_PAIRS)
LISTED = ["p1", "c1"]


@suite.query("candidate_pairs", ln.with_(*PAIR_PARTS) + f"""
SELECT pp AS producer_protocol, cp AS consumer_protocol, p_tags, c_tags, p_rate, c_rate, pc AS p_confidence, cc AS c_confidence, round(conf * (0.4 + rest), 6) AS bound, count(*) AS n_pairs
FROM parts WHERE round(conf * (0.4 + rest), 9) >= 0.72 GROUP BY ALL""")
def _(t):
    made = mt.candidate_pairs(mt.node_profiles(ln.nodes(t), LISTED), ln.active(t), mt.bridge_history(ln.outcomes(t))).filter("n_pairs > 0")
    return made.select(F.col("p_protocol").alias("producer_protocol"), F.col("c_protocol").alias("consumer_protocol"),
                       F.array_join("p_tags", ",").alias("p_tags"), F.array_join("c_tags", ",").alias("c_tags"),
                       F.col("p_high").alias("p_rate"), F.col("c_high").alias("c_rate"), "p_confidence", "c_confidence", F.round("bound", 6).alias("bound"), "n_pairs")


@suite.query("pair_prefilter", ln.with_(*PAIR_PARTS) + """
SELECT pp AS producer_protocol, cp AS consumer_protocol, count(*) AS open, count(*) FILTER (tagged AND pc >= 0.2 AND cc >= 0.2) AS scored,
  count(*) FILTER (NOT (tagged AND pc >= 0.2 AND cc >= 0.2)) AS skipped FROM all_pairs GROUP BY ALL""")
def _(t):
    return mt.pair_prefilter(mt.node_profiles(ln.nodes(t), LISTED), ln.active(t)).filter("open > 0")


SCORED = """texts AS (SELECT DISTINCT pt AS text FROM parts UNION SELECT DISTINCT ct FROM parts),
""" + sql_embedding("texts", "text", "text") + """,
lens AS (SELECT id, sqrt(sum(weight * weight)) AS len FROM emb GROUP BY id),
cos AS (SELECT a.id AS pt, b.id AS ct, sum(a.weight * b.weight) / max(la.len) / max(lb.len) AS semantic
  FROM emb a JOIN emb b ON a.dim = b.dim JOIN lens la ON la.id = a.id JOIN lens lb ON lb.id = b.id GROUP BY a.id, b.id),
scored AS (SELECT *, conf * (0.4 * semantic + rest) AS composite FROM parts JOIN cos USING (pt, ct))"""


@suite.query("score_pairs", ln.with_(*PAIR_PARTS, SCORED) + """
SELECT producer_id, consumer_id, round(semantic, 6) AS semantic, compat, round(latency, 6)::DOUBLE AS latency, round(risk, 6) AS risk, round(history, 6) AS history,
  round(composite, 6) AS composite FROM scored WHERE round(composite, 9) >= 0.72""")
def _(t):
    return mt.score_pairs(ln.nodes(t), ln.active(t), mt.bridge_history(ln.outcomes(t)), blacklist=LISTED, digits=6)


QUEUE = """queue AS (SELECT producer_id, consumer_id, least(1.0, score * 2)::DOUBLE AS composite, created, seq FROM pairs)"""


def queue(t):
    return ln.pairs(t).select("producer_id", "consumer_id", F.least(F.lit(1.0), F.col("score") * 2).alias("composite"), "created", "seq")


@suite.query("queue_dedupe", ln.with_(ln.PAIRS, QUEUE) + """
SELECT producer_id, consumer_id, arg_min(composite, seq) AS composite, arg_min(created, seq) AS created, min(seq) AS seq FROM queue GROUP BY ALL""")
def _(t):
    return mt.queue_dedupe(queue(t))


DECAYED = f"decayed AS (SELECT *, pow(0.95::DOUBLE, ({AS_OF} - created) / {MONTH}.0::DOUBLE) AS factor FROM queue)"


@suite.query("queue_decay", ln.with_(ln.PAIRS, QUEUE, DECAYED) + """
SELECT producer_id, consumer_id, seq, created, composite AS original, round(composite * factor, 6) AS decayed,
  round(CASE WHEN factor < 0.999 THEN composite * factor ELSE composite END, 6) AS composite FROM decayed WHERE composite * factor >= 0.4""")
def _(t):
    made = mt.queue_decay(queue(t), AS_OF, minute=MONTH)
    return made.withColumn("decayed", F.round("decayed", 6)).withColumn("composite", F.round("composite", 6))


@suite.query("queue_decay_topk", ln.with_(ln.PAIRS, QUEUE, DECAYED) + """
SELECT producer_id, consumer_id, seq, composite AS original, round(composite * factor, 6) AS decayed FROM decayed WHERE composite * factor >= 0.4
ORDER BY composite DESC, seq LIMIT 200""")
def _(t):
    return mt.queue_pop(queue(t), AS_OF, 200, minute=MONTH).select("producer_id", "consumer_id", "seq", "original", F.round("decayed", 6).alias("decayed"))


TORN = """torn AS (SELECT producer_id, consumer_id, max(CASE WHEN price > 50000 THEN 'persistent-errors' ELSE 'node-gone' END) AS reason
  FROM pairs WHERE status = 'F' GROUP BY ALL)"""


def torn(t):
    """Torn-down bridges: active pairs, by whether any of their lines is expensive."""
    return ln.pairs(t).filter("status = 'F'").groupBy("producer_id", "consumer_id").agg(
        F.max(F.when(F.col("price") > 50000, "persistent-errors").otherwise("node-gone")).alias("reason"))


@suite.query("queue_repush", ln.with_(ln.PAIRS, QUEUE, TORN) + f"""
, again AS (SELECT producer_id, consumer_id FROM torn WHERE reason <> 'node-gone'),
q AS (SELECT producer_id, consumer_id, arg_min(composite, seq) AS composite, arg_min(created, seq) AS created FROM queue GROUP BY ALL)
SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM again a WHERE a.producer_id = q.producer_id AND a.consumer_id = q.consumer_id)
UNION ALL SELECT producer_id, consumer_id, 0.5, {AS_OF} FROM again""")
def _(t):
    return mt.queue_repush(mt.queue_dedupe(queue(t)), torn(t), AS_OF)


@suite.query("fanout_opportunities", ln.with_(ln.PAIRS, ln.LINKS) + """
SELECT producer_id, count(*) AS consumers FROM links GROUP BY producer_id HAVING count(*) >= 2""")
def _(t):
    return mt.fanout_opportunities(ln.pairs(t))


@suite.query("manual_candidates", ln.with_(ln.NODES, ln.PAIRS, ln.LINKS, ln.ACTIVE) + """
, requests AS (SELECT producer_id, consumer_id FROM links UNION ALL SELECT 'x' || producer_id, consumer_id FROM links UNION ALL SELECT producer_id, 'x' || consumer_id FROM links),
marked AS (SELECT r.*, CASE WHEN producer_id LIKE 'x%' THEN 'producer not found' WHEN consumer_id LIKE 'x%' THEN 'consumer not found'
  WHEN EXISTS (SELECT 1 FROM active a WHERE a.producer_id = r.producer_id AND a.consumer_id = r.consumer_id) THEN 'bridge already active' END AS error FROM requests r)
SELECT producer_id, consumer_id, error, CASE WHEN error IS NULL THEN 1.0 END::DOUBLE AS composite FROM marked""")
def _(t):
    links = ln.links(t)
    x = lambda c: F.concat(F.lit("x"), F.col(c)).alias(c)
    requests = links.unionByName(links.select(x("producer_id"), "consumer_id")).unionByName(links.select("producer_id", x("consumer_id")))
    return mt.manual_candidates(requests, ln.nodes(t), ln.active(t))
