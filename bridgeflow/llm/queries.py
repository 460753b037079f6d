"""The corpus queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import durable
from . import byte_bpe, conversations, decontaminate, fill_middle, html_text, jaccard, language, licenses, perplexity, personal, pitman_yor, quality, secrets
from .common import crc_mod, digest, joined_spans, table

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", F.transform("licenses", text)).alias("licenses"),
                        F.array_max(F.transform("licenses", lambda x: x["coverage"])).alias("coverage"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    return secrets.find_secrets(docs).select(
        "doc_id", *[_count(spans, k).alias(f"n_{k}") for k in secrets.KINDS],
        digest(joined_spans(_of_kinds(spans, secrets.KINDS))).alias("base_sha256"), joined_spans(spans).alias("spans"),
        _count(spans, secrets.GUESSED).alias("n_guessed"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on a bounded sample of the labelled rows whose key's CRC-32 is no multiple of five."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    # at most SAMPLE_ROWS rows
    keys = F.broadcast(quality.sampled_keys(labels, "quality", "doc_id"))
    return quality.fit(docs.select("doc_id", "text").join(keys, "doc_id"), label="quality")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.filter(~held))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "shares")


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = decontaminate.n_hit(F.col("spans"))
    return decontaminate.contamination(docs, items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest(F.concat_ws(",", names)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLES["op6_benchmark_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
q AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p),
h AS (SELECT DISTINCT r, q.n, i, item_id FROM q JOIN g ON q.gram = g.gram AND q.n = g.n),
k AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT r, n, i FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""


def _ranks(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def encoded(docs: DataFrame) -> DataFrame:
    """Keys, ids and digests under the multilingual byte-level vocabulary."""
    import public_tokenizers

    done = byte_bpe.encode_decode(docs.select("doc_id", "text"), _ranks("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # written once: the bands and the verdicts both read the measures
    measured = durable(perplexity.measure(docs, perplexity.fit(docs), keep=["doc_id", "lang"]))
    judged = perplexity.judge(measured, perplexity.bands(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    return personal.find_personal(docs).select(
        "doc_id", *[_count(spans, k).alias(f"n_{k}") for k in personal.KINDS],
        digest(joined_spans(_of_kinds(spans, personal.KINDS))).alias("base_sha256"), joined_spans(spans).alias("spans"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restored(fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(F.col("text")).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, x, len(w) AS n, w, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM p
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))
    return done.withColumnRenamed("conv", "conv_id")


# one conversation after the other from its last row; v holds cost, audit and repaired rows from there for nothing, s, u and a before
ORACLES["op12_conversation_repair"] = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS s FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(s, lambda x: CAST(ord(x) AS BIGINT)), lambda a, x: list_reduce(range(8), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(a, x)), 4294967295), 4294967295) % 20 AS harm FROM k),
m AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE harm WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE harm <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS rn FROM m),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM o),
t AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(rn) AS n FROM f GROUP BY conv_id),
w AS (
  SELECT c.conv_id, coalesce(n, 0) AS todo, [{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}, {'c': 6::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']},
    {'c': 3::BIGINT, 'a': 'I', 'r': ['assistant:']}, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}] AS v
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
  UNION ALL
  SELECT conv_id, todo - 1, [list_min([x[1], {'c': u.c + 3, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}]), list_min([x[2], {'c': u.c + 3, 'a': 'I' || u.a, 'r': list_prepend('user:', u.r)}]), u,
    list_min([x[4], {'c': x[3].c + 3, 'a': 'I' || x[3].a, 'r': list_prepend('user:', x[3].r)}])]
  FROM (SELECT *, list_min([x[3], {'c': x[4].c + 3, 'a': 'I' || x[4].a, 'r': list_prepend('assistant:', x[4].r)}]) AS u
    FROM (SELECT w.conv_id, w.todo, list_transform([1, 2, 3, 4], lambda q: list_min(list_filter([
        {'c': v[q].c + 4, 'a': 'D' || v[q].a, 'r': v[q].r},
        CASE WHEN fault IN (0, 3) AND (q = 1 AND i = 's' OR q <> 3 AND i = 'u' OR q = 3 AND i = 'a')
          THEN {'c': v[CASE i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + fault, 'a': 'K' || v[CASE i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
                'r': list_prepend(role || ':' || text, v[CASE i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].r)} END,
        CASE WHEN fault IN (0, 3) THEN {'c': v[CASE q WHEN 3 THEN 4 ELSE 3 END].c + 3 + fault, 'a': 'R' || v[CASE q WHEN 3 THEN 4 ELSE 3 END].a,
                'r': list_prepend(CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END || text, v[CASE q WHEN 3 THEN 4 ELSE 3 END].r)} END], lambda y: y IS NOT NULL))) AS x
      FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.rn = w.todo)))
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  v[1].c AS cost, v[1].a AS audit, sha256(array_to_string(v[1].r, chr(10))) AS repaired_sha256
FROM w LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id WHERE todo = 0
"""


@query
def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    model = pitman_yor.fit(docs.filter(~held))
    scored = pitman_yor.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
