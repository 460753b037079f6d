"""Field mappings, protocol envelopes, adapter plans and signed provenance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed
from ..functions.text import hmac_sha256, last_wins, strip
from ..session import counted, durable, shuffled
from .transform import RecordConverter, col


@dataclass(frozen=True)
class FieldMapping:
    src_field: str
    dst_field: str
    transform: str = "direct"
    confidence: float = 1.0


# ---- value transforms ---------------------------------------------------------

def cast_value(c: Column, kind: T.DataType, target: str) -> Column:
    """Python coercion with a typed zero where the value does not convert."""
    text = isinstance(kind, T.StringType)
    number = isinstance(kind, T.NumericType)
    if target == "int":
        if text:
            digits = F.replace(strip(c), F.lit("_"))
            whole = strip(c).rlike(r"^[+-]?\d+(_\d+)*$")
            return F.when(c.isNotNull(), F.coalesce(F.when(whole, digits.try_cast("long")), F.lit(0).cast("long")))
        if number or isinstance(kind, T.BooleanType):
            return F.when(c.isNotNull(), F.coalesce(c.try_cast("long"), F.lit(0).cast("long")))
        return F.when(c.isNotNull(), F.lit(0).cast("long"))
    if target == "float":
        if text or number or isinstance(kind, T.BooleanType):
            plain = strip(c) if text else c
            return F.when(c.isNotNull(), F.coalesce(plain.try_cast("double"), F.lit(0.0)))
        return F.when(c.isNotNull(), F.lit(0.0))
    if target == "bool":
        if text:
            return F.length(c) > 0
        if number:
            return c != 0
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.size(c) > 0
        return c if isinstance(kind, T.BooleanType) else F.when(c.isNotNull(), F.lit(True))
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    return F.to_json(c) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else c.cast("string")


def extract_value(c: Column, kind: T.DataType, path: str) -> Column:
    """Walk a dotted path; a missing part gives null."""
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(c, "$." + path, "variant")
    for part in path.split("."):
        if isinstance(kind, T.StructType) and part in kind.names:
            c, kind = c.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(part)), kind.valueType
        else:
            return F.lit(None).cast("string")
    return c


def _mapped(m: FieldMapping, kind: T.DataType) -> list[tuple[str, Column]]:
    c, how = col(m.src_field), m.transform
    if how.startswith("cast:"):
        return [(m.dst_field, cast_value(c, kind, how[5:]))]
    if how.startswith("extract:"):
        return [(m.dst_field, extract_value(c, kind, how[8:]))]
    if how == "flatten" and isinstance(kind, T.StructType):
        return [(f"{m.dst_field}_{f.name}", c.getField(f.name)) for f in kind.fields]
    if how.startswith("enrich:"):
        return [(m.dst_field, F.when(c.isNotNull(), F.lit(how[7:])))]
    return [(m.dst_field, c)]


def apply_mapping(
    df: DataFrame,
    mappings: list[FieldMapping],
    pre: RecordConverter | None = None,
    post: RecordConverter | None = None,
    aliased_sources: bool = True,
) -> DataFrame:
    """One projection: mapped fields in order, then unmapped fields, which replace equal names.

    A null source leaves the destination null. When ``pre`` renames fields, ``aliased_sources``
    renames the mapping sources with them; without it a renamed source is passed through.
    """
    if pre is not None:
        renames = any(name == "normalize_fields" for name, _, _ in pre.steps)
        df = pre.apply(df)
        if renames and aliased_sources:
            mappings = [FieldMapping(fixed.FIELD_ALIASES.get(m.src_field.lower(), m.src_field)
                                     if m.src_field not in df.columns else m.src_field,
                                     m.dst_field, m.transform, m.confidence) for m in mappings]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for m in mappings:
        if m.src_field in kinds:
            out.update(_mapped(m, kinds[m.src_field]))
    mapped = {m.src_field for m in mappings}
    out.update({n: col(n) for n in df.columns if n not in mapped})
    df = df.select(*[c.alias(n) for n, c in out.items()])
    return post.apply(df) if post is not None else df


# ---- envelopes ------------------------------------------------------------------

Envelope = Callable[[DataFrame], DataFrame]


def _json_bytes(names: list[str]) -> Column:
    return F.encode(F.to_json(F.struct(*[col(n) for n in names])), "UTF-8")


def _headers(source: str) -> Column:
    return F.create_map(F.lit("source"), F.lit(source))


def mqtt_to_kafka(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    names = fields or df.columns
    key = F.coalesce(col("topic"), F.lit("unknown")) if "topic" in df.columns else F.lit("unknown")
    rest = [col(n) for n in df.columns if n not in names]
    return df.select(*rest, key.alias("key"), _json_bytes(names).alias("value"), _headers("mqtt").alias("headers"))


def kafka_to_rest(df: DataFrame) -> DataFrame:
    """Replace ``value`` by the variant ``payload`` it holds; text that is no JSON is wrapped."""
    if "value" not in df.columns:
        return df
    text = F.make_valid_utf8(col("value").cast("string"))
    wrapped = F.to_variant_object(F.struct(text.alias("data")))
    return df.withColumn("payload", F.coalesce(F.try_parse_json(text), wrapped)).drop("value")


def mavlink_to_grpc(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    named = {"sys_id": "sys_id", "comp_id": "comp_id", "msg_id": "msg_id", "timestamp": "time_usec"}
    value = lambda n: F.coalesce(col(n), F.lit(0)) if n in df.columns else F.lit(0)
    rest = [n for n in df.columns if n not in named.values() and n not in (keep or [])]
    return df.select(*[col(n) for n in keep or []], *[value(src).alias(dst) for dst, src in named.items()],
                     F.struct(*[col(n) for n in rest]).alias("fields"))


def rest_to_bytes(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return df.select(*[col(n) for n in keep or []], _json_bytes([n for n in df.columns if n not in (keep or [])]).alias("body"))


def file_to_kafka(df: DataFrame, text: str = "line") -> DataFrame:
    return df.withColumn("value", F.encode(col(text).cast("string"), "UTF-8")).withColumn("headers", _headers("file")).drop(text)


def _same(df: DataFrame) -> DataFrame:
    return df


ENVELOPES: dict[tuple[str, str], tuple[str, Envelope]] = {
    ("mqtt", "kafka"): ("mqtt_to_kafka", mqtt_to_kafka),
    ("kafka", "rest"): ("kafka_to_rest", kafka_to_rest),
    ("mavlink", "grpc"): ("mavlink_to_grpc", mavlink_to_grpc),
    ("rest", "zeromq"): ("rest_to_bytes", rest_to_bytes),
    ("file", "kafka"): ("file_to_kafka", file_to_kafka),
    ("rest", "rest"): ("same", _same),
    ("kafka", "kafka"): ("same", _same),
    ("websocket", "websocket"): ("same", _same),
}


def register_envelope(src: str, dst: str, name: str, fn: Envelope) -> None:
    ENVELOPES[(src, dst)] = (name, fn)


def envelope_for(src: str, dst: str) -> Envelope | None:
    return ENVELOPES.get((src, dst), (None, None))[1]


def envelope_name(src: Column, dst: Column) -> Column:
    """Envelope of a protocol crossing, null when there is none."""
    pairs = F.create_map(*[F.lit(x) for (a, b), (name, _) in ENVELOPES.items() for x in (f"{a}>{b}", name)])
    return F.try_element_at(pairs, F.concat_ws(">", src, dst))


# ---- plans -------------------------------------------------------------------------

def limiter_needed(producer_rate: Column, consumer_rate: Column) -> Column:
    """A rate limiter is needed when the producer is more than half again as fast."""
    return F.coalesce((consumer_rate > 0) & (producer_rate > consumer_rate * 1.5), F.lit(False))


def select_backpressure(plans: DataFrame, producer_rate: str = "producer_rate", consumer_rate: str = "consumer_rate") -> DataFrame:
    p = F.coalesce(F.col(producer_rate), F.lit(0.0))
    c = F.coalesce(F.col(consumer_rate), p)
    c = F.when(c == 0.0, p).otherwise(c)
    limited = limiter_needed(p, c)
    return plans.withColumn("limited", limited).withColumn("limit_hz", F.when(limited, c))


def contract_key(fields: Column) -> Column:
    """Identity of a field list, names and types in order: 16 bytes of a hash, as it travels with every pair."""
    return F.substring(F.unhex(F.sha2(F.to_json(fields), 256)), 1, 16)


def _two_ends(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Join the node columns of both ends, prefixed ``p_`` and ``c_``."""
    end = lambda x, key: nodes.select(F.col("node_id").alias(key), *[F.col(n).alias(x + n) for n in columns])
    return pairs.join(shuffled(end("p_", "producer_id")), "producer_id").join(shuffled(end("c_", "consumer_id")), "consumer_id")


def plan_adapters(pairs: DataFrame, nodes: DataFrame, version: str = fixed.ADAPTER_VERSION,
                  apart: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """One adapter plan per pair. Field lists are aligned once per distinct pair of contracts.

    With ``apart`` the wide columns, ``mappings`` and ``producer_fields``, come as a table of their
    own, a row per pair of contracts ``(p_ck, c_ck)``, so that plans can be written without them.
    """
    from .matching import align_contracts

    slim = nodes.withColumn("ck", contract_key(F.col("fields")))
    ends = _two_ends(pairs, slim, ["ck", "protocol", "rate"])
    nested = F.exists("fields", lambda f: f["name"].contains(".") | (f["type"] == "object"))
    contracts = slim.select("ck", "fields", nested.alias("nested")).dropDuplicates(["ck"])
    aligned = align_contracts(ends.select("p_ck", "c_ck"), contracts)
    plans = ends.join(aligned, ["p_ck", "c_ck"])
    plans = select_backpressure(plans, "p_rate", "c_rate")
    envelope = envelope_name(F.col("p_protocol"), F.col("c_protocol"))
    kind = (F.when(envelope.isNotNull() & (F.size("mappings") > 0), "envelope+mapping")
            .when(envelope.isNotNull(), "envelope").when(F.size("mappings") > 0, "mapping").otherwise("same"))
    made = plans.select(
        "producer_id", "consumer_id", F.col("p_protocol").alias("producer_protocol"),
        F.col("c_protocol").alias("consumer_protocol"), kind.alias("kind"), envelope.alias("envelope"),
        F.lit(True).alias("normalize"), F.col("nested").alias("flatten"), "mappings", "limited", "limit_hz",
        F.lit("token_bucket").alias("backpressure_mode"), F.lit(version).alias("version"),
        F.col("p_fields").alias("producer_fields"), "p_ck", "c_ck")
    if not apart:
        return made
    return made.drop("mappings", "producer_fields"), aligned.select("p_ck", "c_ck", "mappings", F.col("p_fields").alias("producer_fields"))


def sample_record(fields: Column) -> Column:
    """A record with a value for each of the first five fields, by their types."""
    from .records import variant

    value = lambda f: (F.when(f["type"] == "int", variant(42)).when(f["type"] == "float", variant(3.14))
                       .when(f["type"] == "bool", variant(True)).otherwise(variant("test")))
    return last_wins(F.transform(F.slice(fields, 1, 5), lambda f: F.struct(f["name"].alias("key"), value(f).alias("value"))))


def validate_plans(plans: DataFrame, compat: bool = False, contracts: DataFrame | None = None) -> DataFrame:
    """Run a five-field sample record through each plan; ``output`` holds its keys and texts without provenance.

    The steps are those that messages take (``records.run_plans``). A plan is valid if something
    comes out: not where its envelope is unknown to records or gives nothing, and, with ``compat``,
    not where its limiter is slower than one message per second, as it starts without a token.
    ``contracts`` holds the wide columns if the plans come without them (``plan_adapters``, ``apart``).
    """
    from .records import record_text, run_plans

    # written once: the cases are taken from the plans and joined back to them
    plans = durable(plans)
    # the outcome depends on the contracts, the steps and the envelope, so each combination runs once
    case, wide = ["p_ck", "c_ck", "envelope", "normalize", "flatten"], ["producer_fields", "mappings"]
    if contracts is not None:
        cases = plans.select(*case).distinct().join(contracts, ["p_ck", "c_ck"])
    else:
        # on one of its plans, found by number: plans are wide, and grouping them as they are sorts all of them
        numbered = plans.withColumn("__i", F.monotonically_increasing_id())
        first = counted(numbered.groupBy(*case).agg(F.min("__i").alias("__i")).select("__i"))
        cases = numbered.select("__i", *case, *wide).join(first, "__i").drop("__i")
    # few bytes and much work: not joined into one task; written once, as the outcome is read and filtered by
    cases = cases.repartition(int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *case)
    ran = run_plans(cases.withColumn("record", sample_record(F.col("producer_fields"))))
    out = counted(ran.select(*[F.col(c).alias("__" + c) for c in case], record_text(F.col("output")).alias("output"),
                             *(wide if contracts is not None else [])))
    same = F.lit(True)
    for c in case:
        same = same & (plans[c].eqNullSafe(F.col("__" + c)) if c == "envelope" else plans[c] == F.col("__" + c))
    joined = plans.join(out, same).drop(*["__" + c for c in case])
    starved = F.coalesce(F.col("limited") & (F.col("limit_hz") < 1), F.lit(False)) if compat else F.lit(False)
    return joined.withColumn("output", F.when(~starved, F.col("output"))).withColumn("valid", F.col("output").isNotNull())


def synthesis_events(validated: DataFrame) -> DataFrame:
    """One event per plan that failed validation."""
    return validated.filter(~F.col("valid")).select(
        F.lit("synthesis_failed").alias("type"), "producer_id", "consumer_id")


# ---- provenance -----------------------------------------------------------------------

def provenance_message(producer: str, consumer: str, version: str, at: str) -> Column:
    """Signed text; ``at`` holds whole epoch seconds."""
    return F.concat_ws(":", producer, consumer, version, F.col(at).cast("string"))


def sign_provenance(df: DataFrame, message: Column, secret: bytes, name: str = "provenance") -> DataFrame:
    return df.withColumn(name, hmac_sha256(secret, message))


def verify_provenance(df: DataFrame, message: Column, secret: bytes, name: str = "provenance") -> DataFrame:
    return df.withColumn("verified", F.coalesce(F.col(name) == hmac_sha256(secret, message), F.lit(False)))
