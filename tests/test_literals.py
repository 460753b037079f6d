"""Small inputs with known results."""

import hashlib
import hmac
import itertools
import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from bridgeflow.functions import fixed, text, units
from bridgeflow.operators import contracts as ct
from bridgeflow.operators import lifecycle as lc
from bridgeflow.operators import mapping as mp
from bridgeflow.operators import matching as mt
from bridgeflow.operators import metrics as mx
from bridgeflow.operators import policy as pl
from bridgeflow.operators import registry as rg
from bridgeflow.operators import transform as tr
from bridgeflow.operators.mapping import FieldMapping as M
from bridgeflow.sources import decode as dc
from bridgeflow.sources import files as fl


def one(spark, *columns, row=("x",), schema="v string"):
    return tuple(spark.createDataFrame([row], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v"))).collect())]


# ---- units ------------------------------------------------------------------------

def test_units(spark):
    assert values(spark, units.bytes_to_human, [1024.0, 1024.0 ** 2, 1024.0 ** 3, -2048.0, 1024.0 ** 5, 1.0], "double") == [
        "1.00 KB", "1.00 MB", "1.00 GB", "-2.00 KB", "1.00 PB", "1.00 B"]
    assert values(spark, units.bytes_to_human, ["big", None]) == ["big", None]
    assert values(spark, units.celsius_to_fahrenheit, [0.0, 100.0], "double") == [32.0, 212.0]
    assert values(spark, units.fahrenheit_to_celsius, [32.0, 212.0], "double") == [0.0, 100.0]
    assert values(spark, units.normalize_severity, ["warn", "err", "crit", "DEBUG", " 5 ", "odd", None]) == [
        "warning", "error", "critical", "debug", "critical", "info", "info"]


def test_time(spark):
    assert values(spark, units.unix_to_iso, ["0", "1.5", "-0.25", "soon", None]) == [
        "1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00", "1969-12-31T23:59:59.750000+00:00", "soon", "None"]
    assert values(spark, units.iso_to_unix, ["1970-01-01T00:00:00Z", "1970-01-01T01:00:00+0100", "1970-01-02 00:00:01", "12.5", "x T", "", None,
                                             "1970-01-01T00:00:00", "2024-02-30T00:00:00Z", "1970-01-01T00:00:00.5Z"]) == [
        0.0, 0.0, 86401.0, 12.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_time_in_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, units.unix_to_iso, ["1710054000"]) == ["2024-03-10T07:00:00+00:00"]
        assert values(spark, units.iso_to_unix, ["2024-03-10 02:30:00", "2024-03-10T02:30:00Z"]) == [1710037800.0, 1710037800.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# ---- transforms ----------------------------------------------------------------------

def test_severity_noise_and_empty(spark):
    df = spark.createDataFrame([("debug", "scan"), ("info", "probe"), ("warning", "odd"), ("error", "auth"), ("critical", "root")], "severity string, message string")
    assert tr.filter_severity(df, "warning").count() == 3
    assert tr.filter_severity(df.drop("severity"), "warning").count() == 5
    noisy = spark.createDataFrame([(m,) for m in ("heartbeat", "KEEPALIVE", "TCP port 443 open", "ping", "Service fingerprint: x", "shipping")], "message string")
    assert {r[0] for r in tr.suppress_noise(noisy).collect()} == {"TCP port 443 open", "Service fingerprint: x"}
    assert tr.suppress_noise(noisy, ["port"]).count() == 5
    empty = spark.createDataFrame([(None, "", 0), (None, "  ", None), ("a", None, None)], "a string, b string, c int")
    assert tr.suppress_empty(empty).count() == 2
    assert tr.suppress_empty(empty, ["a", "b"]).count() == 1


def test_scan_record_and_alert_chain(spark):
    rows = [(1712650010, "10.0.0.5", "22", "warning", "SSH brute-force attempt", (47, 12, None)),
            (1712650020, "10.0.0.8", "443", "error", "Invalid TLS cert", (None, None, "MISMATCH")),
            (1712650015, "10.0.0.1", "0", "debug", "keepalive", (None, None, None)), (None,) * 6]
    df = spark.createDataFrame(rows, "ts long, src_ip string, portid string, lvl string, msg string, meta struct<attempts:int,duration_s:int,cert_cn:string>")
    spec = {"normalize_fields": True, "flatten": True, "drop_fields": ["meta.duration_s"], "suppress_noise": True, "suppress_empty": True,
            "unit_conversions": {"timestamp": "unix_to_iso", "severity": "normalize_severity"}, "filter_severity": "warning",
            "enrich": {"bridge_id": "br", "source": "scan"}}
    out = tr.RecordConverter.from_spec(spec).apply(df)
    got = [r.asDict() for r in out.orderBy("timestamp").collect()]
    assert [r["severity"] for r in got] == ["warning", "error"]
    assert got[0]["timestamp"] == "2024-04-09T08:06:50+00:00" and got[0]["source.address"] == "10.0.0.5" and got[0]["meta.attempts"] == 47
    assert "meta.duration_s" not in got[0] and got[0]["_ic_source"] == "scan" and got[0]["port"] == "22"


def test_rejected_rows_skip_later_steps(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "n int, s string")
    chain = (tr.RecordConverter().add_step("half", lambda d: d.withColumn("n", F.col("n") / 2), valid=lambda d: F.col("n").isNotNull())
             .add_step("keep", lambda d: tr.keep_fields(d, {"n"})))
    assert [tuple(r) for r in chain.apply(df).collect()] == [(0.5,)]
    assert [(r["step"], json.loads(r["record"])) for r in chain.rejects(df).collect()] == [("half", {"s": "b"})]
    assert tr.RecordConverter().rejects(df).count() == 0


def test_last_name_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "TS int, time int, other int")
    assert tr.normalize_fields(df).first().asDict() == {"timestamp": 2, "other": 3}
    assert tr.normalize_fields(df, {"other": "x"}).columns == ["timestamp", "x"]


def test_flatten_and_back(spark):
    df = spark.createDataFrame([(("192.168.1.1", ("Linux", "5.15")), (443, ("https",)), 0.92)],
                               "host struct<address:string,os struct<name:string,version:string>>, port struct<id:int,service struct<name:string>>, score double")
    flat = tr.flatten_nested(df)
    assert flat.columns == ["host.address", "host.os.name", "host.os.version", "port.id", "port.service.name", "score"]
    assert tr.unflatten_dotted(flat).first() == df.first()


def test_json_depth(spark):
    got = values(spark, tr.flatten_json, [
        '{"a": {"b": {"c": 1}}, "d": [{"x": 1}, {"x": {"y": [2, 3]}}, 7], "e": {}, "f": [1.5, {"z": 1}], "g": []}',
        '{"a":{"b":{"c":{"d":{"e":{"f":{"g":"deep"}}}}}}}', '{"a.b":1,"a":{"b":2},"k":1,"k":null}', "[1]", "no", None, "{}"])
    assert got == [{"a.b.c": "1", "d[0].x": "1", "d[1].x.y": "[2,3]", "d[2]": "7", "f": '[1.5,{"z":1}]', "g": "[]"},
                   {"a.b.c.d.e.f.g": "deep"}, {"a.b": "2", "k": None}, None, None, None, {}]
    fields = values(spark, ct.infer_fields, ['{"a":{"b":{"c":{"d":{"e":{"f":{"g":1e3}}}}}}}'])[0]
    assert [(f["name"], f["type"]) for f in fields] == [("a.b.c.d.e.f.g", "float")]


def test_flatten_record_arrays(spark):
    df = spark.createDataFrame(
        [(1, [(1, [("p",)]), (2, []), (3, [("q",), ("r",)])]), (2, []), (3, None)], "id int, a array<struct<x:int,b:array<struct<y:string>>>>")
    flat = tr.flatten_nested(df, arrays=True)
    assert flat.columns == ["id", "a[0].x", "a[0].b[0].y", "a[1].x", "a[2].x", "a[2].b[0].y", "a[2].b[1].y"]
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [(1, 1, "p", 2, 3, "q", "r"), (2,) + (None,) * 6, (3,) + (None,) * 6]
    assert tr.flatten_nested(df).columns == ["id", "a"]
    assert tr.RecordConverter.from_spec({"flatten": True, "flatten_arrays": True}).apply(df).columns == flat.columns


def test_spec_keys(spark):
    with pytest.raises(ValueError):
        tr.RecordConverter.from_spec({"flaten": True})


# ---- sources ---------------------------------------------------------------------------

def test_csv(spark):
    got = values(spark, fl.csv_to_records, ["name,value\na,1\n", "x,y\r\n1,2\r\n3,\"4\n,\"\"5\"\r\n", "h,g\nonly\n", "a,b\n,\n1,2,3", "", "a,b,a\n1,2,3\n4", 'a,a\n"x",y'])
    assert got == [[{"name": "a", "value": "1"}], [{"x": "1", "y": "2"}, {"x": "3", "y": '4\n,"5'}], [{"h": "only", "g": None}],
                   [{"a": "", "b": ""}, {"a": "1", "b": "2"}], [], [{"a": "3", "b": "2"}, {"a": None, "b": None}], [{"a": "y"}]]


def test_csv_long_quoted_cell(spark):
    cell = "x," * 50_000
    assert values(spark, fl.csv_to_records, [f'a,b\n"{cell}",2']) == [[{"a": cell, "b": "2"}]]


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("b,1", 'q"x', None)], "z string, a string, m string")
    fl.write_csv(df, str(tmp_path / "out"))
    back = fl.csv_source(spark, str(tmp_path / "out"))
    assert back.columns == ["a", "m", "z"] and tuple(back.first()) == ('q"x', None, "b,1")


def test_xml(spark):
    schema = T.StructType([T.StructField("@id", T.StringType()), T.StructField("@type", T.StringType()), T.StructField("value", T.StringType())])
    got = values(spark, lambda c: fl.xml_to_records(c, schema), ['<item id="42" type="sensor"><value>99</value></item>', "not xml at all"])
    assert got[0]["@id"] == "42" and got[0]["value"] == "99" and got[0]["_raw_xml"] is None
    assert got[1]["_raw_xml"] == "not xml at all"


def test_xml_without_a_schema(spark):
    deep = "<a>" * 3_000 + "</a>" * 3_000
    texts = ['<item id="42"><value>99</value></item>', "<r> t <b/>tail<b>1</b><b x='2'>3</b></r>", "<n:r xmlns:n='u' n:k='v'><n:c/></n:r>", "not xml", "", None, "<e/>", deep, "<a>&lt;é</a>"]
    got = [None if r is None else json.loads(r) for r in values(spark, lambda c: F.to_json(fl.xml_to_variant(c)), texts)]
    assert got == [{"item": {"@id": "42", "value": "99"}}, {"r": {"_text": "t", "b": ["", "1", {"@x": "2", "_text": "3"}]}}, {"r": {"@{u}k": "v", "c": ""}},
                   {"_raw_xml": "not xml"}, {"_raw_xml": ""}, None, {"e": ""}, {"_raw_xml": deep}, {"a": "<é"}]


def test_decode(spark):
    rows = [("kafka", b'{"a":1}'), ("mqtt", b"\xff\xfe"), ("socket", b" hi \n"), ("zeromq", b"\x01\xab"), ("rest", b"[1,2]"), ("rest", b"5"), ("websocket", b"txt")]
    df = dc.decode_payload(spark.createDataFrame(rows, "protocol string, raw binary"))
    got = [json.loads(r[0]) for r in df.select(F.to_json("payload")).collect()]
    assert got == [{"a": 1}, {"data": "��"}, {"line": "hi"}, {"data": "01ab"}, {"data": [1, 2]}, {"data": 5}, {"data": "txt"}]


def test_message_id(spark):
    docs = ['{"seq": 3, "id": "x"}', '{"uuid": null, "seq": 1}', '{"message_id": true}', '{"a": 1}', "[1]", '{"sequence": 2.50}']
    assert values(spark, dc.message_id, docs) == ["x", "None", "True", None, None, "2.5"]


def test_endpoints(spark):
    df = spark.createDataFrame([("kafka", "b1:9092/topic"), ("kafka", "b1:9092"), ("mqtt", "mqtt://h:1884/a/b/#"), ("mqtt", "h"), ("socket", "h:7"),
                                ("socket", "h"), ("amqp", "amqp://u@h/v"), ("amqp", "h:5672/q"), ("grpc", "h:1/S/M"), ("grpc", "h:1/S")], "p string, e string")
    got = [tuple(r[0]) for r in df.select(dc.parse_endpoint(F.col("e"), F.col("p"))).collect()]
    assert got == [("b1:9092", "b1", 9092, "topic", None), ("b1:9092", "b1", 9092, "default", None), ("h:1884", "h", 1884, "a/b/#", "a/b"),
                   ("h", "h", 1883, "default/#", "default"), ("h:7", "h", 7, None, None), ("h", "h", 9000, None, None),
                   ("amqp://u@h/v", None, None, "default", None), ("amqp://guest:guest@h:5672/", None, None, "q", None),
                   ("h:1/S/M", "h:1", None, "S/M", None), ("h:1/S", "h:1", None, None, None)]


# ---- mapping ------------------------------------------------------------------------------

@pytest.mark.parametrize("value, kind, target, want", [
    ("99", "string", "int", 99), ("3.14", "string", "float", 3.14), (7, "int", "str", "7"), ("x", "string", "int", 0), ("x", "string", "float", 0.0),
    ("3.9", "string", "int", 0), (3.9, "double", "int", 3), ("false", "string", "bool", True), ("", "string", "bool", False), (0, "int", "bool", False),
    (True, "boolean", "str", "True"), (True, "boolean", "int", 1), (" 1_000 ", "string", "int", 1000), (5, "int", "other", "5")])
def test_cast(spark, value, kind, target, want):
    df = spark.createDataFrame([(value,)], f"a {kind}")
    assert mp.apply_mapping(df, [M("a", "b", "cast:" + target)]).first()["b"] == want


def test_mapping_rules(spark):
    df = spark.createDataFrame([(42, "x", (51.5,), (1, 2), None)], "a int, z string, coords struct<lat:double>, m struct<x:int,y:int>, k string")
    out = mp.apply_mapping(df, [M("a", "b"), M("coords", "lat", "extract:lat"), M("m", "m", "flatten"), M("k", "o", "enrich:ic"), M("no", "where")]).first().asDict()
    assert out == {"b": 42, "lat": 51.5, "m_x": 1, "m_y": 2, "o": None, "z": "x"}
    assert mp.apply_mapping(df.select("a", "z"), [M("a", "z")]).first().asDict() == {"z": "x"}


def test_aliased_sources(spark):
    df = spark.createDataFrame([("w",)], "lvl string")
    pre = tr.RecordConverter.from_spec({"normalize_fields": True})
    assert mp.apply_mapping(df, [M("lvl", "out")], pre=pre).columns == ["out"]
    assert mp.apply_mapping(df, [M("lvl", "out")], pre=pre, aliased_sources=False).columns == ["severity"]


def test_envelopes(spark):
    out = mp.mqtt_to_kafka(spark.createDataFrame([("t", 1)], "topic string, value int")).first()
    assert out["key"] == "t" and json.loads(bytes(out["value"])) == {"topic": "t", "value": 1} and out["headers"] == {"source": "mqtt"}
    assert mp.envelope_for("mqtt", "kafka") is mp.mqtt_to_kafka and mp.envelope_for("mqtt", "rest") is None
    mp.register_envelope("mqtt", "file", "mine", lambda d: d)
    assert one(spark, mp.envelope_name(F.lit("mqtt"), F.lit("file")))[0] == "mine"
    del mp.ENVELOPES[("mqtt", "file")]


def test_hmac(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, text.hmac_sha256(key, F.lit("mé")))[0] == hmac.new(key, "mé".encode(), hashlib.sha256).hexdigest()


def test_backpressure(spark):
    df = spark.createDataFrame([(10.0, 10.0), (1000.0, 5.0), (10.0, None), (None, 5.0), (10.0, 0.0)], "producer_rate double, consumer_rate double")
    assert [r["limited"] for r in mp.select_backpressure(df).collect()] == [False, True, False, False, False]


# ---- contracts -------------------------------------------------------------------------------

def test_fields(spark):
    doc = '{"i":1,"f":1.5,"s":"x","b":true,"l":[],"d":{},"n":null,"big":123456789012345678901}'
    got = values(spark, ct.infer_fields_shallow, [doc, "[1]", "{}"])
    assert [(f["name"], f["type"]) for f in got[0]] == [("i", "int"), ("f", "float"), ("s", "str"), ("b", "bool"), ("l", "array"), ("d", "object"), ("n", "str"), ("big", "int")]
    assert [(f["name"], f["type"]) for f in got[1]] == [("data", "object")] == [(f["name"], f["type"]) for f in got[2]]
    deep = values(spark, lambda c: ct.infer_fields(c), ['{"z": {"y": {"x": 1, "e": {}}}, "a": [1]}'])[0]
    assert [tuple(f) for f in deep] == [("z.y.x", "int", False), ("data", "object", False), ("a", "array", True)]


def test_tags_ports_and_roles(spark):
    tags = lambda names: one(spark, ct.semantic_tags(F.array(*[F.lit(n) for n in names])))[0]
    assert tags(["lat", "lon", "alt"]) == ["geospatial"] and tags(["price", "bid", "ask"]) == ["market"] and tags(["foo"]) == ["generic"]
    assert values(spark, ct.protocol_of_port, [50051, 8080, 9092, 1883, 12345], "int") == ["grpc", "rest", "kafka", "mqtt", "socket"]
    assert values(spark, ct.infer_role, [1.0, 0.0, None], "double") == ["producer", "both", "both"]
    df = spark.createDataFrame([(["grpc"], {}), (["mqtt"], {}), (["rest"], {"protocol": "kafka"}), ([], {"address": "h"})], "tags array<string>, meta map<string,string>")
    got = [(r["protocol"], r["endpoint"]) for r in ct.catalog_protocol_endpoint(df.withColumn("port", F.lit(1))).collect()]
    assert got == [("grpc", "grpc://localhost:1"), ("mqtt", "mqtt://localhost:1"), ("kafka", "kafka://localhost:1"), ("rest", "http://h:1")]


def test_catalog_contract(spark):
    rows = [("S-1", ["rest", "market"], {"confidence": "2.0", "rate_hz": "10.5", "field.price": "float"}), ("S-2", None, {"confidence": "-1.0"}),
            ("S-3", [], {"confidence": "high"}), ("S-4", ["http"], None)]
    got = ct.catalog_contract(spark.createDataFrame(rows, "service string, tags array<string>, meta map<string,string>")).collect()
    assert [(r["service"], r["confidence"], r["rate"], r["semantic_tags"], r["fields"][0]["name"]) for r in got] == [
        ("S-1", 1.0, 10.5, ["market"], "price"), ("S-2", 0.1, None, ["s_2"], "data"), ("S-4", 0.85, None, ["s_4"], "data")]


def python_fingerprint(names, tags, encoding="json"):
    payload = json.dumps({"fields": sorted(names), "tags": sorted(tags), "encoding": encoding}, sort_keys=True)
    return hashlib.sha256(payload.encode()).hexdigest()[:16]


def test_fingerprint_of_odd_names(spark):
    names = ['q"t', "back\\slash", "tab\t", "é", "😀", "\x01", "plain", "\x7f", "line\nfeed"]
    rows = [(list(p), ["t2", "t1"]) for p in itertools.islice(itertools.permutations(names), 0, 2000, 500)]
    df = spark.createDataFrame(rows, "n array<string>, g array<string>")
    got = {r[0] for r in df.select(ct.contract_fingerprint(F.col("n"), F.col("g"), F.lit("json"))).collect()}
    assert got == {python_fingerprint(names, ["t1", "t2"])}


# ---- matching ---------------------------------------------------------------------------------

def grams(s):
    s = s.lower()
    return {s[i:i + 3] for i in range(len(s) - 2)} | {s}


def python_align(src, dst):
    types = fixed.LOGICAL_TYPES
    used, out = set(), []
    for n, t in src:
        best, at = 0.3, -1
        for j, (m, u) in enumerate(dst):
            row = fixed.TYPE_COMPAT.get(t)
            compat = row[types.index(u)] if row and u in types else 0.2
            score = 0.6 * (len(grams(n) & grams(m)) / len(grams(n) | grams(m))) + 0.4 * compat
            if j not in used and score > best:
                best, at = score, j
        if at >= 0:
            used.add(at)
            out.append((n, dst[at][0], "direct" if t == dst[at][1] else "cast:" + dst[at][1], round(best, 9)))
    return out


def align(spark, pairs):
    kind = "array<struct<name:string,type:string>>"
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(pairs)], f"i int, s {kind}, d {kind}")
    made = mt.align_fields(mt.prepared_fields(F.col("s")), mt.prepared_fields(F.col("d")))
    return [[(m[0], m[1], m[2], round(m[3], 9)) for m in r[1]] for r in sorted(df.select("i", made.alias("m")).collect())]


def test_align(spark):
    assert align(spark, [([("price", "float")], [("price", "float")]), ([("n", "str")], [("n", "int")]), ([("data", "object")], [("x", "float")]), ([], [("x", "float")]),
                         ([("x", "float")], [])]) == [[("price", "price", "direct", 1.0)], [("n", "n", "cast:int", 0.72)], [], [], []]
    rnd = random.Random(1)
    words = ["temp", "temperature", "temp_c", "humidity", "humid", "ts", "timestamp", "id", "device_id", "val", "value"]
    side = lambda: [(rnd.choice(words), rnd.choice(fixed.LOGICAL_TYPES + ["integer"])) for _ in range(rnd.randrange(1, 7))]
    pairs = [(side(), side()) for _ in range(60)]
    assert align(spark, pairs) == [python_align(s, d) for s, d in pairs]


def python_embedding(s):
    vec = [0.0] * 4096
    for tok in s.lower().split():
        for n in (1, 2, 3):
            for i in range(len(tok) - n + 1):
                vec[int(hashlib.md5(tok[i:i + n].encode()).hexdigest()[:8], 16) % 4096] += 1
    norm = math.sqrt(sum(x * x for x in vec)) or 1.0
    return [sum(vec[i * 10:i * 10 + 10]) / norm / 10 for i in range(384)]


def test_embedding(spark):
    texts = ["encoding:json fields:price symbol", "Ünïcode çedilla 😀 x", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {r["id"]: r["embedding"] for r in mt.dense(mt.ngram_embedding(df, "id", "body"), "id").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(python_embedding(t))


def test_model_embedding(spark):
    df = spark.createDataFrame([("a",), ("bcd",)], "t string")
    out = mt.model_embedding(df, "t", lambda: lambda batch: [[len(x), 1.0] for x in batch])
    assert [r["embedding"] for r in out.collect()] == [[1.0, 1.0], [3.0, 1.0]]


def python_cosine(a, b):
    dot, na, nb = sum(x * y for x, y in zip(a, b)), math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 0.0 if na == 0 or nb == 0 else max(-1.0, min(1.0, dot / (na * nb)))


@pytest.mark.parametrize("minimum", [0.5, 0.72])
def test_scores_equal_the_full_product(spark, minimum):
    """Free rates and confidences, nodes in both roles, blacklisted and active pairs."""
    rnd = random.Random(2)
    words = ["price", "symbol", "lat", "lon", "temp", "level", "user_id"]
    tags = ["market", "telemetry", "drone", "generic", "json"]
    nodes = []
    for i in range(60):
        f = [(w, "float") for w in rnd.sample(words, 3)]
        nodes.append((f"n{i}", rnd.choice(["producer", "consumer", "both"]), rnd.choice(fixed.PROTOCOLS), f, rnd.sample(tags, rnd.randrange(0, 3)), "json",
                      rnd.choice([None, 0.0, round(10 ** rnd.uniform(-2, 4), 3)]), round(rnd.uniform(0.1, 1.0), 3)))
    outcomes = [("rest", "kafka", True), ("rest", "kafka", False), ("rest", "kafka", True), ("mqtt", "mqtt", False)]
    active = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(150)]
    listed = ["n3", "n4"]
    hist = {("rest", "kafka"): 2 / 3, ("mqtt", "mqtt"): 0.0}
    vec = {n[0]: python_embedding(f"encoding:json fields:{' '.join(f[0] for f in n[3])} tags:{' '.join(n[4])}") for n in nodes}
    want, opened, scored = {}, 0, 0
    broad = set(fixed.BROAD_TAGS)
    for p in nodes:
        for c in nodes:
            if p[1] == "consumer" or c[1] == "producer" or p[0] == c[0] or (p[0], c[0]) in active:
                continue
            opened += 1
            a, b = set(p[4]), set(c[4])
            if (a and b and not a & b and not a & broad and not b & broad) or p[7] < 0.2 or c[7] < 0.2:
                continue
            scored += 1
            pr = p[6] or 1.0
            cr = c[6] or pr
            lat = max(0.0, min(1.0, 0.5 + 0.5 * math.log10(max(min(pr, cr) / max(pr, cr), 1e-4) * 10000) / 4))
            risk = min(1.0, (p[0] in listed or c[0] in listed) * 1.0 + (p[2] == "unknown" or c[2] == "unknown") * 0.4 + (p[7] < 0.4 or c[7] < 0.4) * 0.3)
            compat = fixed.PROTOCOL_COMPAT[p[2]][fixed.PROTOCOLS.index(c[2])]
            s = min(p[7], c[7]) * (0.4 * python_cosine(vec[p[0]], vec[c[0]]) + 0.2 * compat + 0.15 * lat + 0.15 * (1 - risk) + 0.1 * hist.get((p[2], c[2]), 0.5))
            if round(s, 9) >= minimum:
                want[(p[0], c[0])] = round(s, 9)
    df = spark.createDataFrame(nodes, "node_id string, role string, protocol string, fields array<struct<name:string,type:string>>, tags array<string>, encoding string, rate double, confidence double")
    taken = spark.createDataFrame(active, "producer_id string, consumer_id string")
    history = mt.bridge_history(spark.createDataFrame(outcomes, "producer_protocol string, consumer_protocol string, success boolean"))
    got = mt.score_pairs(df, taken, history, min_score=minimum, blacklist=listed).collect()
    assert {(r["producer_id"], r["consumer_id"]): round(r["composite"], 9) for r in got} == pytest.approx(want) and want
    totals = mt.pair_prefilter(mt.node_profiles(df, listed), taken).agg(F.sum("open"), F.sum("scored"), F.sum("skipped")).first()
    assert tuple(totals) == (opened, scored, opened - scored)
    bound = mt.candidate_pairs(mt.node_profiles(df, listed), taken, history, min_score=minimum).agg(F.sum("n_pairs")).first()[0]
    assert bound >= len(want)


def test_queue(spark):
    minute = 60_000_000
    rows = [("p", "c1", 0.75, 200 * minute, 0), ("p", "c2", 0.95, 200 * minute, 1), ("p", "c3", 0.73, 80 * minute, 2), ("p", "c4", 0.99, 199 * minute, 3), ("p", "c2", 0.5, 0, 4)]
    queue = spark.createDataFrame(rows, "producer_id string, consumer_id string, composite double, created long, seq long")
    first = mt.queue_dedupe(queue)
    assert first.count() == 4
    got = [(r["consumer_id"], round(r["composite"], 4)) for r in mt.queue_pop(first, 200 * minute, 10).collect()]
    assert got == [("c4", 0.9405), ("c2", 0.95), ("c1", 0.75)]
    torn = spark.createDataFrame([("p", "c1", "persistent-errors"), ("p", "c2", "node-gone")], "producer_id string, consumer_id string, reason string")
    again = {r["consumer_id"]: r["composite"] for r in mt.queue_repush(first, torn, 0).collect()}
    assert again["c1"] == 0.5 and again["c2"] == 0.95
    assert mt.fanout_opportunities(queue).first()["consumers"] == 4


def test_history_and_compat(spark):
    out = mt.bridge_history(spark.createDataFrame([("r", "k", True), ("r", "k", True), ("r", "k", False)], "producer_protocol string, consumer_protocol string, success boolean"))
    assert round(out.first()["history"], 3) == 0.667
    for a, b in itertools.product(fixed.PROTOCOLS, repeat=2):
        assert fixed.PROTOCOL_COMPAT[a][fixed.PROTOCOLS.index(b)] > 0
    assert one(spark, mt.protocol_compat(F.lit("mqtt"), F.lit("kafka")), mt.protocol_compat(F.lit("mavlink"), F.lit("rest")), mt.type_similarity(F.lit("int"), F.lit("str")),
               mt.type_similarity(F.lit("integer"), F.lit("int"))) == (0.8, 0.3, 0.4, 0.2)


# ---- policy -------------------------------------------------------------------------------------

REFUSED = ["http://service/admin/users", "tcp://host:22", "https://auth.local/OAuth/token", "http://vault.local/vault/secret"]
ALLOWED = ["http://sensor.local:8080/data", "kafka://broker:9092/sensor-data"]


def test_refuse(spark):
    rules = pl.SecurityRules()
    got = values(spark, lambda c: pl.hard_refuse(c, rules), REFUSED + ALLOWED)
    assert all(got[:4]) and got[4:] == [None, None] and got[1] == "hard-refuse-pattern:*:22"
    assert values(spark, lambda c: pl.hard_refuse(c, pl.SecurityRules(refuse=False)), REFUSED) == [None] * 4
    assert values(spark, lambda c: pl.hard_refuse(c, pl.SecurityRules(extra_refused=["*:9999*"])), ["tcp://host:9999/stream"]) == ["hard-refuse-pattern:*:9999*"]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("ab*?[]!^.-\n", max_size=6), st.text("ab.[]!^-\n", max_size=5)), min_size=1, max_size=20))
def test_globs(spark, cases):
    import fnmatch

    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(cases)], "i int, v string")
    for i, (glob, value) in enumerate(cases):
        inner = glob[glob.find("["):]
        if "[" in glob and ("-" in inner or "^" in inner or "[" in inner[1:]):
            continue  # ranges and odd sets are covered by the literals below
        got = df.filter(F.col("i") == i).select(text.matches_glob(F.col("v"), glob)).first()[0]
        assert got == fnmatch.fnmatchcase(value, glob), (glob, value)


def test_glob_sets(spark):
    for glob, value, want in [("1[0-4]?", "137", True), ("2[!0-4]*", "25", True), ("2[!0-4]*", "21", False), ("a[^]b", "a^b", True), ("a.b", "axb", False), ("[", "[", True)]:
        assert one(spark, text.matches_glob(F.lit(value), glob))[0] is want, glob


def test_zones_and_allowlist(spark):
    rules = pl.SecurityRules(zones={"prod": ["p-*"], "test": ["t-*"], "staging": ["s-*"]}, auto_approved=[("prod", "staging")], allowlist=["approved-node-*", "sensor-001", "http://sensor.local/*"])
    z = lambda n: one(spark, pl.zone_of(F.lit(n), F.lit("e"), rules))[0]
    assert [z(n) for n in ("p-1", "t-1", "s-1", "x")] == ["prod", "test", "staging", "default"]
    needs = lambda a, b: one(spark, pl.needs_approval(F.lit(a), F.lit(b), rules))[0]
    assert [needs("prod", "prod"), needs("prod", "test"), needs("prod", "staging"), needs("staging", "prod")] == [False, True, False, False]
    ok = lambda n, e: one(spark, pl.allowlist_reason(F.lit(n), F.lit(e), rules))[0]
    assert ok("approved-node-7", "x") is None and ok("n", "http://sensor.local/a") is None and ok("other", "x") == "not-in-source-allowlist:other"
    assert one(spark, pl.allowlist_reason(F.lit("n"), F.lit("e"), pl.SecurityRules()))[0] is None


def test_policy_chain(spark):
    kind = "node_id string, endpoint string, protocol string, confidence double, rate double"
    nodes = spark.createDataFrame([("a", "e", "rest", 1.0, 1.0), ("b", "e", "rest", 1.0, 1.0), ("weak", "e", "rest", 0.1, 1.0), ("fast", "e", "rest", 1.0, 1e6),
                                   ("bad", "e", "rest", 1.0, 1.0), ("odd", "e", "unknown", 0.35, 1.0), ("w1", "e", "unknown", 0.1, None), ("w2", "e", "rest", 1.0, None)], kind)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id string")
    pairs = [("no", "b"), ("a", "b"), ("b", "a"), ("weak", "b"), ("fast", "a"), ("bad", "a"), ("a", "odd"), ("w1", "w2"), ("a", "w2")]
    df = spark.createDataFrame(pairs, "producer_id string, consumer_id string")
    active = spark.createDataFrame([("a", "b")], "producer_id string, consumer_id string")
    blocked = spark.createDataFrame([("a", "w2", "a")], "producer_id string, consumer_id string, blocked_by string")
    got = {(r["producer_id"], r["consumer_id"]): (r["verdict"], r["reason"]) for r in
           pl.evaluate_policy(df, nodes, active, pl.SecurityRules(), ids("bad"), ids("w1", "w2"), blocked=blocked).collect()}
    assert got == {("no", "b"): ("reject", "node-not-found"), ("a", "b"): ("approve", "all-checks-passed"), ("b", "a"): ("reject", "circular-dependency"),
                   ("weak", "b"): ("reject", "low-confidence-contract"), ("fast", "a"): ("stage", "extreme-rate-mismatch"),
                   ("bad", "a"): ("reject", "blacklisted-producer:bad"), ("a", "odd"): ("stage", "risk:0.70"), ("w1", "w2"): ("approve", "both-whitelisted"),
                   ("a", "w2"): ("reject", "rate-limit-exceeded:a")}
    capped = pl.evaluate_policy(df.filter("producer_id = 'fast'"), nodes, active, pl.SecurityRules(), ids(), ids(), cap=1).first()
    assert (capped["reason"], capped["audit_reason"]) == ("consumer-bridge-cap", "consumer-bridge-cap:1")


@pytest.mark.parametrize("seed, cap", [(1, 2), (2, 3), (3, 16)])
def test_settled_one_after_another(spark, seed, cap):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    pairs = [(a, b) for a in nodes for b in nodes if a != b and rng.random() < 0.7]
    active = [(a, b) for a, b in itertools.permutations(nodes, 2) if (a, b) not in pairs and rng.random() < 0.15][:3]
    kinds = [("approve", "all-checks-passed", 0.0)] * 5 + [("approve", "both-whitelisted", 0.0), ("stage", "risk:0.70", 0.7), ("reject", "blacklisted-producer:x", 1.0),
                                                       ("reject", "low-confidence-contract", 0.6), ("stage", "cross-zone-bridge:a→b", 0.8)]
    rows = [(a, b, round(rng.random(), 1), *(k := rng.choice(kinds))[:2], k[1], k[2]) for a, b in pairs]
    schema = "producer_id string, consumer_id string, composite double, verdict string, reason string, audit_reason string, risk double"
    held = {n: 0 for n in nodes}
    for a, b in active:
        held[a] += 1
        held[b] += 1
    approved, want = set(), {}
    for a, b, score, verdict, reason, _, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if reason.startswith(("blacklisted", "cross-zone")):
            pass
        elif reason != "both-whitelisted":
            if held[a] >= cap or held[b] >= cap:
                verdict, reason = "reject", "producer-bridge-cap" if held[a] >= cap else "consumer-bridge-cap"
            elif (b, a) in approved:
                verdict, reason = "reject", "circular-dependency"
        if verdict == "approve":
            approved.add((a, b))
            held[a] += 1
            held[b] += 1
        want[a, b] = (verdict, reason)
    active_df = spark.createDataFrame(active or [("x", "y")], "producer_id string, consumer_id string")
    got = pl.settle_batch(spark.createDataFrame(rows, schema), active_df, cap).collect()
    assert {(r["producer_id"], r["consumer_id"]): (r["verdict"], r["reason"]) for r in got} == want


@pytest.mark.parametrize("seed,cap,limit", [(4, 4, 5), (5, 16, 3)])
def test_settled_with_the_attempt_limit(spark, seed, cap, limit):
    """Cap, attempt limit with earlier attempts, reverse pairs and a node paired with itself, against a plain loop."""
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(12)]
    pairs = [(a, b) for a in nodes for b in nodes if rng.random() < 0.6]
    kinds = [("approve", "all-checks-passed")] * 6 + [("approve", "both-whitelisted"), ("stage", "risk:0.70"), ("reject", "circular-dependency"), ("reject", "blacklisted-producer:x")]
    rows = [(a, b, round(rng.random(), 1), *(k := rng.choice(kinds)), k[1], 0.25) for a, b in pairs]
    now = 100_000_000
    before = [(rng.choice(nodes), rng.choice(nodes), now - rng.choice([1, 59_999_999, 60_000_000, 90_000_000])) for _ in range(14)]
    asked = {n: 0 for n in nodes}
    for a, b, t in before:
        if now - t < 60_000_000:
            asked[a] += 1
            asked[b] += 1
    held, approved, want = {n: 0 for n in nodes}, set(), {}
    for a, b, score, verdict, reason, audit, risk in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if reason == "both-whitelisted":
            pass
        elif not reason.startswith("blacklisted"):
            capped = next((side for n, side in ((a, "producer"), (b, "consumer")) if held[n] >= cap), None)
            full = next((n for n in (a, b) if asked[n] >= limit), None)
            if capped:
                verdict, reason, audit, risk = "reject", capped + "-bridge-cap", f"{capped}-bridge-cap:{cap}", 0.5
            elif full:
                verdict, reason, audit, risk = "reject", "rate-limit-exceeded:" + full, "rate-limit:" + full, 0.3
            else:
                asked[a] += 1
                asked[b] += 1
                if (b, a) in approved and a != b:
                    verdict, reason, audit, risk = "reject", "circular-dependency", "circular-dependency", 0.8
        if verdict == "approve":
            approved.add((a, b))
            for n in {a, b}:
                held[n] += 1
        want[a, b] = (verdict, reason, audit, risk)
    frame = spark.createDataFrame(rows, "producer_id string, consumer_id string, composite double, verdict string, reason string, audit_reason string, risk double")
    none = spark.createDataFrame([], "producer_id string, consumer_id string")
    past = spark.createDataFrame(before, "producer_id string, consumer_id string, t long")
    got = pl.settle_batch(frame, none, cap, limit=limit, as_of=now, recorded=past)
    assert got.columns == frame.columns
    assert {(r["producer_id"], r["consumer_id"]): (r["verdict"], r["reason"], r["audit_reason"], r["risk"]) for r in got.collect()} == want
    assert {v[1].split(":")[0] for v in want.values()} >= {"rate-limit-exceeded", "both-whitelisted"}


def test_blocked_by_attempt(spark):
    nodes = spark.createDataFrame([(n, "http://" + n, "rest", 0.9, 1.0) for n in "ab"], "node_id string, endpoint string, protocol string, confidence double, rate double")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "attempt int, producer_id string, consumer_id string")
    blocked = spark.createDataFrame([(1, "a", "b", None), (2, "a", "b", "a")], "attempt int, producer_id string, consumer_id string, blocked_by string")
    none = nodes.select("node_id").limit(0)
    active = pairs.select("producer_id", "consumer_id").limit(0)
    by = lambda **k: {r["attempt"]: r["verdict"] for r in pl.evaluate_policy(pairs, nodes, active, pl.SecurityRules(), none, none, blocked=blocked, **k).collect()}
    assert by(attempt="attempt") == {1: "approve", 2: "reject"} and by() == {1: "approve", 2: "approve"}


def test_listed_nodes_score_lower(spark):
    profiles = mt.node_profiles(spark.createDataFrame([("a", "json", [("x", "int", False)], ["t"], 1.0, 0.9, "rest", "both"), ("b", "json", [("x", "int", False)], ["t"], 1.0, 0.9, "rest", "both")],
        "node_id string, encoding string, fields array<struct<name:string,type:string,nullable:boolean>>, tags array<string>, rate double, confidence double, protocol string, role string"),
        spark.createDataFrame([("a",), ("a",)], "node_id string"))
    assert {r["node_id"]: r["listed"] for r in profiles.collect()} == {"a": True, "b": False}


def test_audit_files(spark, tmp_path):
    rows = spark.createDataFrame([(86_400_000_000 * d + d, "APPROVE", "p", "c", 0.5, "ok") for d in range(3)],
                                 "recorded_at long, verdict string, producer_id string, consumer_id string, score double, reason string")
    for batch in ("a", "b", "b"):  # b ran twice
        pl.audit_append(rows, str(tmp_path / "log"), batch)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 6 and [r["recorded_at"] for r in pl.audit_recent(log, 2).collect()] == [172_800_000_002] * 2


# ---- tables -----------------------------------------------------------------------------------------

def test_percentiles_and_weights(spark):
    df = spark.createDataFrame([("b", float(i), i) for i in range(1, 101)], "k string, v double, i long")
    assert tuple(mx.latency_percentiles(df, "k", "v", ["i"]).first()) == ("b", 51.0, 100.0)
    assert tuple(mx.latency_percentiles_all(df, "k", "v").first())[0] == "b"
    edges = spark.createDataFrame([("a", "b", 0.85), ("c", "d", 0.5)], "producer_id string, consumer_id string, weight double")
    got = rg.reweight_edges(edges, spark.createDataFrame([("a",)], "node_id string"))
    assert {r["producer_id"]: r["weight"] for r in got.collect()} == {"a": 0.0, "c": 0.5}


def test_history_cap_and_drifted(spark):
    rows = [("a", i, 0.3 if i == 9 else 0.05, 1) for i in range(10)] + [("b", 0, 0.05, 1)]
    snaps = spark.createDataFrame(rows, "node_id string, turn long, delta double, n int")
    assert rg.drift_history(snaps, "turn", 5).filter("node_id = 'a'").count() == 5
    assert [r["node_id"] for r in rg.drifted_nodes(snaps, "turn").collect()] == ["a"]


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "bridges")
    for v, n in ((1, 3), (2, 5)):
        lc.write_snapshot(spark.range(n), root, v)
    (tmp_path / "bridges" / "v000000000003").mkdir()  # an unfinished write
    df, version = lc.read_snapshot(spark, root)
    assert (df.count(), version) == (5, 2)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.text("abcdé\"\\ ", max_size=4), max_size=5), min_size=1, max_size=10))
def test_fingerprints(spark, lists):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lists)], "i int, n array<string>")
    got = [r[1] for r in sorted(df.select("i", ct.contract_fingerprint(F.col("n"), F.array(F.lit("t")), F.lit("json"))).collect())]
    assert got == [python_fingerprint(n, ["t"]) for n in lists]
