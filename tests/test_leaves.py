"""Leaves of JSON documents, however deep."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bridgeflow.functions import leaves as lv
from bridgeflow.operators import contracts as ct
from bridgeflow.operators import transform as tr

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-10**20, 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6),
                      lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@given(VALUES, st.sampled_from([None, 1]))
@settings(max_examples=300, deadline=None)
def test_deep_reader_agrees(value, indent):
    text = json.dumps(value, indent=indent, ensure_ascii=bool(indent))
    assert lv._read_deep(text) == lv._read(text)
    assert type(lv._read_deep(text)) is type(lv._read(text))
    if isinstance(value, (dict, list)):
        assert json.loads(lv._text(lv._read_deep(text))) == json.loads(text)


@given(st.text(alphabet='{}[]",:01.eE-+ truefalsn\\\\', max_size=14))
@settings(max_examples=500, deadline=None)
def test_deep_reader_refuses_the_same(text):
    def outcome(read):
        try:
            return read(text.strip(" "))
        except ValueError:
            return "refused"

    assert outcome(lv._read_deep) == outcome(lv._read)


@pytest.mark.parametrize("depth", [5_000, 30_000])
def test_any_depth(spark, depth):
    arrays = '{"a":' + "[" * depth + "1" + "]" * depth + ',"b":2}'
    objects = '{"a":' * depth + "1" + "}" * depth
    broken = '{"a":' * depth + "1" + "}" * (depth - 1)
    mixed = '{"a":' + '[{"x":' * depth + "null" + "}]" * depth + "}"
    df = spark.createDataFrame([(0, arrays), (1, objects), (2, broken), (3, mixed), (4, '{"ok":1}')], "i int, j string")
    made = {r["i"]: r["m"] for r in df.select("i", tr.flatten_json(F.col("j")).alias("m")).collect()}
    assert made[0] == {"a": "[" * depth + "1" + "]" * depth, "b": "2"}
    assert made[1] == {".".join("a" * depth): "1"}
    assert made[2] is None and made[4] == {"ok": "1"}
    assert made[3] == {"a[0].x" + "[0].x" * (depth - 1): None}
    fields = {r["i"]: [(f["name"], f["type"]) for f in r["f"]] for r in df.filter("i IN (0, 4)").select("i", ct.infer_fields(F.col("j")).alias("f")).collect()}
    assert fields[0][1][0] == "b" and fields[4][0][0] == "ok"
