"""Broken JSON objects, all of them with a defined result."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import repair
from tidemark.functions import text as X

BROKEN = [
    ('{"a": 1}', {"a": 1}),
    ('{"a": 1,}', {"a": 1}),
    ('{"a": 1', {"a": 1}),
    ('{"a": "x', {"a": "x"}),
    ('{"a": "x}', {"a": "x"}),
    ('{"a": [1, 2', {"a": [1, 2]}),
    ('{"a": {"b": [1, {"c": 2', {"a": {"b": [1, {"c": 2}]}}),
    ("{'a': 'x'}", {"a": "x"}),
    ("{'a': \"it's\"}", {"a": "it's"}),
    ('{"a": "say "hello" now"}', {"a": 'say "hello" now'}),
    ("{a: 1, b_c: x y}", {"a": 1, "b_c": "x y"}),
    ('{"a": True, "b": None, "c": false}', {"a": True, "b": None, "c": False}),
    ('{"a": "1" "b": 2}', {"a": "1", "b": 2}),
    ('{"a": [1 , , 2]}', {"a": [1, 2]}),
    ('{"a": , "b": 2}', {"a": None, "b": 2}),
    ('{"a", "b": 2}', {"a": None, "b": 2}),
    ('{"a" 1}', {"a": 1}),
    ('{"a": 1, // one\n "b": 2 /* two */, # three\n "c": 3}', {"a": 1, "b": 2, "c": 3}),
    ('Here: ```json\n{"a": 1}\n``` and {"b": 2}', {"a": 1}),
    ('{"a": .5, "b": +1, "c": 5., "d": 0x1f, "e": 1_000, "f": 007}', {"a": 0.5, "b": 1, "c": 5.0, "d": 31, "e": 1000, "f": 7}),
    ('{"a": NaN, "b": -Infinity, "c": 1e999}', {"a": None, "b": None, "c": None}),
    ('{"a": "line\nbreak\ttab"}', {"a": "line\nbreak\ttab"}),
    (r'{"a": "\x é \u12 \" \\"}', {"a": 'x é u12 " \\'}),
    ("{“a”: “x”}", {"a": "x"}),
    ('{"a": [1, 2}, "b": 3}', {"a": [1, 2]}),
    ('{"a": 1]}', {"a": 1}),
    ('{"a": 1, "a": 2}', {"a": 2}),
    ('{"a": [{"b": 1}, {"b": 2]}', {"a": [{"b": 1}, {"b": 2}]}),
    ("{", {}),
    ('{"a', {"a": None}),
    ('{"a":', {"a": None}),
    ('{"url": "http://x.y/z", "n": 1', {"url": "http://x.y/z", "n": 1}),
    ("{a: b c, d: e}", {"a": "b c", "d": "e"}),
    ("no object", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("text,want", BROKEN)
def test_broken_objects(text, want):
    assert repair.repaired(text) == want


def test_long_and_deep_texts():
    for unit in ('{"a":', "{", '{"a": "', "[{", '"', "'", "{a ", "\\", "/*", "//", '{"a" "b"', ": ,", '{"a": "b" '):
        began = time.process_time()
        repair.json_text("{" + unit * (200_000 // len(unit)))
        assert time.process_time() - began < 10, unit
    assert repair.repaired("{" + '"a": {' * 600) is None
    assert repair.json_text("{" + '"a": {' * 400) is not None


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet=st.characters(blacklist_characters="\"'`:")), VALUES))
def test_anything_gives_json(value):
    text = json.dumps(value)
    for k in (len(text), len(text) // 2, len(text) - 1):
        json.loads(repair.json_text("x " + text[:k]) or "null")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}[]:,\"'ab1 \n\\/#*"))
def test_no_text_fails(text):
    json.loads(repair.json_text(text) or "null")


def test_objects_in_a_table(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(BROKEN)], "k int, t string")
    got = {r["k"]: r["o"] for r in rows.select("k", X.json_object(F.col("t"), "b int, url string").alias("o")).collect()}
    for k, (_, want) in enumerate(BROKEN):
        if want is None:
            assert got[k] is None
        else:
            b = want.get("b")
            assert got[k]["b"] == (b if isinstance(b, int) and not isinstance(b, bool) else None) and got[k]["url"] == want.get("url")
