"""JSON schemas: places by prefix, keys and places that no keyword looked at, and schemas that recur, level by level."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.operators import validation as C

PAIR = {"prefixItems": [{"type": "string"}, {"type": "number"}]}
CASES = [
    (PAIR, [(["a", 1], True), (["a"], True), ([], True), (["a", 1, {}], True), ([1], False), ({"a": 1}, True)]),
    (PAIR | {"items": False}, [(["a", 1], True), (["a", 1, 2], False)]),
    (PAIR | {"items": {"type": "boolean"}}, [(["a", 1, True, False], True), (["a", 1, 2], False)]),
    (PAIR | {"unevaluatedItems": False}, [(["a", 1], True), (["a", 1, 2], False)]),
    ({"unevaluatedItems": {"type": "number"}, "contains": {"type": "string"}}, [(["a", 1, "b"], True), (["a", True], False), ([1], False)]),
    ({"allOf": [PAIR], "unevaluatedItems": False}, [(["a", 1], True), (["a", 1, 2], False)]),
    ({"anyOf": [PAIR, {"prefixItems": [True, True, {"const": 9}]}], "unevaluatedItems": False}, [(["a", 1], True), (["a", 1, 9], True), (["a", 1, 8], False), ([1, 1, 9], True)]),
    ({"if": {"prefixItems": [{"const": 1}]}, "then": {"prefixItems": [True, True]}, "else": {"items": True}, "unevaluatedItems": False}, [([1, 2], True), ([1, 2, 3], False), ([5, 6, 7], True)]),
    ({"properties": {"a": True}, "unevaluatedProperties": False}, [({"a": 1}, True), ({"a": 1, "b": 2}, False), ([], True), ({}, True)]),
    ({"properties": {"a": True}, "patternProperties": {"^x": True}, "unevaluatedProperties": {"type": "string"}}, [({"a": 1, "xb": 2, "c": "d"}, True), ({"c": 1}, False)]),
    ({"allOf": [{"properties": {"a": True}}], "properties": {"b": True}, "unevaluatedProperties": False}, [({"a": 1, "b": 2}, True), ({"c": 1}, False)]),
    ({"anyOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": {"const": 2}}, "required": ["b"]}], "unevaluatedProperties": False}, [({"a": 1}, True), ({"a": 1, "b": 2}, True), ({"a": 1, "b": 3}, False)]),
    ({"oneOf": [{"properties": {"k": {"const": "a"}, "x": True}}, {"properties": {"k": {"const": "b"}, "y": True}}], "required": ["k"], "unevaluatedProperties": False}, [({"k": "a", "x": 1}, True), ({"k": "b", "x": 1}, False), ({"k": "b", "y": 1}, True)]),
    ({"not": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "unevaluatedProperties": False}, [({}, True), ({"a": 2}, False)]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"x": True}}, "else": {"properties": {"y": True}}, "unevaluatedProperties": False}, [({"k": 1, "x": 2}, True), ({"k": 1, "y": 2}, False), ({"y": 2}, True), ({"k": 2, "y": 1}, False)]),
    ({"$ref": "#/$defs/base", "properties": {"b": True}, "unevaluatedProperties": False, "$defs": {"base": {"properties": {"a": True}}}}, [({"a": 1, "b": 1}, True), ({"c": 1}, False)]),
    ({"additionalProperties": {"type": "number"}, "unevaluatedProperties": False}, [({"a": 1}, True), ({"a": "x"}, False)]),
    ({"properties": {"o": {"properties": {"a": True}, "unevaluatedProperties": False}}}, [({"o": {"a": 1}, "p": 1}, True), ({"o": {"b": 1}}, False)]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(spark, k):
    schema, docs = CASES[k]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(docs)], "i int, d string")
    got = {r["i"]: r["v"] for r in df.select("i", C.schema_valid(F.col("d"), schema).alias("v")).collect()}
    assert [got[i] for i in range(len(docs))] == [w for _, w in docs]


TREE = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}, "by": {"additionalProperties": {"$ref": "#/$defs/leaf"}}, "pair": {"prefixItems": [{"$ref": "#/$defs/node"}]}}, "required": ["v"], "unevaluatedProperties": False}, "leaf": {"allOf": [{"type": ["object", "string"]}], "properties": {"up": {"$ref": "#/$defs/node"}}}}}


def test_recurring_schemas(spark):
    deep = {"v": 1}
    for _ in range(25):
        deep = {"v": 1, "kids": [deep, {"v": 2}]}
    broken = json.loads(json.dumps(deep).replace('{"v": 1}', '{"v": "x"}'))
    docs = [({"v": 1}, True), (deep, True), (broken, False), ({"v": 1, "kids": [{"v": 1, "kids": [{}]}]}, False), ({"v": 1, "by": {"a": "s", "b": {"up": {"v": 2}}}}, True), ({"v": 1, "by": {"b": {"up": {"v": "2"}}}}, False), ({"v": 1, "by": {"b": 3}}, False), ({"v": 1, "pair": [{"v": 1}, 5]}, True), ({"v": 1, "pair": [{"w": 1}]}, False), ({"v": 1, "extra": 1}, False), ([], False)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(docs)] + [(90, "{"), (91, None)], "i int, d string")
    got = {r["id"]: r["valid"] for r in C.schema_checked(df, "i", "d", TREE).collect()}
    assert got == {i: w for i, (_, w) in enumerate(docs)} | {90: None, 91: None}
    assert C.schema_checked(df.where("false"), "i", "d", TREE).collect() == []


def test_flat_schemas_are_checked_alike(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (1, '{"a": "x"}'), (2, '{"a": 2}'), (3, "no")], "i int, d string")
    assert {tuple(r) for r in C.schema_checked(df, "i", "d", {"properties": {"a": {"type": "number"}}}).collect()} == {(1, False), (2, True), (3, None)}


@pytest.mark.parametrize("schema", [{"anyOf": [{"items": {"$ref": "#"}}]}, {"$ref": "#"}, {"allOf": [{"$ref": "#/$defs/a"}], "$defs": {"a": {"allOf": [{"$ref": "#/$defs/a"}]}}}, {"properties": {"a": {"not": {"$ref": "#"}}}}])
def test_recursion_that_is_refused(spark, schema):
    with pytest.raises(ValueError):
        C.schema_checked(spark.createDataFrame([(1, "{}")], "i int, d string"), "i", "d", schema)
