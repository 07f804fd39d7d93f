"""JSON texts on odd input: canonical form, JSON5 and pointers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions import json_texts as J


def run(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", f(F.col("s")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


CANONICAL = [
    ('{"b":[1.50,1e3,-0,2.0,-0.0,1e-6,123456789012345678901,0.1234567890123456789,1E2,0.30000000000000004,1e20]}', '{"b":[1.5,1000,0,2,0,0.000001,123456789012345680000,0.12345678901234568,100,0.30000000000000004,100000000000000000000]}'),
    ('{"b":{"z":1,"Z":2},"a":"-0.50 \\" 1.0"}', '{"a":"-0.50 \\" 1.0","b":{"Z":2,"z":1}}'),
    ('{"\uff61":2,"\\ud83d\\ude00":1}', '{"😀":1,"｡":2}'),
    ('"\\ud800x\\\\ud800"', '"�x\\\\ud800"'),
    ('"\\udc00\\ud800\\ud800\\udc00"', '"��𐀀"'),
    ('"\\u000b\\u001F\\n\\u0041\\\\u000B\\/\\u007f"', '"\\u000b\\u001f\\nA\\\\u000B/\x7f"'),
    *[(t, None) for t in ('{"a":1,"a":2}', '{"a":1,"\\u0061":2}', "[1e-7]", "[1e21]", "[1e999]", "[-1e-400, 5e-324]", "[NaN]", "[Infinity]", "{} {}", "1 2", "1,", "[01]", "[-]", "[.5]", "[1.]", "[1,]", "", " ", "nope", "'a'", '{"a"}', '"\n"', '"\\x"', "[1]]", "[", None)],
    ("[]", "[]"), ("{}", "{}"), (" 5 ", "5"), ("null", "null"), ("-5e0", "-5"), ("[true , false]", "[true,false]"), ('"é\u2028"', '"é\u2028"'),
]


def test_canonical(spark):
    assert run(spark, [t for t, _ in CANONICAL], J.canonical_json) == [w for _, w in CANONICAL]


def test_canonical_of_random_documents(spark):
    rng = random.Random(5)

    def made(depth):
        k = rng.random()
        if depth == 0 or k < 0.4:
            return rng.choice([None, True, False, rng.randint(-(10**9), 10**9), round(rng.uniform(-1e6, 1e6), rng.randint(0, 6)), "".join(rng.choices('ab"\\/\n\t\x01é漢🙂{}[]:,-0.5', k=rng.randint(0, 8)))])
        if k < 0.7:
            return [made(depth - 1) for _ in range(rng.randint(0, 4))]
        return {"".join(rng.choices('ab"\\é｡🙂', k=rng.randint(0, 3))): made(depth - 1) for _ in range(rng.randint(0, 4))}

    def plain(v):
        if isinstance(v, dict):
            return "{" + ",".join(f"{plain(k)}:{plain(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(plain, v)) + "]"
        if isinstance(v, float):
            return "0" if v == 0 else repr(int(v)) if v == int(v) else repr(v)
        return json.dumps(v, ensure_ascii=False)

    docs = [made(4) for _ in range(300)]
    texts = [json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1))) for d in docs]
    assert run(spark, texts, J.canonical_json) == [plain(d) for d in docs]


JSON5 = [
    ("{a:'x.5'}", {"a": "x.5"}), ('{a:"// .7"}', {"a": "// .7"}), ("{a:'it\\'s .5'}", {"a": "it's .5"}), ("{a:1.}", {"a": 1}), ("{a:0x1F,b:-.5,c:+5,d:[1,],}", {"a": 31, "b": -0.5, "c": 5, "d": [1]}),
    ("'a\\\nb\\\r\nc'", "abc"), ("{a:'\\x41\\u0042\\v\\q\\0'}", {"a": "AB\vq\0"}), ("// c \\\n 5", 5), ("/* ' \" // */ [true,/**/false, null]", [True, False, None]), ("{a:'\"',\"b\":'\\\"'}", {"a": '"', "b": '"'}),
    ("{$é_1:'tab\there'}", {"$é_1": "tab\there"}), ("012", 12), ("1e", 1), ("1e2", 100), ("-0xff", -255), ('{"a":"\\\\"}', {"a": "\\"}), ("['\\\\',\"'\",'//']", ["\\", "'", "//"]), ("{a:{b:[{c:1,},],},}", {"a": {"b": [{"c": 1}]}}), ("\ufeff[\u00a01\u2028]", [1]), ('"a/b"', "a/b"), ("{a:1 /* } */ }", {"a": 1}),
    *[(t, None) for t in ("[1,,]", "[,]", "{a:1} x", "1 2", "{1:2}", "'un", "{,}", "", "0xZ", "nul", "{a 1}", "'\\xZ'", "'a\nb'", "[1", "[1]]", "{a:}", "/* un", "{a:1,,}", "trueish", "[1 2]", "+", ".", "--1", None)],
]


def test_json5(spark):
    got = run(spark, [t for t, _ in JSON5], J.json_of_json5)

    def read(t):
        try:
            return json.loads(t) if t else None
        except ValueError:
            return None

    assert [read(t) for t in got] == [w for _, w in JSON5]
    assert got[-1] is None


@pytest.mark.parametrize("text,want", [("{a:'x.5'}", ("x.5",)), ("{a:1,a:2}", ("2",)), ("{a:1} x", None), ("{a:[1,}", None), ("{b:1}", (None,)), ("{a:0x10}", ("16",)), (None, None)])
def test_from_json5(spark, text, want):
    got = run(spark, [text], lambda c: J.from_json5(c, "a string"))[0]
    assert (tuple(got) if got is not None else None) == want


def test_numbers_that_are_not_finite(spark):
    got = run(spark, ["[NaN, -Infinity, +Infinity]"], lambda c: J.from_json5(c, "array<double>"))[0]
    assert str(got) == "[nan, -inf, inf]"


def test_pointers(spark):
    doc = '{"a":{"x/y":1,"q\'\\"":[1,null,"s"],"01":5,"":7,"null":"null"},"l":[10,[20]],"t":true}'
    want = {"/a/x~1y": "1", "/a/q'\"/1": "null", "/a/q'\"/2": "s", "/a/01": "5", "/l/01": None, "/l/0": "10", "/l/1": "[20]", "/l/1/0": "20", "/l/-": None, "/": None, "/a/": "7", "x": None, "/l/9": None, "/l/99999999999": None, "/t": "true", "/t/x": None, "/a/null": "null", "/b": None}
    assert run(spark, list(want), lambda c: J.json_at(F.lit(doc), c)) == list(want.values())
    assert run(spark, ["{", None, "[1]"], lambda c: J.json_at(c, F.lit("/0"))) == [None, None, "1"]


def test_long_texts(spark):
    text = '{"k":"' + "\\n\\\\" * 100_000 + '","n":[' + ",".join(["1.50"] * 20_000) + "]}"
    assert run(spark, [text], J.canonical_json)[0] == text.replace("1.50", "1.5")
    assert json.loads(run(spark, [text], J.json_of_json5)[0]) == json.loads(text)
