"""Source texts by their tokens: what covers a text, which rules it breaks, what its normal form is."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import sources as S


@pytest.fixture(scope="module")
def of(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, source string")
        found = S.tokens(df)
        return df, found, S.code(found)

    return run


def by_id(df, n, value):
    got = {r["id"]: r[value] for r in df.collect()}
    return [got.get(i) for i in range(n)]


def test_tokens_cover_every_text(of):
    rng = random.Random(3)
    bits = ["a", "let ", "`", "${", "}", '"', "'", "\\", "/", "*", "//", "/*", "*/", "\n", " ", "(", ")", "{", "[", "]", ".", "?.", "=>", "1e3", "0x1F", "é漢", "🙂", "$", ";", "return "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(200)] + ["", "`" + "a" * 50_000 + "`", '"' + "\\n" * 50_000 + '"', "x = /" + "a\\/" * 20_000 + "/g"]
    _, found, _ = of(texts)
    rows = found.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "token", "at"))), lambda x: x["token"]), "").alias("whole"))
    assert by_id(rows, len(texts), "whole") == [t or None for t in texts]
    assert found.join(found.withColumnsRenamed({"place": "p", "at": "z", "token": "t", "kind": "k"}), "id").where("p = place + 1 and z != at + char_length(token)").isEmpty()


@pytest.mark.parametrize("text,kinds", [
    ("a / b / c", "name mark name mark name"), ("x = /a[/]b/g.test(s)", "name mark regex mark name open name close"), ("(a) / 2 / 1", "open name close mark number mark number"), ("return /x/", "name regex"),
    ("`a ${b + `c`} d`", None), ("`a ${f(\"}\")} d`", "template name open string close template"), ("`a\\`b`", "template"), ("// 'x\n'y'", "comment string"), ("a?.b ?? c", "name mark name mark name"), ("1.5e-3 + .5", "number mark number"),
])
def test_kinds(of, text, kinds):
    _, found, _ = of([text])
    got = [r["kind"] for r in found.orderBy("place").collect() if r["kind"] != "space"]
    assert "".join(r["token"] for r in found.orderBy("place").collect()) == text
    assert kinds is None or " ".join(got) == kinds


RULES = [
    ("// eval(x)\n/* any */ const a = 'eval(1) as any';", None), ("const f = eval(x);", ["eval"]), ("a.eval(x)", ["top_level_effect"]), ("const f = new Function('x');", ["eval"]), ("foo()", ["top_level_effect"]), ("const x = 1\nfoo()", ["top_level_effect"]), ("const x = a\n  .b()\n  + c", None),
    ("let x = 1", ["mutable_global"]), ("export var x = 1", ["mutable_global"]), ("function f() { let x = 1; x = 2 }", None), ("function f() {}\nf()", ["top_level_effect"]), ("const a: any = 1; function f(x: Array<any>, y: Map<string, any>): any[] { return x as any }", ["any_type"]), ("const any = { any: 1 }; const b = any.any(any)", None), ("type A = any;", ["any_type"]),
    ("const p = Reflect.ownKeys(o), q = Object.keys(o)", ["reflection"]), ("const p = Object.defineProperty(o, 'x', y)", ["reflection"]), ("const p = a.__proto__", ["reflection"]), ("const p = a['__proto__']", ["reflection"]), ("const p = '__proto__', q = a.Reflect", None), ("function f() { with (a) { b() } }", ["with"]),
    ("function f() { throw 'x' }", ["throw_non_error"]), ("function f() { throw new Error('x' + 1) }", None), ("function f(e) { throw e }", None), ("function f(e) { throw e.a.b }", None), ("function f(e) { throw make(1, 'x') }", None), ("function f(e) { throw e || 1 }", ["throw_non_error"]), ("function f(e) { throw { a: 1 } }", ["throw_non_error"]), ("function f(e) { throw 4\n}", ["throw_non_error"]),
    ("function f(e) { throw e\n}\nfunction g() { return a + 'b' }", None), ("const m = require('m')", ["untyped_import"]), ("async function f() { return await import('m') }", ["untyped_import"]), ("import { a } from 'm'\nimport type { B } from './b'\nexport { a }\nexport * from 'x'", None), ("if (a) { b() }", None), ("x = 1", ["top_level_effect"]), ("'use strict'\nexport default class A { m() { b() } }", ["top_level_effect"]), ("", None), (None, None),
    ("let a: any = eval('x'); throw 1", ["any_type", "eval", "mutable_global", "throw_non_error"]),
]


def test_rules(of):
    _, _, rows = of([t for t, _ in RULES])
    got = by_id(S.broken_rules(rows), len(RULES), "rules")
    assert {RULES[i][0]: g for i, g in enumerate(got)} == dict(RULES)


def test_control_flow(of):
    texts = {"if (a) b(); else if (c) d()": 2, "for (;;) { while (x) {} }": 2, "do { a() } while (b)": 1, "const x = a ? b : c ? 1 : 2": 2, "function f(a?: number, b?) { return a?.b ?? 1 }": 0, "switch (a) { case 1: try { b() } catch (e) {} }": 2, "const o = { if: 1, for: 2 }; o.while(); // if (x)\n'for'": 0}
    _, _, rows = of(list(texts))
    assert by_id(S.control_flow(rows), len(texts), "boundaries") == list(texts.values())


CANONICAL = [
    ('let x = "// no"; return x', 'let __v0 = "// no" ; return __v0'),
    ("function h(a) { let b = a.a; { let b = 2; k(b) } return { b, a: b } }", "function h ( __v0 ) { let __v1 = __v0 . a ; { let __v2 = 2 ; k ( __v2 ) } return { b : __v1 , a : __v1 } }"),
    ("export function f(a, b) { const c = a; return c /* x */ + b }", "export function f ( a , b ) { const __v0 = a ; return __v0 + b }"),
    ("export const g = 1; const h = g", "export const g = 1 ; const __v0 = g"),
    ("const m = (x: number): number => x + 1, n = x => x; o.x(x)", "const __v0 = ( __v1 : number ) : number => __v1 + 1 , __v2 = __v3 => __v3 ; o . x ( x )"),
    ("for (const i of xs) { f(i) } f(i)", "for ( const __v0 of xs ) { f ( __v0 ) } f ( i )"),
    ("try { a() } catch (e) { b(e) } c(e)", "try { a ( ) } catch ( __v0 ) { b ( __v0 ) } c ( e )"),
    ("const { a, b: c, ...d } = x, [e] = y; f(a, b, c, d, e)", "const { a : __v0 , b : __v1 , ... __v2 } = x , [ e ] = y ; f ( __v0 , b , __v1 , __v2 , e )"),
    ("const t = `x ${t2} ${'}'}`; const t2 = t", "const __v0 = `x ${ __v1 } ${ '}' }` ; const __v1 = __v0"),
    ("const m: Map<string, number> = new Map(), k = m", "const __v0 : Map < string , number > = new Map ( ) , __v1 = __v0"),
]


def test_canonical(of):
    _, _, rows = of([t for t, _ in CANONICAL])
    assert by_id(S.canonical_sources(rows), len(CANONICAL), "canonical") == [w for _, w in CANONICAL]


def test_same_but_for_names(of):
    texts = ["function f(a) { const b = a.b; // one\n return b }", "function f(x) {\n  const yy = x.b;\n  return yy\n}", "function f(x) { const y = x.y; return y }", "function f(x) { const y = 'x.b'; return y }"]
    _, _, rows = of(texts)
    a, b, c, d = by_id(S.canonical_sources(rows), 4, "canonical")
    assert a == b and len({a, c, d}) == 3


SIGNED = [
    ("export function f(a: number, b?: Map<string, any>, { c }: T = { c: 1 }, ...r: X[]): Promise<void> { g() }", ("f", [("a", "number"), ("b", "Map<string, any>"), ("{ c }", "T"), ("...r", "X[]")], "Promise<void>", True)),
    ("function hidden(a) {}\n/** Doc. */\nexport const g = async (a, b: (x: number) => string = h): Promise<number> => { return 1 }", ("g", [("a", "unknown"), ("b", "(x: number) => string")], "Promise<number>", True)),
    ("export function e(): { a: number } { return x }", ("e", [], "{ a: number }", True)), ("export function none() {}", ("none", [], "unknown", False)), ("export default async function d(a = 1) { b() }", ("d", [("a", "unknown")], "unknown", True)),
    ("export const k = 5", None), ("// export function f() {}\n'export function g() {}'", None), ("", None),
]


def test_signatures(of):
    df, _, rows = of([t for t, _ in SIGNED])
    got = {r["id"]: (r["name"], [tuple(p) for p in r["params"]], r["result"], r["has_body"]) for r in S.signatures(df, rows).collect()}
    assert {t: got.get(i) for i, (t, _) in enumerate(SIGNED)} == dict(SIGNED)


def test_documentation(spark):
    doc = "/**\n * Adds two\n * numbers. Then more.\n *\n * @param a - the first\n *   of them\n * @param {number} b second\n * @returns the sum\n * @throws RangeError if large\n * @requires a > 0\n * @ensures x\n * @example foo\n */"
    r = spark.createDataFrame([(doc,), (None,), ("/** */",)], "d string").select(S.documentation(F.col("d")).alias("x")).collect()
    x = r[0]["x"]
    assert (x["summary"], [tuple(p) for p in x["params"]], x["returns"], x["requires"], x["ensures"], x["throws"]) == ("Adds two numbers.", [("a", "the first of them"), ("b", "second")], "the sum", ["a > 0"], ["x"], ["RangeError if large"])
    assert r[1]["x"] is None and r[2]["x"]["summary"] is None


def test_single_typed_function(of):
    good = "import { a } from 'a'\ntype T = string\n/** Doc. */\nexport function f(x: T): number { return 1 }"
    texts = [good, good + "\nf('x')", good.replace("x: T", "x"), good.replace("): number", ")"), good.replace("/** Doc. */", "// Doc."), good.replace("return 1", ""), good + "\nexport function g(): void { h() }", "/** D. */ export const f = (x: T): T => { return x }"]
    df, _, rows = of(texts)
    assert by_id(S.single_typed_function(rows, S.signatures(df, rows)), len(texts), "single") == [True, False, False, False, False, False, False, True]


@pytest.mark.parametrize("what", ["canonical", "rules", "atoms", "signatures"])
def test_tokens_are_neither_shuffled_nor_broadcast(spark, tmp_path, what):
    """A small file of sources looks as if its tokens were few; only texts may be shuffled, and nothing broadcast."""
    path = str(tmp_path / "s")
    spark.range(50).selectExpr("id", "concat('export function f(a: int) { const b', id, ' = a; return b', id, '; }') AS source").write.parquet(path)
    df = spark.read.parquet(path)
    rows = S.code(S.tokens(df))
    got = {"canonical": lambda: S.canonical_sources(rows), "rules": lambda: S.broken_rules(rows), "atoms": lambda: S.atoms(rows, S.signatures(df, rows)), "signatures": lambda: S.signatures(df, rows)}[what]()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning(id") == plan.count("Exchange") == {"canonical": 1, "rules": 1, "atoms": 3, "signatures": 2}[what]
