"""Edge values of the operators on small tables made here."""

import base64
import hashlib
import hmac
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import scalars as X
from strataloom.operators import benchmarks as B
from strataloom.operators import gates as G
from strataloom.operators import graph as GR
from strataloom.operators import ledger as L
from strataloom.operators import matching as M
from strataloom.operators import registry as R
from strataloom.operators import similarity as S
from strataloom.operators import telemetry as T
from strataloom.operators import vectors as V
from strataloom.sources import csvs, jsonl, wire
from strataloom.streaming import ops as ST


def values(spark, rows, schema, **cols):
    got = spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()
    return [tuple(r) for r in got]


def test_scores_and_bands(spark):
    d = F.col("d")
    got = values(spark, [(0.0,), (2.0,), (3.0,), (math.sqrt(0.6),)], "d double", s=V.score_of(d))
    assert [round(g[0], 9) for g in got] == [1, 0, 0, 0.85]
    bands = values(spark, [(0.85,), (0.7,), (0.5,), (0.4999,)], "s double", b=V.band_of(F.col("s")))
    assert [b[0] for b in bands] == ["strong", "confident", "weak", "poor"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0], [1.0, 2.0])]
    got = values(spark, rows, "a array<double>, b array<double>", c=V.cosine(F.col("a"), F.col("b")))
    assert got[0][0] == 0 and abs(got[1][0] - 1) < 1e-12 and got[2][0] is None


def test_discovery_rules(spark):
    unit = lambda a: [math.cos(a), math.sin(a)]
    vectors = spark.createDataFrame([(1, unit(0.0)), (2, unit(0.1)), (3, unit(1.2)), (4, unit(3.0))], "spec_id long, embedding array<double>")
    blocks = spark.createDataFrame([(1, "a", ["x"], 0, 3, 2), (2, "b", ["x"], 1, 3, 2), (3, "c", ["y"], 0, 0, 0)], "spec_id long, root string, outputs array<string>, n_errors int, purity int, thread int")
    cards = spark.createDataFrame([(10, unit(0.0), ["x"], None, None), (11, unit(0.0), None, None, None), (12, unit(0.0), ["z"], None, None), (13, unit(0.0), None, 3, 2)], "card_id long, embedding array<double>, outputs array<string>, purity int, thread int")
    got = {}
    for r in V.discover(cards, vectors, blocks, 10, 0.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.root, r.failed_at, r.auto_accepted))
    assert sorted(got[10]) == [(1, "a", None, True)]
    assert [x[1] for x in sorted(got[11])] == ["a", "b", "c"] and not any(x[3] for x in got[11])
    assert {x[2] for x in got[12]} == {"structural"}
    assert [x[1] for x in sorted(got[13])] == ["a", "b"]


def test_writes(spark):
    new = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "x"), (None, 1, "n")], "k string, at int, v string")
    stored = spark.createDataFrame([("b",)], "k string")
    assert {tuple(r) for r in R.first_wins(new, ["k"], ["at"], stored).collect()} == {("a", 1, "early"), (None, 1, "n")}
    old = spark.createDataFrame([("a", 2, "old")], "k string, at int, v string")
    assert {tuple(r) for r in R.last_wins(old, new.where("k = 'a'"), ["k"], ["at"]).collect()} == {("a", 2, "late")}
    assert R.first_wins(new.limit(0), ["k"], ["at"]).count() == 0


def test_point_and_page(spark):
    blocks = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "root string")
    arts = spark.createDataFrame([("r1", 1, "b", b"2"), ("r1", 0, "a", b"1")], "root string, position int, path string, bytes binary")
    got = R.point(blocks, arts, "r1").first()
    assert [a.path for a in got.artifacts] == ["a", "b"]
    assert [(r.root, r.more) for r in R.page(blocks, "root", "", 2).collect()] == [("r1", True), ("r2", True)]
    assert [(r.root, r.more) for r in R.page(blocks, "root", "r2", 2).collect()] == [("r3", False)]


def test_intervals_touching_merge(spark):
    rows = spark.createDataFrame([("k", 0, 2), ("k", 2, 3), ("k", 5, 6), ("k", 0, 1)], "k string, a int, z int")
    assert sorted(tuple(r) for r in R.merged_intervals(rows, ["k"], "a", "z").collect()) == [("k", 0, 3, 3), ("k", 5, 6, 1)]
    assert [tuple(r) for r in R.gaps(rows, ["k"], "a", "z").collect()] == [("k", 3, 5)]


def test_match_reasons(spark):
    a = "wi array<string>, hi array<string>, wo array<string>, ho array<string>, we array<string>, he array<string>, wp int, hp int, wt int, ht int"
    rows = [(["a"], ["a"], [], [], ["E"], ["E"], 1, 1, 1, 1), (["a"], ["b"], [], ["x"], [], ["E"], 2, 1, None, 0), (["a"], [], [], [], [], [], None, None, None, None)]
    got = values(spark, rows, a, r=M.reasons(*[F.col(c) for c in ("wi", "hi", "wo", "ho", "we", "he", "wp", "hp", "wt", "ht")]))
    assert [g[0] for g in got] == [[], ["input_mismatch", "output_count", "undeclared_error", "purity"], ["input_count"]]
    assert values(spark, [("pure",), ("odd",), (None,)], "p string", r=M.rank_of(F.col("p"), M.PURITY)) == [(3,), (0,), (None,)]


def test_jaccard_empty_is_one(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    assert [round(v[0], 6) for v in values(spark, rows, "a array<string>, b array<string>", j=S.jaccard(F.col("a"), F.col("b")))] == [1, 0, 0.333333]


def test_supermajority(spark):
    rows = [(2, 3), (0, 0), (1, 2), (6, 9)]
    assert [v[0] for v in values(spark, rows, "v long, n long", s=L.supermajority(F.col("v"), F.col("n")))] == [True, False, False, True]


def test_reputation_closed_form(spark):
    events = [(1, 0, 5), (1, L.HALF_LIFE, 50), (1, 2 * L.HALF_LIFE, -10)]
    score, at = 100.0, 0
    for _, t, delta in events:
        score = score * 0.5 ** ((t - at) / L.HALF_LIFE) + delta
        at = t
    got = L.reputation(spark.createDataFrame(events, "a long, t long, d long"), "a", "t", "d", F.lit(2 * L.HALF_LIFE)).first()
    assert abs(got.score - score) < 1e-3


def test_bounty_states(spark):
    c = F.lit
    states = values(spark, [(0,), (9,), (10,), (14,), (15,)], "n long", s=L.bounty_state(F.col("n"), c(1), c(9), c(5)))
    assert [s[0] for s in states] == ["FUTURE", "COMMIT", "REVEAL", "REVEAL", "CHECK"]


def test_tasks_within_inclusive(spark):
    tasks = spark.createDataFrame([("s", 1, 10, 20), ("s", 2, 20, 30), ("s", 3, 5, None)], "session string, slug int, begin long, end long")
    events = spark.createDataFrame([("s", 10), ("s", 20), ("s", 31), ("z", 15)], "session string, t long")
    got = T.within(tasks, events, "session", 7).select("slug", "t").collect()
    assert sorted(map(tuple, got)) == [(1, 10), (1, 20), (2, 20)]


def test_reach_has_no_bound(spark):
    pairs = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30), (31, 32), (20, 5)]
    e = spark.createDataFrame(pairs, "a long, b long")
    want = {}
    for s in {a for a, _ in pairs}:
        front, hops = {s}, 0
        while front:
            hops += 1
            front = {b for a, b in pairs if a in front} - {b for a, b in want if a == s}
            want |= {(s, b): hops for b in front}
    assert {(r.a, r.b): r.hops for r in GR.closure(e).collect()} == want
    chain = spark.createDataFrame(pairs[:19], "a long, b long")
    ends = spark.createDataFrame([(1,), (20,), (40,)], "node long")
    assert {r.node for r in GR.maximal(ends, chain, "node").collect()} == {1, 40}
    some = spark.createDataFrame([(1,), (7,), (19,), (30,), (32,)], "node long")
    assert {r.node for r in GR.maximal(some, e, "node").collect()} == {1, 30}


def test_graph_small(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3)], "a long, b long")
    assert {tuple(r) for r in GR.closure(e).collect()} == {(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 3, 1)}
    assert {tuple(r) for r in GR.levels(e).collect()} == {(1, 0), (4, 0), (2, 1), (3, 2)}
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")
    assert {tuple(r) for r in GR.levels(cycle.unionByName(e.withColumn('a', F.col('a') + 10).withColumn('b', F.col('b') + 10))).collect()} == {(1, None), (2, None), (11, 0), (14, 0), (12, 1), (13, 2)}
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert GR.maximal(nodes, cycle, "node").count() == 2
    assert {r.node for r in GR.maximal(spark.createDataFrame([(1,), (2,), (3,)], "node long"), e, "node").collect()} == {1}
    w = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0)], "a long, b long, w double")
    assert {tuple(r) for r in GR.shortest(w, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 1, 0.0, 0), (1, 3, 1.0, 1), (1, 2, 2.0, 2)}
    with pytest.raises(ValueError, match="negative"):
        GR.shortest(w.withColumn("w", -F.col("w")), nodes)


def test_intent_gate(spark):
    texts = ["parse", "", "parse the integer", "parse some integer from text", "convert various things into other stuff", "isEmail RFC 5321 subset", "the quick brown fox", "encode bytes into base64 text: string", "a " * 21]
    rows = G.intent_gate(spark.createDataFrame([(t,) for t in texts], "x string"), "x").collect()
    assert [r.reasons for r in rows] == [["single_word"], ["too_short"], ["too_short"], ["meta_word_present"], ["stop_word_present", "meta_word_present"], [], ["no_action_verb"], [], ["too_long"]]
    assert rows[5].score == 0.55 and rows[7].score == pytest.approx(0.75)


def test_routes(spark):
    rules = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", ":x"]), (3, ["a", "*"]), (4, [":p", ":q"]), (5, ["z", ":k", "w"])], "rule_id int, parts array<string>")
    paths = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["a", "c", "d"]), (4, ["q", "r"]), (5, ["z", "1", "w"]), (6, ["z", "1", "v"])], "path_id int, segments array<string>")
    got = {r.path_id: (r.rule_id, r.captures) for r in G.routed(paths, rules).collect()}
    assert got == {1: (1, []), 2: (2, ["c"]), 3: (3, []), 4: (4, ["q", "r"]), 5: (5, ["1"])}


def test_samples_are_nested(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    got = [{r.k for r in B.sampled(rows, "k", f).collect()} for f in (0.0, 0.01, 0.3, 0.95, 1.0)]
    assert [len(g) for g in got] == [0, 10, 300, 950, 1000]
    assert all(a <= b for a, b in zip(got, got[1:], strict=False))


def test_known_vectors(spark):
    s = F.col("s")
    rows = [("",), ("f",), ("fo",), ("foo",), ("foob",), ("fooba",), ("foobar",)]
    assert [v[0] for v in values(spark, rows, "s string", b=X.base32(s))] == ["", "MY======", "MZXQ====", "MZXW6===", "MZXW6YQ=", "MZXW6YTB", "MZXW6YTBOI======"]
    assert values(spark, [("123456789",), ("",)], "s string", c=X.crc32c(s)) == [(0xE3069283,), (0,)]
    assert values(spark, [("msg",)], "s string", h=X.hmac_sha256(b"key", s))[0][0] == hmac.new(b"key", b"msg", "sha256").hexdigest()
    v = "dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"
    assert values(spark, [(v,)], "s string", p=X.pkce_challenge(s))[0][0] == base64.urlsafe_b64encode(hashlib.sha256(v.encode()).digest()).rstrip(b"=").decode()


def test_scalars_that_would_throw(spark):
    s = F.col("s")
    assert [v[0] for v in values(spark, [("-0",), ("12",), ("1.5",), ("",), ("9" * 30,)], "s string", i=X.signed_integer(s))] == [0, 12, None, None, None]
    assert [v[0] for v in values(spark, [("[1, -2]",), ("[]",), ("[1,]",), ("1",)], "s string", i=X.int_list(s))] == [[1, -2], [], None, None]
    assert [v[0] for v in values(spark, [("1.2.3",), ("1.2",), ("01.2.3",)], "s string", i=X.semver(s))] == [[1, 2, 3], None, None]
    assert [v[0] for v in values(spark, [("2024-02-29T23:59:60Z",), ("2024-13-01T00:00:00Z",), ("1970-01-01T00:00:01.5Z",), ("1970-01-01",)], "s string", t=X.rfc3339(s))] == [None, None, 1500, None]
    assert [v[0] for v in values(spark, [("a@b.co",), ("a..b@c.d",), ("a@b",), (f"{'x' * 65}@b.co",)], "s string", e=X.email_valid(s))] == [True, False, False, False]
    assert [v[0] for v in values(spark, [("1 + 2 * -3",), ("7 % 4 - (2)",), ("1 / 0",), ("2 +",), ("a + 1",)], "s string", e=X.arithmetic_column(s))] == [-5.0, 1.0, None, None, None]
    assert X.pointer_path("/a~1b/0/01") == "$['a/b'][0]['01']" and X.pointer_path("x") is None


def test_hash_embedding_is_unit(spark):
    got = values(spark, [("a",), ("a",), ("b",)], "s string", e=X.hash_embedding(F.col("s"), 40))
    assert got[0] == got[1] != got[2] and abs(sum(x * x for x in got[2][0]) - 1) < 1e-9 and len(got[0][0]) == 40


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"t": 1, "outcome": "registry-hit", "toolName": "Edit"}\n\nnot json\n{"t": 2, "toolName": "Edit"}\n')
    (tmp_path / "s2.jsonl").write_text('{"t": 3, "outcome": "passthrough", "toolName": "Write", "candidateAtomHashes": ["a"]}\n')
    rows = jsonl.read_sessions(spark, str(tmp_path / "*.jsonl")).collect()
    assert sorted((r.session, r.t, r.bad) for r in rows if r.t) == [("s1", 1, False), ("s1", 2, True), ("s2", 3, False)]
    assert sum(r.bad for r in rows) == 2
    (tmp_path / "x.csv").write_bytes(b'a,"b ""q"", c",\r\n"line\nbreak",,z\r\n')
    assert [tuple(r) for r in csvs.read_csv(spark, str(tmp_path / "x.csv"), "a string, b string, c string").collect()] == [("a", 'b "q", c', ""), ("line\nbreak", "", "z")]


def test_wire_round_trip(spark):
    rows = spark.createDataFrame([(1, "a", b"\x00\xff"), (2, None, None)], "i long, s string, b binary")
    back = wire.from_wire(wire.to_wire(rows, ["b"]), "i long, s string, b binary", ["b"])
    assert [tuple(r) for r in back.collect()] == [(1, "a", bytearray(b"\x00\xff")), (2, None, None)]
    assert wire.from_wire(spark.createDataFrame([("{",)], "wire string"), "i long").first().i is None


def test_token_bucket_loop(spark, sf):
    from strataloom.plans import streams

    got = {r.seq: r.allowed for r in streams.token_bucket(spark, sf).collect()}
    events = sorted((r.session, r.t, r.seq) for r in streams.events(spark, sf).select("session", "t", "seq").collect())
    held = {}
    for session, t, seq in events:
        level, at = held.get(session, (3.0, None))
        level = min(3.0, level + (0 if at is None else (t - at) / 3_600_000))
        assert got[seq] == (level >= 1)
        held[session] = (level - 1 if level >= 1 else level, t)


def test_sinks(spark, tmp_path):
    assert ST.sink_for("none:")(spark.range(3), 0) is None
    ST.sink_for(f"file:{tmp_path}/j")(spark.range(3), 0)
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    with pytest.raises(ValueError, match="no sink"):
        ST.sink_for("ftp:x")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(0, 8)), max_size=25))
def test_merged_intervals_cover(spark, rows):
    df = spark.createDataFrame([(k, a, a + n) for k, a, n in rows], "k int, a int, z int")
    got = R.merged_intervals(df, ["k"], "a", "z").collect()
    points = lambda xs: {(k, 2 * a + i) for k, a, z in xs for i in range(2 * (z - a) + 1)}
    assert points([(r.k, r.a, r.z) for r in got]) == points([(k, a, a + n) for k, a, n in rows])


def test_queries_against_rows_in_blocks(spark):
    from strataloom.operators.blocks import against, best

    q = spark.range(23).withColumnRenamed("id", "a")
    r = spark.range(41).withColumnRenamed("id", "b")
    want = sorted((a, b) for a in range(23) for b in range(41))
    for per_queries, per_rows in ((1000, 50_000), (5, 7)):
        assert sorted(tuple(x) for x in against(q, r, per_queries, per_rows).select("a", "b").collect()) == want
    got = best(against(q, r), ["a"], [F.desc(F.col("b") % 10), F.col("b")], 3, F.col("b")).collect()
    assert {(x.a, x.rank, x.b) for x in got} == {(a, k + 1, b) for a in range(23) for k, b in enumerate((9, 19, 29))}


def test_order_of_a_composition(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3), (5, 6)], "a long, b long")
    got = {r.node: r.position for r in GR.composed(edges).collect()}
    assert sorted(got.values()) == [1, 2, 3, 4, 5, 6]
    assert all(got[b] < got[a] for a, b in [(1, 2), (2, 3), (1, 3), (4, 3), (5, 6)])
    assert GR.composed(edges.where("false")).count() == 0


def test_long_chains_have_no_bound(spark):
    chain = spark.range(230).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert GR.closure(chain).count() == 230 * 231 // 2


def test_streams_order_whole_groups():
    import pandas as pd

    from strataloom.streaming import ops

    class Held:
        exists, get, kept = False, None, None

        def update(self, value):
            self.kept = value

    class Rows:
        def groupBy(self, _):
            return self

        def applyInPandasWithState(self, step, *rest):
            self.step = step
            return self

    parts = [pd.DataFrame({"t": [30, 40], "seq": [3, 4]}), pd.DataFrame({"t": [10, 20], "seq": [1, 2]})]
    step = ops.token_bucket(Rows(), 1.0, 0.05).step
    out = pd.concat(step((7,), iter(parts), Held()))
    assert out.seq.tolist() == [1, 2, 3, 4] and out.allowed.tolist() == [True, False, True, False]
    parts = [pd.DataFrame({"seq": [3], "candidate_count": [9], "outcome": ["x"]}), pd.DataFrame({"seq": [1, 2], "candidate_count": [1, 2], "outcome": ["passthrough", "x"]})]
    out = pd.concat(ops.drift_stream(Rows(), 2).step((7,), iter(parts), Held()))
    assert out.mean_candidates.tolist() == [1.0, 1.5, 5.5] and out.bypass_rate.tolist() == [1.0, 0.5, 0.0]


def test_expressions_that_are_deep_or_of_another_language(spark):
    from strataloom.functions import scalars

    texts = ["-" * 3000 + "1", "(" * 400 + "1" + ")" * 400, "1_000", "0x10", "1 + 2 * 3", "2 ** 3", ".5 + 1e1", "7 % 4", "", None, "1 +"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", scalars.arithmetic_column(F.col("t")).alias("v")).collect()}
    assert got[2] is None and got[3] is None and got[4] == 7 and got[5] is None and got[6] == 10.5 and got[7] == 3
    assert got[8] is None and got[9] is None and got[10] is None


def test_store_opens_with_its_model_only(spark, tmp_path):
    from strataloom.operators import registry

    v = spark.createDataFrame([(1, [1.0, 2.0], "m")], "vec_id long, embedding array<double>, model string")
    registry.snapshot({"vectors": v}, str(tmp_path / "s"))
    assert registry.open_store(spark, str(tmp_path / "s"), "m", 2)["vectors"].count() == 1
    for model, dims in (("other", 2), ("m", 3)):
        with pytest.raises(ValueError, match="cross_provider_rejected"):
            registry.open_store(spark, str(tmp_path / "s"), model, dims)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        registry.snapshot({"vectors": v}, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="newer"):
        registry.mirrored(v, v, F.lit(True), "vec_id", versions=(2, 1))


def test_provider_is_tried_again(spark):
    from strataloom.operators import registry

    class Provider:
        failed = 0

        def batch(self, texts):
            if Provider.failed < 2:
                Provider.failed += 1
                raise OSError("away")
            assert len(texts) <= 64
            return [[len(t), 1.0] for t in texts]

    rows = spark.range(150).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"), "id").coalesce(1)
    got = {r.id: r.embedding for r in registry.embedded(rows, "text", Provider()).collect()}
    assert got == {i: [float(i), 1.0] for i in range(150)}


def test_uncovered_parts(spark):
    from strataloom.operators import registry

    src = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz"), (3, None), (4, "full")], "f int, t string")
    cuts = spark.createDataFrame([(1, 2, 4), (1, 3, 5), (1, 5, 6), (1, 8, 99), (4, 0, 4), (2, 1, 1)], "f int, a int, z int")
    got = {r.f: [g.text for g in r.glue] for r in registry.uncovered(src, cuts, "f", "t", "a", "z").collect()}
    assert got == {1: ["ab", "gh"], 2: ["xyz"], 3: [], 4: []}


def test_schemas_that_are_refused():
    from strataloom.operators import validation

    for schema in ({"unknownKeyword": False}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}):
        with pytest.raises(ValueError):
            validation._valid(F.lit(None), schema, schema, ())


def test_walk_stops_at_its_limit(spark):
    from strataloom.operators import trees

    edges = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(1, 10)], "a long, b long")
    known = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 10)], "node long")
    got = {r.node: (r.depth, r.kind) for r in trees.walked(edges, known.where("node = 0"), known, most=3).collect()}
    assert got == {0: (0, "module"), 1: (1, "module"), 2: (1, "module"), 3: (1, "limit"), 4: (1, "limit"), 5: (1, "unresolved"), 10: (2, "limit")}


def test_a_key_of_many_paths_gathers_in_no_task(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT", 20)
    rules = spark.createDataFrame([("any", ["*"]), ("id", ["b", ":x"]), ("one", ["b", "1"]), ("also", ["b", "1"])], "rule_id string, parts array<string>")
    paths = spark.range(200).selectExpr("id AS path_id", "CASE WHEN id % 4 = 0 THEN array('z') ELSE array('b', cast(id % 50 AS string)) END AS segments")
    found = G.routed(paths, rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 1 and "Union" in plan
    got = {r.path_id: (r.rule_id, r.captures) for r in found.collect()}
    want = {i: ("any", []) if i % 4 == 0 else ("also", []) if i % 50 == 1 else ("id", [str(i % 50)]) for i in range(200)}
    assert got == want
