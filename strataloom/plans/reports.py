"""Verdicts, curves, calibration and marker files, each beside the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import benchmarks as B
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import similarity as S
from ..operators import telemetry as T
from ..operators import vectors as V
from ..operators.cluster import cut
from ..sources import jsonl
from .benchmarks import _TURNS, turns
from .metrics import _EVAL, queries_of
from .registering import slice_of, table
from .telemetry import _TASKS, task_events

QUERIES, SQL, query = slice_of()

_RUNS = "r AS (SELECT l_suppkey AS task, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'E' ELSE 'F' END AS cell, l_returnflag <> 'R' AND NOT (l_linenumber % 3 = 1 AND l_suppkey % 2 = 0) AS passed, l_extendedprice * CASE WHEN l_linenumber % 3 = 2 AND l_suppkey % 3 <> 0 THEN 0.1 ELSE 1 END AS cost, l_quantity AS cycles, l_linestatus = 'O' AS failed FROM lineitem)"


def runs(spark, sf_dir):
    n, k = F.col("l_linenumber") % 3, F.col("l_suppkey")
    passed = (F.col("l_returnflag") != "R") & ~((n == 1) & (k % 2 == 0))
    cost = F.col("l_extendedprice") * F.when((n == 2) & (k % 3 != 0), 0.1).otherwise(1.0)
    return table(spark, sf_dir, "lineitem").select(k.alias("task"), F.when(n == 0, "A").when(n == 1, "E").otherwise("F").alias("cell"), passed.alias("passed"), cost.alias("cost"), F.col("l_quantity").alias("cycles"), (F.col("l_linestatus") == "O").alias("failed"), F.col("l_orderkey"), F.col("l_partkey"))


_HYP = f"""{_RUNS}, s AS (SELECT task, avg(passed::INT) FILTER (cell = 'A') AS ar, avg(cost) FILTER (cell = 'A') AS ac, avg(cycles) FILTER (cell = 'A') AS ay, max(passed::INT) FILTER (cell = 'E') AS ea, avg(cycles) FILTER (cell = 'E') AS ey, max(passed::INT) FILTER (cell = 'F') AS fa, avg(passed::INT) FILTER (cell = 'F') AS fr, avg(cost) FILTER (cell = 'F') AS fc FROM r WHERE NOT failed GROUP BY task),
h AS (SELECT task, coalesce(ea, 0) = 0 OR coalesce(ay > 0 AND ey >= 5 * ay, false) AS hc1, coalesce(fa, 0) > 0 AS hc2, coalesce(ac > 0 AND coalesce(fc, 0) / ac <= 0.2, false) AS hc3, abs(coalesce(fr, 0) - coalesce(ar, 0)) < 0.001 AS hc4 FROM s)"""


@query(f"WITH {_HYP} SELECT task, hc1, hc2, hc3, hc4, hc1 AND hc2 AND hc3 AND hc4 AS validated FROM h")
def hypothesis_cells(spark, sf_dir):
    return B.hypotheses(runs(spark, sf_dir))


@query(f"WITH {_HYP}, v AS (SELECT task % 5 AS suite, CASE WHEN task % 7 = 0 THEN 'PENDING' WHEN hc1 AND hc2 THEN 'PASS' WHEN hc3 THEN 'INCONCLUSIVE' ELSE 'WARN' END AS v FROM h), c AS (SELECT suite, count(*) AS tasks, count(*) FILTER (v = 'PASS') AS pass, count(*) FILTER (v = 'WARN') AS warn, count(*) FILTER (v = 'INCONCLUSIVE') AS inconclusive, count(*) FILTER (v = 'PENDING') AS pending FROM v GROUP BY suite) SELECT suite AS part, tasks, pass, warn, inconclusive, pending, CASE WHEN pending = tasks THEN 'PENDING' WHEN inconclusive = tasks THEN 'INCONCLUSIVE' WHEN pass > 0 AND warn = 0 THEN 'PASS' ELSE 'WARN' END AS suite FROM c")
def suite_verdicts(spark, sf_dir):
    rows = B.hypotheses(runs(spark, sf_dir))
    v = F.when(F.col("task") % 7 == 0, "PENDING").when(F.col("hc1") & F.col("hc2"), "PASS").when(F.col("hc3"), "INCONCLUSIVE").otherwise("WARN")
    return B.suite_verdict(rows.select((F.col("task") % 5).alias("part"), v.alias("verdict")), ["part"])


@query(f"WITH {_RUNS.replace('FROM lineitem', ', l_orderkey % 1000 AS ti, l_partkey % 300 AS tq, l_orderkey % 7 AS tc, l_partkey % 9 AS turns FROM lineitem')} SELECT cell, count(*) AS runs, round(avg(passed::INT), 6) AS pass_rate, round(avg(ti), 5) AS tokens_in, round(avg(tq), 5) AS tokens_out, round(avg(tc), 5) AS tokens_cached, round(avg(cost), 5) AS cost, round(avg(turns), 5) AS turns FROM r GROUP BY cell")
def cell_economics(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumns({"tokens_in": F.col("l_orderkey") % 1000, "tokens_out": F.col("l_partkey") % 300, "tokens_cached": F.col("l_orderkey") % 7, "turns": F.col("l_partkey") % 9})
    return B.economics(rows, ["cell"])


@query(f"WITH {_TURNS}, a AS (SELECT conv_id, avg(score) AS mean, avg((score >= 4)::INT) AS good, avg((score <= 1)::INT) AS bad FROM t GROUP BY conv_id), k AS (SELECT *, mean < 2.5 OR bad > 0.15 AS killed FROM a) SELECT conv_id, mean >= 4 AND good >= 0.9 AND bad <= 0.05 AND NOT killed AS passed, killed FROM k")
def coherence_bars(spark, sf_dir):
    s = F.col("score")
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.avg(s).alias("mean"), F.avg((s >= 4).cast("int")).alias("good"), F.avg((s <= 1).cast("int")).alias("bad"))
    return rows.select("conv_id", *B.coherence_verdict(F.col("mean"), F.col("good"), F.col("bad")))


@query(f"""WITH {_TURNS}, b AS (SELECT conv_id AS task, (turn % 10) / 10.0 AS place, raw, length(text) % 3 <> 0 AS exact, true AS loose, role = 'user' AS mine FROM t),
k AS (SELECT b.*, comparator, CASE WHEN comparator = 'exact' THEN exact ELSE loose END AS hit, CASE WHEN comparator = 'exact' THEN 45 ELSE 60 END AS cost FROM b, (VALUES ('exact'), ('loose')) c(comparator)),
g AS (SELECT k.*, population FROM k, (VALUES ('all'), ('user')) p(population) WHERE population = 'all' OR mine), f AS (SELECT g.*, i.i FROM g, (SELECT unnest(range(11)) AS i) i),
p AS (SELECT i, comparator, population, task, avg((hit AND place * 10 < i)::INT) AS h, sum(raw) AS r, sum(CASE WHEN hit AND place * 10 < i THEN cost ELSE raw END) AS s FROM f GROUP BY ALL)
SELECT i / 10 AS share, comparator, population, count(*) AS tasks, round(avg(h), 6) AS hit_rate, round(avg(coalesce((r - s) / nullif(r, 0), 0)), 6) AS mean_of_ratios, round(coalesce(sum(r - s) / nullif(sum(r), 0), 0), 6) AS ratio_of_sums FROM p GROUP BY ALL""")
def savings_curves(spark, sf_dir):
    """Eleven shares, two comparators, two populations."""
    rows = turns(spark, sf_dir).select(F.col("conv_id").alias("task"), ((F.col("turn") % 10) / 10).alias("place"), "raw", (F.length("text") % 3 != 0).alias("exact"), (F.col("role") == "user").alias("mine"))
    found = B.curve(rows, {"exact": (F.col("exact"), F.lit(45)), "loose": (F.lit(True), F.lit(60))}, {"all": F.lit(True), "user": F.col("mine")})
    return found.select("share", "comparator", "population", "tasks", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mean_of_ratios", "ratio_of_sums")])


@query(f"WITH {_EVAL}, b AS (SELECT least(floor(top_score * 10), 9)::INT AS bin, count(*) AS n, avg(top_score) AS s, avg(top_right::INT) AS p FROM p GROUP BY 1), i AS (SELECT unnest(range(10))::INT AS bin) SELECT i.bin, i.bin / 10 AS low, coalesce(n, 0) AS n, round(s, 6) AS mean_score, round(p, 6) AS p_right FROM i LEFT JOIN b ON b.bin = i.bin")
def reliability_bins(spark, sf_dir):
    return M.reliability_diagram(queries_of(spark, sf_dir))


@query(f"WITH {_EVAL}, x AS (SELECT query_id, n.id, rank, round(greatest(0, 1 - distance * distance / 4), 6) AS score, label = q_label OR n.id = query_id + 1 AS relevant FROM n WHERE rank <= 10 AND query_id % 300 <> 0), q2 AS (SELECT query_id, max(score) FILTER (rank = 1) AS top_score, bool_or(rank = 1 AND relevant) AS top_right, min(rank) FILTER (relevant) AS first_right FROM x GROUP BY query_id) SELECT count(*) AS queries, round(avg((top_score >= 0.5)::INT), 6) AS hit_rate, round(avg(top_right::INT), 6) AS p_at_1, round(avg((first_right IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1 / first_right, 0)), 6) AS mrr FROM q2")
def eligible_metrics(spark, sf_dir):
    """Every third query expects nothing and isn't eligible; the next id is acceptable beside those of the label."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    rows = V.knn(e, e.where("vec_id % 100 = 0"), 11).where("id != query_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where("rank <= 10")
    rows = rows.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id").withColumn("score", F.round(V.score_of(F.col("distance")), 6))
    near = rows.join(asked, "query_id").where("own = label").groupBy("query_id").agg(F.collect_set("id").alias("ids"))  # ten at most
    expected = asked.join(near, "query_id", "left").select("query_id", F.when(F.col("query_id") % 300 != 0, F.array_union(F.coalesce("ids", F.array().cast("array<long>")), F.array((F.col("query_id") + 1).cast("long")))).alias("ids"))
    return M.quality(M.per_query(M.judged(rows, expected)))


@query(f"""WITH {_TASKS}, c AS (SELECT CASE session % 3 WHEN 0 THEN 'boilerplate' WHEN 1 THEN 'write' ELSE 'multi' END AS category, count(DISTINCT slug) AS tasks, round(count(*) FILTER (outcome = 'registry-hit') / count(*), 6) AS rate FROM j GROUP BY 1)
SELECT CASE WHEN coalesce(sum(tasks), 0) < 30 THEN 'INSUFFICIENT_DATA' WHEN bool_and(rate >= 0.1) THEN 'PASS' WHEN NOT bool_or(rate >= 0.1) THEN 'FAIL' ELSE 'MIXED' END AS verdict, coalesce(sum(tasks), 0)::BIGINT AS tasks, coalesce(bool_or(category = 'boilerplate' AND rate < 0.3), false) AS killed FROM c""")
def sprint_kill(spark, sf_dir):
    m = F.col("session") % 3
    rows = task_events(spark, sf_dir).groupBy(F.when(m == 0, "boilerplate").when(m == 1, "write").otherwise("multi").alias("category"))
    rows = rows.agg(F.count_distinct("slug").alias("tasks"), F.round(F.avg((F.col("outcome") == "registry-hit").cast("double")), 6).alias("rate"))
    return T.sprint(rows.withColumn("pass", F.col("rate") >= 0.1))


@query("SELECT CASE event_id % 5 WHEN 0 THEN NULL ELSE 'task-' || CASE WHEN event_id % 2 = 0 THEN 'begin' ELSE 'end' END END AS kind, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS bad, min(CASE WHEN event_id % 5 <> 0 THEN user_id END) AS first_slug FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def marker_scan(spark, sf_dir):
    """Markers read from lines; every fifth is damaged, every seventh blank."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.concat(F.lit("task-"), F.when(k % 2 == 0, "begin").otherwise("end"))
    line = F.when(k % 7 == 0, "  ").when(k % 5 == 0, F.lit('{"kind": "task-')).otherwise(F.to_json(F.struct(kind.alias("kind"), F.col("user_id").cast("string").alias("taskSlug"), k.alias("t"))))
    rows = jsonl.markers(e.select(line.alias("value")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.min(F.col("taskSlug").cast("long")).alias("first_slug"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(string_split(p_name || ' ' || p_name || ' x', ' '), lambda w: list_contains(string_split(p_name || ' y', ' '), w)), ' ') AS shared FROM part")
def ordered_intersection(spark, sf_dir):
    """What three lists share, in the order of the first and with its repeats."""
    n = F.col("p_name")
    words = lambda *more: F.split(F.concat_ws(" ", *more), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(S.common_in_order(words(n, n, F.lit("x")), [words(n, F.lit("y")), words(F.lit("z"), n)]), " ").alias("shared"))


@query("SELECT p_brand AS brand, count(*) AS n, count(DISTINCT p_partkey) AS uuids, count(DISTINCT p_partkey) AS nanos, 0::BIGINT AS malformed, 64::BIGINT AS signs, 4::BIGINT AS variants FROM part GROUP BY 1")
def made_ids(spark, sf_dir):
    """Random ids hold their form, none comes twice, and over all rows every sign and variant that may stand in them does."""
    rows = cut(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.uuid().alias("u"), X.nano_id().alias("k")))
    well = X.uuid4_valid(F.col("u")) & F.col("k").rlike("^[0-9A-Za-z_-]{21}$")
    per = rows.groupBy("brand").agg(F.count("*").alias("n"), F.count_distinct("u").alias("uuids"), F.count_distinct("k").alias("nanos"), F.count_if(~well).alias("malformed"))
    signs = rows.select(F.explode(F.split("k", "")).alias("s")).where("s != ''").agg(F.count_distinct("s").alias("signs"))
    return per.withColumn("_k", F.lit(0)).join(signs.withColumn("_k", F.lit(0)), "_k").join(rows.agg(F.count_distinct(F.substring("u", 20, 1)).alias("variants")).withColumn("_k", F.lit(0)), "_k").drop("_k")


@query("""WITH r AS (SELECT o_orderkey AS o, o_orderkey % 4 AS n, o_custkey AS k FROM orders) SELECT o AS path_id, CASE WHEN n % 4 = 0 THEN 'any' WHEN n % 4 = 3 THEN 'brand:' || p_brand WHEN k % 2 = 0 THEN 'part:' || k ELSE 'brand:' || p_brand END AS rule, CASE WHEN n % 4 = 0 THEN '' WHEN n % 4 = 3 THEN 'none' WHEN k % 2 = 0 THEN '' ELSE k::VARCHAR END AS captures FROM r JOIN part ON p_partkey = k""")
def route_many(spark, sf_dir):
    """As many rules as half the parts and all brands, against a path for each order."""
    p = table(spark, sf_dir, "part")
    lit = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("rule_id"), F.array(F.lit("b"), F.col("p_brand"), F.col("p_partkey").cast("string")).alias("parts"))
    brand = p.select(F.concat(F.lit("brand:"), "p_brand").alias("rule_id"), F.array(F.lit("b"), F.col("p_brand"), F.lit(":id")).alias("parts")).distinct()
    rules = lit.unionByName(brand).unionByName(spark.createDataFrame([("any", ["*"])], "rule_id string, parts array<string>"))
    k, n = F.col("o_custkey"), F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").join(p.select(F.col("p_partkey").alias("o_custkey"), "p_brand").hint("merge"), "o_custkey")
    path = F.when(n == 0, F.array(F.lit("else"), F.lit("where"))).when(n == 3, F.array(F.lit("b"), F.col("p_brand"), F.lit("none"))).otherwise(F.array(F.lit("b"), F.col("p_brand"), k.cast("string")))
    paths = rows.select(F.col("o_orderkey").alias("path_id"), path.alias("segments"))
    return G.routed(paths, rules).select("path_id", F.col("rule_id").alias("rule"), F.array_join("captures", ",").alias("captures"))
