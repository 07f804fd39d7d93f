"""Benchmark aggregates over lineitem (runs), conversations (turns), events and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import benchmarks as B
from ..operators import registry as R
from ..operators.moments import moments
from ..operators.ranks import percentiles
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", "text", F.length("text").alias("raw"), (1 + F.length("text") % 5).alias("score"), F.when(F.col("turn") % 3 == 0, 45).otherwise(F.length("text")).alias("spent"))


_TURNS = "t AS (SELECT conv_id, turn, role, text, length(text) AS raw, 1 + length(text) % 5 AS score, CASE WHEN turn % 3 = 0 THEN 45 ELSE length(text) END AS spent FROM conversations)"
_SAVE = "count(*) AS n, round(avg((raw - spent) / nullif(raw, 0)), 6) AS mean_of_ratios, round(sum(raw - spent) / nullif(sum(raw), 0), 6) AS ratio_of_sums"


@query(f"WITH {_TURNS} SELECT conv_id, {_SAVE} FROM t GROUP BY conv_id")
def token_savings(spark, sf_dir):
    return B.savings(turns(spark, sf_dir), ["conv_id"], "raw", "spent")


@query(f"WITH {_TURNS}, r AS (SELECT coalesce(role, 'all') AS tier, {_SAVE} FROM t GROUP BY GROUPING SETS ((), (role))) SELECT *, CASE WHEN ratio_of_sums >= 0.8 THEN 'PASS' WHEN ratio_of_sums < 0.5 THEN 'KILL' ELSE 'WARN' END AS verdict FROM r")
def savings_by_tier(spark, sf_dir):
    t = turns(spark, sf_dir)
    rows = B.savings(t, ["role"], "raw", "spent").withColumnRenamed("role", "tier").unionByName(B.savings(t, [], "raw", "spent").withColumn("tier", F.lit("all")))
    return rows.withColumn("verdict", B.verdict(F.col("ratio_of_sums"), 0.8, 0.5))


@query(f"WITH {_TURNS}, f(f) AS (SELECT range / 10.0 FROM range(11)), x AS (SELECT f::DOUBLE AS f, raw, CASE WHEN turn % 10 < f * 10 THEN spent ELSE raw END AS paid FROM t, f), g AS (SELECT f, sum(raw - paid) / sum(raw) AS s FROM x GROUP BY f) SELECT f AS share, round(s, 6) AS saved, coalesce(s >= lag(s) OVER (ORDER BY f) - 1e-9, true) AS monotone FROM g")
def savings_curve(spark, sf_dir):
    """Savings where a growing share of the turns is covered, and whether the curve never falls."""
    spine = F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10)).alias("share")
    rows = turns(spark, sf_dir).select("turn", "raw", "spent", spine)
    paid = F.when(F.col("turn") % 10 < F.col("share") * 10, F.col("spent")).otherwise(F.col("raw"))
    g = rows.groupBy("share").agg((F.sum(F.col("raw") - paid) / F.sum("raw")).alias("s"))
    up = F.coalesce(F.col("s") >= F.lag("s").over(Window.orderBy("share")) - 1e-9, F.lit(True))  # eleven rows
    return g.select("share", F.round("s", 6).alias("saved"), up.alias("monotone"))


_CELLS = "c AS (SELECT l_linestatus AS arm, l_returnflag AS cls, year(l_shipdate) AS task, l_quantity AS cycles, l_extendedprice AS cost, l_discount FROM lineitem)"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("arm"), F.col("l_returnflag").alias("cls"), F.year("l_shipdate").cast("long").alias("task"), F.col("l_quantity").alias("cycles"), F.col("l_extendedprice").alias("cost"), "l_discount")


@query(f"WITH {_CELLS} SELECT coalesce(arm, 'all') AS arm, coalesce(task, 0) AS task, count(*) AS n, round(avg((cls = 'A')::INT), 6) AS engaged, round(avg(cycles), 5) AS mean_cycles, max(cycles) AS most FROM c GROUP BY GROUPING SETS ((), (arm), (arm, task))")
def engagement(spark, sf_dir):
    c = cells(spark, sf_dir)
    aggs = [F.count("*").alias("n"), F.round(F.avg((F.col("cls") == "A").cast("int")), 6).alias("engaged"), F.round(F.avg("cycles"), 5).alias("mean_cycles"), F.max("cycles").alias("most")]
    sets = c.groupingSets([[], [F.col("arm")], [F.col("arm"), F.col("task")]], F.col("arm"), F.col("task")).agg(*aggs)
    return sets.select(F.coalesce("arm", F.lit("all")).alias("arm"), F.coalesce("task", F.lit(0)).alias("task"), "n", "engaged", "mean_cycles", "most")


@query(f"WITH {_CELLS} SELECT task, round(avg(cycles) FILTER (arm = 'F' AND cls <> 'R'), 5) AS f_cycles, round(avg(cycles) FILTER (arm = 'O' AND cls <> 'R'), 5) AS o_cycles, round(sum(cost) FILTER (arm = 'F' AND cls <> 'R'), 2) AS f_cost, round(sum(cost) FILTER (arm = 'O' AND cls <> 'R'), 2) AS o_cost, avg(cycles) FILTER (arm = 'F' AND cls <> 'R') < avg(cycles) FILTER (arm = 'O' AND cls <> 'R') AS validated FROM c GROUP BY task")
def cell_pivot(spark, sf_dir):
    """Arms side by side per task, failed runs left out, and whether the hypothesis (fewer cycles) holds."""
    p = cells(spark, sf_dir).where("cls != 'R'").groupBy("task").pivot("arm", ["F", "O"]).agg(F.avg("cycles").alias("cycles"), F.sum("cost").alias("cost"))
    return p.select("task", F.round("F_cycles", 5).alias("f_cycles"), F.round("O_cycles", 5).alias("o_cycles"), F.round("F_cost", 2).alias("f_cost"), F.round("O_cost", 2).alias("o_cost"), (F.col("F_cycles") < F.col("O_cycles")).alias("validated"))


@query(f"WITH {_TURNS} SELECT role, count(*) AS n, round(avg(score), 3) AS mean, round(avg((score >= 4)::INT), 3) AS good, round(avg((score <= 1)::INT), 3) AS bad, count(*) FILTER (score = 1) AS ones, count(*) FILTER (score = 5) AS fives, avg(score) >= 4 AS passed FROM t GROUP BY role")
def coherence(spark, sf_dir):
    s = F.col("score")
    return turns(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(s), 3).alias("mean"), F.round(F.avg((s >= 4).cast("int")), 3).alias("good"), F.round(F.avg((s <= 1).cast("int")), 3).alias("bad"), F.count_if(s == 1).alias("ones"), F.count_if(s == 5).alias("fives"), (F.avg(s) >= 4).alias("passed"))


@query(f"WITH {_TURNS}, m AS (SELECT role, avg(spent) AS s FROM t GROUP BY role) SELECT role, round(s, 5) AS mean_spent, round(1 - s / (SELECT s FROM m WHERE role = 'user'), 6) AS reduction FROM m")
def mode_metrics(spark, sf_dir):
    m = turns(spark, sf_dir).groupBy("role").agg(F.avg("spent").alias("s"))
    base = F.max(F.when(F.col("role") == "user", F.col("s"))).over(Window.partitionBy())  # a row per mode
    return m.select("role", F.round("s", 5).alias("mean_spent"), F.round(1 - F.col("s") / base, 6).alias("reduction"))


@query(f"WITH {_CELLS}, a AS (SELECT task, median(cycles) FILTER (arm = 'F') AS a, median(cycles) FILTER (arm = 'O') AS b, min(cycles) AS lo, max(cycles) AS hi FROM c GROUP BY task) SELECT task, a AS median_a, b AS median_b, lo, hi, round((b - a) / b, 6) AS reduction, (b - a) / b >= 0.9 AS passed FROM a")
def arm_compare(spark, sf_dir):
    c = cells(spark, sf_dir)
    m = c.groupBy("task").agg(F.min("cycles").alias("lo"), F.max("cycles").alias("hi"))
    for arm, name in (("F", "median_a"), ("O", "median_b")):
        m = m.join(percentiles(c.where(F.col("arm") == arm), ["task"], "cycles", **{name: ("middle", 0)}), "task", "left")
    r = (F.col("median_b") - F.col("median_a")) / F.col("median_b")
    return m.select("task", "median_a", "median_b", "lo", "hi", F.round(r, 6).alias("reduction"), (r >= 0.9).alias("passed"))


@query("SELECT event_type AS kind, median(value * 100) AS p50, quantile_disc(value * 100, 0.95) AS p95, quantile_disc(value * 100, 0.99) AS p99, CASE WHEN median(value * 100) <= 3000 THEN 'PASS' WHEN median(value * 100) <= 10000 THEN 'WARN' WHEN median(value * 100) <= 15000 THEN 'SLOW' ELSE 'KILL' END AS verdict FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("value") * 100).alias("ms"))
    return B.latency(e, ["kind"], "ms")


@query("SELECT lang, count(*) AS blocks, count(DISTINCT doc_id) FILTER (text LIKE '%icense%') AS having, count(*) FILTER (length(text) < 200 AND l.doc_id IS NOT NULL) AS placeholder, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (length(text) >= 200 AND l.doc_id IS NOT NULL) AS real FROM documents LEFT JOIN (SELECT doc_id AS doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def artifact_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    d = d.withColumn("status", R.artifact_status(F.col("text"), F.col("has").isNotNull()))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return d.groupBy("lang").agg(F.count("*").alias("blocks"), F.count_distinct(F.when(F.col("text").like("%icense%"), F.col("doc_id"))).alias("having"), count("placeholder"), count("missing"), count("real"))


@query("""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN p_size % 5 END AS v, CASE WHEN p_size % 7 = 0 THEN 'TypeError' END AS e FROM part), b AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 + (p_partkey % 11 = 0)::INT END AS v, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'TypeError' ELSE 'RangeError' END END AS e FROM part WHERE p_partkey % 13 <> 0),
o AS (SELECT CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN CASE WHEN a.e = b.e THEN 'equivalent' ELSE 'different_error' END WHEN a.e IS NOT NULL THEN 'only_a_threw' WHEN b.e IS NOT NULL THEN 'only_b_threw' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'equivalent' ELSE 'different_value' END AS outcome FROM a FULL JOIN b ON a.id = b.id) SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def differential_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    a = p.select(F.col("p_partkey").alias("id"), F.when(size % 7 != 0, size % 5).alias("v"), F.when(size % 7 == 0, "TypeError").alias("e"))
    b = p.where("p_partkey % 13 != 0").select(F.col("p_partkey").alias("id"), F.when(size % 3 != 0, size % 5 + (F.col("p_partkey") % 11 == 0).cast("int")).alias("v"), F.when(size % 3 == 0, F.when(size % 2 == 0, "TypeError").otherwise("RangeError")).alias("e"))
    return B.differing(a, b, "id", "v", "e").groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT l_linestatus || l_returnflag AS model, count(*) AS runs, round(sum(l_quantity * CASE l_linestatus || l_returnflag WHEN 'FA' THEN 3.0 WHEN 'FN' THEN 15.0 WHEN 'OR' THEN 0.25 ELSE 1.0 END + l_extendedprice * CASE l_linestatus || l_returnflag WHEN 'FA' THEN 15.0 WHEN 'FN' THEN 75.0 WHEN 'OR' THEN 1.25 ELSE 5.0 END) / 1e6, 4) AS cost FROM lineitem GROUP BY 1")
def cost_lookup(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("model"), F.col("l_quantity").alias("input_tokens"), F.col("l_extendedprice").alias("output_tokens"))
    prices = spark.createDataFrame([("FA", 3.0, 15.0), ("FN", 15.0, 75.0), ("OR", 0.25, 1.25)], "model string, p_in double, p_out double")
    return B.costs(runs, prices, (1.0, 5.0)).groupBy("model").agg(F.count("*").alias("runs"), F.round(F.sum("cost"), 4).alias("cost"))


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, a.t AS b, z.t AS t FROM c a JOIN c z ON a.conv_id = z.conv_id AND z.turn = a.turn + 1),
k AS (SELECT conv_id, turn, t, CASE WHEN length(b) >= 50 THEN [substr(b, i::INT, 50) FOR i IN range(1, length(b) - 48, 25)] ELSE [] END AS chunks FROM p) SELECT conv_id, turn, coalesce(list_bool_or([contains(t, x) FOR x IN chunks]), false) AS repeated FROM k""")
def reemission(spark, sf_dir):
    """Whether the next turn repeats a chunk of 50 characters of this one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", B.re_emitted(F.col("text"), F.col("next")).alias("repeated"))


@query(f"WITH {_TURNS}, s AS (SELECT *, CASE WHEN length(text) < 40 THEN 'too_short' WHEN NOT contains(lower(text), 'an') THEN 'no_topic' WHEN regexp_matches(text, '[0-9a-f]{{8}}') THEN 'opaque_hash' END AS failure FROM t), l AS (SELECT conv_id, failure, CASE failure WHEN 'too_short' THEN 0 WHEN 'no_topic' THEN 1 WHEN 'opaque_hash' THEN 3 ELSE 5 END AS points FROM s) SELECT conv_id, min(points)::INT AS worst, count(failure) AS failures FROM l GROUP BY conv_id")
def turn_scoring(spark, sf_dir):
    """A ladder of points per turn by the first failure, the worst of a conversation."""
    text = F.col("text")
    failure = F.when(F.length(text) < 40, "too_short").when(~F.contains(F.lower(text), F.lit("an")), "no_topic").when(text.rlike("[0-9a-f]{8}"), "opaque_hash")
    points = F.when(F.col("f") == "too_short", 0).when(F.col("f") == "no_topic", 1).when(F.col("f") == "opaque_hash", 3).otherwise(5)
    return turns(spark, sf_dir).select("conv_id", failure.alias("f")).groupBy("conv_id").agg(F.min(points).alias("worst"), F.count("f").alias("failures"))


@query("WITH d AS (SELECT doc_id, md5('s' || doc_id) AS h, row_number() OVER (ORDER BY md5('s' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM d WHERE r <= ceil(0.2 * n)")
def monotone_sample(spark, sf_dir):
    return B.sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2)


@query("""WITH v AS (SELECT l_linestatus AS grp, CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_partkey % 50 = 0 THEN 'Infinity' ELSE l_extendedprice::VARCHAR END AS x FROM lineitem), n AS (SELECT grp, CASE WHEN x NOT IN ('n/a', 'Infinity') THEN x::DOUBLE END AS x FROM v),
s AS (SELECT grp, count(x) AS n, count(*) - count(x) AS errors, fsum(x) AS total, fsum(x) / count(x) AS m, min(x) AS lo, max(x) AS hi FROM n GROUP BY grp), q AS (SELECT n.grp, fsum((x - m) * (x - m)) AS m2 FROM n JOIN s USING (grp) GROUP BY n.grp)
SELECT grp, n, errors, round(total, 6) AS total, round(m, 9) AS mean, round(m2 / (n - 1) / 1e6, 9) AS variance, round(sqrt(m2 / (n - 1)), 8) AS deviation, lo, hi FROM s JOIN q USING (grp)""")
def running_stats(spark, sf_dir):
    """Compensated sum, mean, variance and range of texts, some of which are no numbers and count as errors."""
    x = F.when(F.col("l_linenumber") == 7, "n/a").when(F.col("l_partkey") % 50 == 0, "Infinity").otherwise(F.col("l_extendedprice").cast("string"))
    m = moments(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), x.alias("x")), "grp", "x")
    return m.select("grp", "n", "errors", F.round("total", 6).alias("total"), F.round("mean", 9).alias("mean"), F.round(F.col("variance") / 1e6, 9).alias("variance"), F.round("deviation", 8).alias("deviation"), "lo", "hi")


@query("SELECT CASE WHEN n_chars < 300 THEN 'foreign' WHEN lang = 'es' THEN 'unresolved' WHEN source = 'src0' THEN 'null_provenance' WHEN doc_id % 4 = 0 THEN 'glue_absorbed' ELSE 'other' END AS reason, source, count(*) AS blocks FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL")
def gap_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    reason = R.gap_reason(F.col("n_chars") < 300, F.col("lang") == "es", F.col("source") == "src0", F.col("doc_id") % 4 == 0)
    return d.groupBy(reason.alias("reason"), "source").agg(F.count("*").alias("blocks"))


@query("SELECT o_orderpriority AS state, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS atomised, round(avg((o_totalprice >= 250000)::INT), 6) AS strong, min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS first_failing FROM orders GROUP BY 1")
def round_trip_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("state")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("atomised"), F.round(F.avg((F.col("o_totalprice") >= 250000).cast("int")), 6).alias("strong"), F.min(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))).alias("first_failing"))


@query("SELECT p_brand AS suite, count(*) FILTER (p_size % 4 <> 0) AS non_equivalent, count(*) FILTER (p_size % 4 = 1) AS killed, round(count(*) FILTER (p_size % 4 = 1) / count(*) FILTER (p_size % 4 <> 0), 6) AS score FROM part GROUP BY 1")
def mutation_score(spark, sf_dir):
    m = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("suite")).agg(F.count_if(m != 0).alias("non_equivalent"), F.count_if(m == 1).alias("killed"))
    return rows.withColumn("score", F.round(F.try_divide("killed", "non_equivalent"), 6))
