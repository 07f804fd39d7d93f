"""Telemetry over events: a user is a session, event types are outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import telemetry as T
from ..operators import validation as C
from ..operators.blocks import best
from ..operators.ranks import percentiles
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

EVENTS = """e AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS t, user_id AS session, CASE user_id % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Write' ELSE 'MultiEdit' END AS tool,
CASE event_type WHEN 'purchase' THEN 'registry-hit' WHEN 'view' THEN 'synthesis-required' WHEN 'click' THEN 'passthrough' WHEN 'signup' THEN 'descent-bypass-warning' ELSE 'drift-alert' END AS outcome,
CASE WHEN event_type <> 'click' THEN least(value / 100, 2) END AS top_score, (props->>'$.k')::BIGINT AS candidate_count, event_type = 'purchase' AS substituted, event_id % 40 AS atom FROM events)"""


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "registry-hit").when(kind == "view", "synthesis-required").when(kind == "click", "passthrough").when(kind == "signup", "descent-bypass-warning").otherwise("drift-alert")
    tool = F.when(F.col("user_id") % 3 == 0, "Edit").when(F.col("user_id") % 3 == 1, "Write").otherwise("MultiEdit")
    return e.select(
        F.col("event_id").alias("seq"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t"),
        F.col("user_id").alias("session"),
        tool.alias("tool"),
        outcome.alias("outcome"),
        F.when(kind != "click", F.least(F.col("value") / 100, F.lit(2.0))).alias("top_score"),
        F.get_json_object("props", "$.k").cast("long").alias("candidate_count"),
        (kind == "purchase").alias("substituted"),
        (F.col("event_id") % 40).alias("atom"),
    )


@query(f"""WITH {EVENTS}, k AS (SELECT *, outcome <> 'drift-alert' AND candidate_count <> -1 AS ok FROM e)
SELECT count(DISTINCT session) AS sessions, count(*) FILTER (ok) AS total, count(*) FILTER (ok AND outcome = 'registry-hit') AS registry_hit, count(*) FILTER (ok AND outcome = 'synthesis-required') AS synthesis_required,
count(*) FILTER (ok AND outcome = 'passthrough') AS passthrough, count(*) FILTER (ok AND outcome = 'descent-bypass-warning') AS other, count(*) FILTER (ok AND top_score < 0.1) AS under_01, count(*) FILTER (ok AND top_score >= 0.1 AND top_score < 0.2) AS under_02,
count(*) FILTER (ok AND top_score >= 0.2 AND top_score < 0.3) AS under_03, count(*) FILTER (ok AND top_score >= 0.3) AS from_03, round(median(top_score) FILTER (ok), 6) AS median_distance, min(t) FILTER (ok) AS first_t, max(t) FILTER (ok) AS last_t, count(DISTINCT t // 86400000) FILTER (ok) AS days FROM k""")
def telemetry_overview(spark, sf_dir):
    return T.overview(events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT outcome, count(*) AS n, round(avg(top_score), 5) AS mean_score FROM e GROUP BY outcome")
def outcome_breakdown(spark, sf_dir):
    return events(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("top_score"), 5).alias("mean_score"))


@query(f"WITH {EVENTS} SELECT tool, count(*) AS total, count(*) FILTER (outcome = 'registry-hit') AS hits, round(count(*) FILTER (outcome = 'registry-hit') / count(*), 6) AS rate FROM e WHERE outcome <> 'drift-alert' GROUP BY tool")
def per_tool_hit_rate(spark, sf_dir):
    rows = events(spark, sf_dir).where("outcome != 'drift-alert'").groupBy("tool").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "registry-hit").alias("hits"))
    return rows.withColumn("rate", F.round(F.col("hits") / F.col("total"), 6))


@query(f"WITH {EVENTS} SELECT CASE WHEN top_score < 0.1 THEN 0 WHEN top_score < 0.2 THEN 1 WHEN top_score < 0.3 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM e WHERE outcome <> 'drift-alert' AND top_score IS NOT NULL GROUP BY 1")
def distance_buckets(spark, sf_dir):
    d = F.col("top_score")
    rows = events(spark, sf_dir).where("outcome != 'drift-alert' and top_score is not null")
    return rows.groupBy(F.when(d < 0.1, 0).when(d < 0.2, 1).when(d < 0.3, 2).otherwise(3).alias("bucket")).agg(F.count("*").alias("n"))


_REUSE = f"{EVENTS}, h AS (SELECT atom, count(*) AS hits FROM e WHERE outcome = 'registry-hit' AND substituted AND candidate_count <> -1 GROUP BY atom)"


@query(f"WITH {_REUSE} SELECT atom, hits FROM h ORDER BY hits DESC, atom LIMIT 10")
def atom_reuse_top(spark, sf_dir):
    return T.reuse(events(spark, sf_dir)).orderBy(F.desc("hits"), "atom").limit(10)


@query(f"WITH {_REUSE} SELECT quantile_disc(hits, 0.5) AS p50, quantile_disc(hits, 0.9) AS p90, median(hits) AS middle, max(hits) AS most, list_sort(list(hits))[(floor(count(*) * 0.9) + 1)::BIGINT] AS p90_floor FROM h")
def hit_percentiles(spark, sf_dir):
    """Three conventions: nearest rank, mean of the middle two, and the floor of n * p."""
    h = T.reuse(events(spark, sf_dir))
    return percentiles(h, [], "hits", p50=("rank", 0.5), p90=("rank", 0.9), middle=("middle", 0), most=("rank", 1.0), p90_floor=("floor", 0.9))


@query(f"WITH {_REUSE}, j AS (SELECT h.atom, hits, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, CASE doc_id % 5 WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'L3' END AS level FROM h LEFT JOIN documents ON doc_id // 3 = atom) SELECT coalesce(level, 'unknown') AS level, count(*) AS atoms, sum(hits)::BIGINT AS hits, sum(hits * lines)::BIGINT AS lines_saved FROM j GROUP BY 1")
def grain_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("atom"), "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    rows = T.reuse(events(spark, sf_dir)).join(d, "atom", "left")
    level = F.when(F.col("doc_id") % 5 < 4, F.concat(F.lit("L"), F.col("doc_id") % 5))
    return rows.groupBy(F.coalesce(level, F.lit("unknown")).alias("level")).agg(F.count("*").alias("atoms"), F.sum("hits").alias("hits"), F.sum(F.col("hits") * F.col("lines")).alias("lines_saved"))


@query(f"WITH {EVENTS} SELECT session, count(DISTINCT t // 86400000) AS days, count(*) AS events, min(t) AS first_t, max(t) AS last_t FROM e GROUP BY session")
def days_active(spark, sf_dir):
    return events(spark, sf_dir).groupBy("session").agg(F.count_distinct(F.expr("t div 86400000")).alias("days"), F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


_DRIFT = f"""{EVENTS}, d AS (SELECT session, seq, round(avg(1 - top_score / 2) OVER w, 9) AS mean_specificity, round(avg(CASE WHEN outcome = 'passthrough' THEN 1.0 ELSE 0.0 END) OVER w, 9)::DOUBLE AS bypass_rate, median(candidate_count) OVER w AS median_candidates FROM e WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_DRIFT} SELECT session, seq, mean_specificity, bypass_rate, median_candidates::DOUBLE AS median_candidates FROM d")
def drift_window(spark, sf_dir):
    return T.drift(events(spark, sf_dir)).drop("alert")


@query(f"WITH {_DRIFT} SELECT session, alert, count(*) AS n FROM (SELECT session, CASE WHEN mean_specificity < 0.55 THEN 'specificity' WHEN bypass_rate > 0.4 THEN 'bypass' WHEN median_candidates > 5 THEN 'candidates' END AS alert FROM d) WHERE alert IS NOT NULL GROUP BY session, alert")
def drift_alerts(spark, sf_dir):
    return T.drift(events(spark, sf_dir)).where("alert is not null").groupBy("session", "alert").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, r AS (SELECT session, seq, tool, outcome, sum(CASE WHEN outcome = 'synthesis-required' THEN 1 ELSE 0 END) OVER (PARTITION BY session, atom ORDER BY seq ROWS UNBOUNDED PRECEDING) AS misses, atom FROM e) SELECT session, seq, misses::BIGINT AS misses, misses < 2 AND NOT regexp_matches(lower(tool || '-' || atom), '^(edit-1|write-2)') AS warn FROM r")
def descent_warn(spark, sf_dir):
    """A binding with fewer than two misses so far warns unless an allow pattern names it."""
    rows = T.running(events(spark, sf_dir), ["session", "atom"], "seq", F.col("outcome") == "synthesis-required", "misses")
    name = F.lower(F.concat_ws("-", "tool", F.col("atom").cast("string")))
    return rows.select("session", "seq", "misses", ((F.col("misses") < 2) & ~C.allowed(name, ["^EDIT-1", "^write-2", "*invalid"])).alias("warn"))


@query(f"WITH {EVENTS} SELECT seq, count(*) OVER w AS in_window, count(*) OVER w > 2 AS limited FROM e WINDOW w AS (PARTITION BY session ORDER BY t RANGE BETWEEN 7199999 PRECEDING AND CURRENT ROW)")
def rate_limit_sliding(spark, sf_dir):
    return T.rate_limited(events(spark, sf_dir), "session", "t", 7_200_000, 2).select("seq", "in_window", "limited")


_TASKS = f"""{EVENTS}, s AS (SELECT session, t AS begin_t, lead(t) OVER (PARTITION BY session ORDER BY t) AS end_t, seq AS slug FROM e WHERE outcome = 'descent-bypass-warning'),
j AS (SELECT s.slug, s.session, s.begin_t, s.end_t, e.seq, e.outcome, e.t FROM s JOIN e ON s.session = e.session AND e.t BETWEEN begin_t AND end_t)"""


def tasks(spark, sf_dir):
    rows = events(spark, sf_dir).where("outcome = 'descent-bypass-warning'")
    return rows.select("session", F.col("t").alias("begin"), F.lead("t").over(Window.partitionBy("session").orderBy("t")).alias("end"), F.col("seq").alias("slug"))


def task_events(spark, sf_dir):
    return T.within(tasks(spark, sf_dir), events(spark, sf_dir).select("session", "t", "seq", "outcome"), "session")


@query(f"WITH {_TASKS} SELECT slug, count(*) AS events, count(*) FILTER (outcome = 'registry-hit') AS hits FROM j GROUP BY slug")
def task_interval_join(spark, sf_dir):
    return task_events(spark, sf_dir).groupBy("slug").agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "registry-hit").alias("hits"))


@query(f"WITH {_TASKS} SELECT seq, t FROM e WHERE t NOT IN (SELECT t FROM j)")
def orphan_events(spark, sf_dir):
    covered = task_events(spark, sf_dir).select("t").distinct()
    return events(spark, sf_dir).select("seq", "t").join(covered, "t", "left_anti").select("seq", "t")


@query(f"WITH {EVENTS}, m AS (SELECT session AS slug, max(CASE WHEN outcome = 'synthesis-required' THEN t END) AS begin_t, max(CASE WHEN outcome = 'registry-hit' THEN t END) AS end_t FROM e GROUP BY session) SELECT slug, begin_t, end_t, end_t IS NULL AS open FROM m WHERE begin_t IS NOT NULL")
def marker_pairs(spark, sf_dir):
    kind = F.when(F.col("outcome") == "synthesis-required", "begin").when(F.col("outcome") == "registry-hit", "end")
    rows = T.paired(events(spark, sf_dir).select(F.col("session").alias("slug"), kind.alias("kind"), "t"))
    return rows.select("slug", F.col("begin").alias("begin_t"), F.col("end").alias("end_t"), F.col("end").isNull().alias("open"))


_VERDICT = f"""{_TASKS}, c AS (SELECT CASE session % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'write' ELSE 'multi' END AS category, count(DISTINCT slug) AS tasks, count(*) AS events, count(*) FILTER (outcome = 'registry-hit') AS hits FROM j GROUP BY 1),
v AS (SELECT *, round(hits / events, 6) AS rate, CASE category WHEN 'edit' THEN 0.6 WHEN 'write' THEN 0.3 ELSE 0.1 END AS bar FROM c)"""


def by_category(spark, sf_dir):
    m = F.col("session") % 3
    rows = task_events(spark, sf_dir).groupBy(F.when(m == 0, "edit").when(m == 1, "write").otherwise("multi").alias("category"))
    rows = rows.agg(F.count_distinct("slug").alias("tasks"), F.count("*").alias("events"), F.count_if(F.col("outcome") == "registry-hit").alias("hits"))
    bar = F.coalesce(*[F.when(F.col("category") == k, v) for k, v in T.BARS.items()])
    return rows.withColumn("rate", F.round(F.try_divide("hits", "events"), 6)).withColumn("pass", F.col("rate") >= bar)


@query(f"WITH {_VERDICT} SELECT category, tasks, events, hits, rate, rate >= bar AS pass FROM v")
def category_verdict(spark, sf_dir):
    return by_category(spark, sf_dir)


@query(f"WITH {_VERDICT} SELECT CASE WHEN sum(tasks) < 30 THEN 'INSUFFICIENT_DATA' WHEN bool_and(rate >= bar) THEN 'PASS' WHEN NOT bool_or(rate >= bar) THEN 'FAIL' ELSE 'MIXED' END AS verdict, sum(tasks)::BIGINT AS tasks FROM v")
def sprint_verdict(spark, sf_dir):
    rows = by_category(spark, sf_dir)
    verdict = F.when(F.sum("tasks") < 30, "INSUFFICIENT_DATA").when(F.bool_and("pass"), "PASS").when(~F.bool_or("pass"), "FAIL").otherwise("MIXED")
    return rows.agg(verdict.alias("verdict"), F.sum("tasks").alias("tasks"))


@query(f"WITH {EVENTS}, c AS (SELECT session, count(*) AS n, count(*) FILTER (top_score >= 0.7) AS strong FROM e GROUP BY session) SELECT session, n, strong, n > 10 OR strong > 3 AS too_many FROM c")
def result_set_gate(spark, sf_dir):
    return M.too_many(events(spark, sf_dir), "session", "top_score")


@query(f"WITH {EVENTS}, x AS (SELECT tool, seq, t, row_number() OVER (PARTITION BY tool ORDER BY t DESC, seq DESC) AS r FROM e) SELECT tool, seq, t FROM x WHERE r <= 5")
def telemetry_tail(spark, sf_dir):
    """The last five events of each file (tool), newest first."""
    return best(events(spark, sf_dir).select("tool", "seq", "t"), ["tool"], [F.desc("t"), F.desc("seq")], 5, F.col("seq")).drop("rank")
