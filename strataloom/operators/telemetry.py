"""Telemetry analytics: overview, reuse, drift windows, running gates, and task intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles

KNOWN = ("registry-hit", "synthesis-required", "passthrough")
DRIFT = {"mean_specificity": 0.55, "bypass_rate": 0.40, "median_candidates": 5.0}
BARS = {"edit": 0.6, "write": 0.3, "multi": 0.1}


def is_alert(outcome: Column, candidates: Column) -> Column:
    return F.coalesce((outcome == "drift-alert") | (candidates == -1), F.lit(False))


def overview(events: DataFrame) -> DataFrame:
    """One row: totals, outcome classes, distance buckets, median distance, span and days; alerts are left out, sessions aren't."""
    ok = ~is_alert(F.col("outcome"), F.col("candidate_count"))
    d = F.when(ok, F.col("top_score"))
    outcome = F.when(ok, F.when(F.col("outcome").isin(*KNOWN), F.col("outcome")).otherwise("other"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = events.agg(
        F.count_distinct("session").alias("sessions"),
        count(ok).alias("total"),
        *[count(outcome == o).alias(o.replace("-", "_")) for o in (*KNOWN, "other")],
        count(d < 0.1).alias("under_01"),
        count((d >= 0.1) & (d < 0.2)).alias("under_02"),
        count((d >= 0.2) & (d < 0.3)).alias("under_03"),
        count(d >= 0.3).alias("from_03"),
        F.min(F.when(ok, F.col("t"))).alias("first_t"),
        F.max(F.when(ok, F.col("t"))).alias("last_t"),
        F.count_distinct(F.when(ok, F.to_date(F.timestamp_millis("t")))).alias("days"),
    )
    middle = percentiles(events.select(d.alias("d")), [], "d", median_distance=("middle", 0)).select(F.round("median_distance", 6).alias("median_distance"), F.lit(0).alias("_k"))
    return out.withColumn("_k", F.lit(0)).join(middle, "_k", "left").drop("_k")  # one row each


def reuse(events: DataFrame) -> DataFrame:
    """atom, hits: registry hits that were substituted, alerts left out."""
    ok = (F.col("outcome") == "registry-hit") & F.col("substituted") & F.col("atom").isNotNull() & (F.col("candidate_count") != -1)
    return events.where(ok).groupBy("atom").agg(F.count("*").alias("hits"))


def drift(events: DataFrame, window: int = 20) -> DataFrame:
    """Rolling means over the last ``window`` events of a session, this one included, and the first limit that is passed."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(1 - window, 0)
    specificity = F.when(F.col("outcome") != "intent-too-broad", 1 - F.col("top_score") / 2)
    out = events.select(
        "session",
        "seq",
        F.round(F.avg(specificity).over(w), 9).alias("mean_specificity"),
        F.round(F.avg(F.when(F.col("outcome") == "passthrough", 1.0).otherwise(0.0)).over(w), 9).alias("bypass_rate"),
        F.expr(f"percentile(candidate_count, 0.5) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)").alias("median_candidates"),
    )
    first = F.when(F.col("mean_specificity") < DRIFT["mean_specificity"], "specificity").when(F.col("bypass_rate") > DRIFT["bypass_rate"], "bypass").when(F.col("median_candidates") > DRIFT["median_candidates"], "candidates")
    return out.withColumn("alert", first)


def running(events: DataFrame, by: list[str], order: str, flag: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.sum(F.when(flag, 1).otherwise(0)).over(w))


def rate_limited(events: DataFrame, by: str, at: str, interval: int, limit: int) -> DataFrame:
    """Events with more than ``limit`` of their key within the last ``interval`` units of ``at``, this one included."""
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-interval + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > limit)


def paired(markers: DataFrame) -> DataFrame:
    """slug, begin, end: the last marker of each kind wins; an end alone drops out, a begin alone has a null end."""
    per = markers.groupBy("slug").agg(F.max(F.when(F.col("kind") == "begin", F.col("t"))).alias("begin"), F.max(F.when(F.col("kind") == "end", F.col("t"))).alias("end"))
    return per.where("begin is not null")


#: From one width of buckets to the next.
LADDER = 16


def within(tasks: DataFrame, events: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Tasks joined with the events of their key in begin..end, both ends included; an event may lie in several tasks.

    Both sides carry time buckets, so it is an equality join on (key, width, bucket) and no key meets all its events at once. Widths are a ladder: ``width``
    (the shortest task, unless given) times powers of LADDER. A task has the first width that is no shorter than it is, so it lies in two buckets at most,
    however long; an event is there once for each width that a task has.
    """
    if width is None:
        width = max(1, int(tasks.where("end >= begin").agg(F.min(F.greatest(F.col("end") - F.col("begin"), F.lit(1)))).first()[0] or 1))
    step = lambda k: F.lit(width) * F.pow(F.lit(float(LADDER)), k)
    bucket = lambda c, k: F.floor(c / step(k)).cast("long")
    t = tasks.where("end is not null and end >= begin")
    t = t.withColumn("_w", F.greatest(F.lit(0), F.ceil(F.log(F.greatest((F.col("end") - F.col("begin")) / width, F.lit(1.0))) / F.log(F.lit(float(LADDER))))).cast("int"))
    used = sorted(r[0] for r in t.select("_w").distinct().collect())  # a row a width
    t = t.withColumn("_b", F.explode(F.sequence(bucket(F.col("begin"), F.col("_w")), bucket(F.col("end"), F.col("_w")))))
    e = events.withColumn("_w", F.explode(F.array(*map(F.lit, used)) if used else F.expr("cast(array() as array<int>)"))).withColumn("_b", bucket(F.col("t"), F.col("_w")))
    return t.join(e, [key, "_w", "_b"]).where("t >= begin and t <= end").drop("_w", "_b")


KILL_RATE = 0.3


def sprint(categories: DataFrame, least_tasks: int = 30, killer: str = "boilerplate", kill_rate: float = KILL_RATE) -> DataFrame:
    """verdict, tasks, killed of rows category, tasks, rate, pass: too few tasks, all passed, none, or mixed; killed when the category that decides is below
    its rate (a category without tasks or rate decides nothing)."""
    verdict = F.when(F.coalesce(F.sum("tasks"), F.lit(0)) < least_tasks, "INSUFFICIENT_DATA").when(F.bool_and("pass"), "PASS").when(~F.bool_or("pass"), "FAIL").otherwise("MIXED")
    killed = F.coalesce(F.bool_or((F.col("category") == killer) & (F.col("tasks") > 0) & (F.col("rate") < kill_rate)), F.lit(False))
    return categories.agg(verdict.alias("verdict"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("tasks"), killed.alias("killed"))


def queue_states(misses: DataFrame, completions: DataFrame, key: str) -> DataFrame:
    """key, queued_at, status of every missed key: its last completion's outcome if that came at or after the last miss, else pending.

    misses: key, t; completions: key, t, outcome.
    """
    asked = misses.groupBy(key).agg(F.max("t").alias("queued_at"))
    done = completions.groupBy(key).agg(F.max(F.struct("t", "outcome")).alias("_d"))
    late = F.coalesce(F.col("_d.t") >= F.col("queued_at"), F.lit(False))
    return asked.join(done, key, "left").select(key, "queued_at", F.when(late, F.col("_d.outcome")).otherwise("pending").alias("status"))
