"""Aggregates of benchmark runs: savings, curves, engagement, cells, coherence, latency, audits, differences, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles


def savings(rows: DataFrame, by: list[str], raw: str, spent: str) -> DataFrame:
    """Mean of ratios and ratio of sums, both; groups without tokens have null."""
    each = F.try_divide(F.col(raw) - F.col(spent), F.col(raw))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(each), 6).alias("mean_of_ratios"),
        F.round(F.try_divide(F.sum(F.col(raw) - F.col(spent)), F.sum(raw)), 6).alias("ratio_of_sums"),
    )


def verdict(share: Column, good: float, bad: float) -> Column:
    return F.when(share >= good, "PASS").when(share < bad, "KILL").otherwise("WARN")


def latency(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    """Median of the middle two, nearest-rank p95 and p99, and the verdict on the median."""
    out = percentiles(rows, by, ms, p50=("middle", 0), p95=("rank", 0.95), p99=("rank", 0.99))
    m = F.col("p50")
    return out.withColumn("verdict", F.when(m <= 3000, "PASS").when(m <= 10000, "WARN").when(m <= 15000, "SLOW").otherwise("KILL"))


def sampled(rows: DataFrame, id_col: str, share: float, seed: str = "s") -> DataFrame:
    """A monotone sample: ceil(share * n) rows of least digest, so smaller shares lie within larger ones.

    The cut value comes from counts of digest prefixes, so no global sort or single-task window is needed.
    """
    digest = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    rows = rows.withColumn("_d", digest)
    total = rows.count()
    want = -int(-share * total // 1)
    if want >= total:
        return rows.drop("_d")
    if want <= 0:
        return rows.limit(0).drop("_d")
    seen = 0
    for r in rows.groupBy(F.substring("_d", 1, 3).alias("p")).count().orderBy("p").collect():  # 4096 rows at most
        if seen + r["count"] >= want:
            prefix = r["p"]
            break
        seen += r["count"]
    inner = rows.where(F.substring("_d", 1, 3) == prefix).orderBy("_d", id_col).limit(want - seen)
    return rows.where(F.substring("_d", 1, 3) < prefix).unionByName(inner).drop("_d")


def differing(a: DataFrame, b: DataFrame, on: str, value: str, error: str) -> DataFrame:
    """Two implementations over the same inputs: equivalent, or why not."""
    x = a.select(on, F.col(value).alias("va"), F.col(error).alias("ea"))
    y = b.select(on, F.col(value).alias("vb"), F.col(error).alias("eb"))
    out = F.when(F.col("ea").isNotNull() & F.col("eb").isNotNull(), F.when(F.col("ea") == F.col("eb"), "equivalent").otherwise("different_error"))
    out = out.when(F.col("ea").isNotNull(), "only_a_threw").when(F.col("eb").isNotNull(), "only_b_threw").when(F.col("va").eqNullSafe(F.col("vb")), "equivalent").otherwise("different_value")
    return x.join(y, on, "full").select(on, out.alias("outcome"))


def costs(runs: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Cost in dollars by the model's price per million tokens, or the default's. prices: one row per model."""
    rows = runs.join(prices, "model", "left")
    p_in, p_out = F.coalesce("p_in", F.lit(default[0])), F.coalesce("p_out", F.lit(default[1]))
    return rows.withColumn("cost", (F.col("input_tokens") * p_in + F.col("output_tokens") * p_out) / 1e6)


def re_emitted(body: Column, text: Column, size: int = 50, stride: int = 25) -> Column:
    """Whether any chunk of ``size`` characters of the body, at each stride, stands in the text; case and white space are folded."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    b, t = flat(body), flat(text)
    starts = F.sequence(F.lit(1), F.length(b) - size + 1, F.lit(stride))
    return F.when(F.length(b) >= size, F.exists(F.when(F.length(b) >= size, starts), lambda i: F.contains(t, F.substr(b, i, F.lit(size))))).otherwise(False)


def refusals(rows: DataFrame, by: list[str], rate: str, escapes: str) -> DataFrame:
    """Median, least and greatest refusal rate, and most escapes."""
    rest = rows.groupBy(*by).agg(F.min(rate).alias("least_rate"), F.max(rate).alias("greatest_rate"), F.max(escapes).alias("most_escapes"))
    return rest.join(percentiles(rows, by, rate, median_rate=("middle", 0)), by, "left")


def mutants(rows: DataFrame, by: list[str], outcome: str, reason: str) -> DataFrame:
    """Killed over all that aren't equivalent, and the survivors by reason (a map)."""
    count = lambda c, name: F.count_if(c).alias(name)
    o = F.col(outcome)
    total = rows.groupBy(*by).agg(count(o != "equivalent", "non_equivalent"), count(o == "killed", "killed"))
    left = rows.where(o == "survived").groupBy(*by, reason).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "_n")))).alias("survivors"))
    return total.join(left, by, "left").withColumn("score", F.round(F.try_divide("killed", "non_equivalent"), 6))


def hypotheses(runs: DataFrame, by: str = "task") -> DataFrame:
    """by, hc1..hc4, validated. runs: by, cell (A: strong without help, E: weak without, F: weak with help), passed, cost, cycles, failed (left out).

    hc1: E never passes, or takes five times the cycles of A; hc2: F passes at least once; hc3: F costs a fifth of A at most; hc4: F and A pass equally often.
    """
    rows = runs.where(~F.coalesce(F.col("failed"), F.lit(False)))
    of = lambda cell, value: F.when(F.col("cell") == cell, value)
    passed = F.col("passed").cast("double")
    cells = rows.groupBy(by).agg(*[f(of(c, v)).alias(f"{c}_{n}") for c in "AEF" for n, v, f in (("rate", passed, F.avg), ("any", passed, F.max), ("cost", F.col("cost"), F.avg), ("cycles", F.col("cycles"), F.avg))])
    no = F.lit(0.0)
    hc1 = (F.coalesce("E_any", no) == 0) | F.coalesce((F.col("A_cycles") > 0) & (F.col("E_cycles") >= 5 * F.col("A_cycles")), F.lit(False))
    hc2 = F.coalesce("F_any", no) > 0
    hc3 = F.coalesce((F.col("A_cost") > 0) & (F.coalesce("F_cost", no) / F.col("A_cost") <= 0.2), F.lit(False))
    hc4 = F.abs(F.coalesce("F_rate", no) - F.coalesce("A_rate", no)) < 0.001
    out = cells.select(by, hc1.alias("hc1"), hc2.alias("hc2"), hc3.alias("hc3"), hc4.alias("hc4"))
    return out.withColumn("validated", F.col("hc1") & F.col("hc2") & F.col("hc3") & F.col("hc4"))


def coherence_verdict(mean: Column, good: Column, bad: Column) -> list[Column]:
    """passed, killed: killed under a mean of 2.5 or over 15 % bad turns; passed from a mean of 4, 90 % good and at most 5 % bad turns, if not killed."""
    killed = F.coalesce((mean < 2.5) | (bad > 0.15), F.lit(False))
    return [(F.coalesce((mean >= 4) & (good >= 0.9) & (bad <= 0.05), F.lit(False)) & ~killed).alias("passed"), killed.alias("killed")]


def suite_verdict(verdicts: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """Counts of PASS, WARN, INCONCLUSIVE and PENDING tasks, and the suite's own: PENDING or INCONCLUSIVE if all are, PASS if some pass and none warn."""
    count = lambda v: F.count_if(F.col(verdict) == v)
    out = verdicts.groupBy(*by).agg(F.count("*").alias("tasks"), *[count(v).alias(v.lower()) for v in ("PASS", "WARN", "INCONCLUSIVE", "PENDING")])
    all_ = lambda v: F.col(v) == F.col("tasks")
    own = F.when(all_("pending"), "PENDING").when(all_("inconclusive"), "INCONCLUSIVE").when((F.col("pass") > 0) & (F.col("warn") == 0), "PASS").otherwise("WARN")
    return out.withColumn("suite", own)


def curve(blocks: DataFrame, hits: dict[str, tuple[Column, Column]], populations: dict[str, Column], steps: int = 10) -> DataFrame:
    """share, comparator, population, tasks, hit_rate, mean_of_ratios, ratio_of_sums: savings when a share of the registry is there.

    blocks: task, place (0 to 1: the share from which a block is covered), raw. hits: by comparator whether a covered block hits, and what a hit costs.
    populations: by name which blocks count. The shares are a spine of steps + 1 rows, so tasks are read once.
    """
    spine = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_i")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("comparator"), h.alias("hit"), c.cast("double").alias("cost")) for n, (h, c) in hits.items()])).alias("_h")
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in populations.items()]))
    rows = blocks.withColumn("_g", names).select("task", "place", "raw", "_g", kinds).select("task", "place", "raw", "_h", F.explode("_g").alias("population"))
    rows = rows.select("task", "place", "raw", "population", "_h.*", spine)
    hit = F.col("hit") & (F.col("place") * steps < F.col("_i"))
    spent = F.when(hit, F.col("cost")).otherwise(F.col("raw"))
    per = rows.groupBy("_i", "comparator", "population", "task").agg(F.avg(hit.cast("double")).alias("h"), F.sum("raw").alias("r"), F.sum(spent).alias("s"))
    saved = F.coalesce(F.try_divide(F.col("r") - F.col("s"), F.col("r")), F.lit(0.0))
    return per.groupBy((F.col("_i") / steps).alias("share"), "comparator", "population").agg(F.count("*").alias("tasks"), F.avg("h").alias("hit_rate"), F.avg(saved).alias("mean_of_ratios"), F.coalesce(F.try_divide(F.sum(F.col("r") - F.col("s")), F.sum("r")), F.lit(0.0)).alias("ratio_of_sums"))


def economics(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs, pass rate, mean input, output and cache tokens, dollars a run and turns of each cell."""
    mean = lambda c: F.round(F.avg(c), 5).alias(c)
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), *[mean(c) for c in ("tokens_in", "tokens_out", "tokens_cached", "cost", "turns")])


#: Tokens that a hit costs instead of the block's own.
HIT_TOKENS = 45


def simulated(blocks: DataFrame, by: str, covered: Column, raw: str, hit_tokens: int = HIT_TOKENS) -> DataFrame:
    """by, blocks, hits, hit_rate, covered_share (of the raw tokens), spent: a covered block costs ``hit_tokens``, another its own."""
    hit = F.coalesce(covered, F.lit(False))
    rows = blocks.withColumns({"_h": hit, "_s": F.when(hit, hit_tokens).otherwise(F.col(raw))})
    out = rows.groupBy(by).agg(F.count("*").alias("blocks"), F.count_if("_h").alias("hits"), F.sum(F.when(F.col("_h"), F.col(raw)).otherwise(0)).alias("_c"), F.sum(raw).alias("_r"), F.sum("_s").alias("spent"))
    return out.select(by, "blocks", "hits", F.round(F.col("hits") / F.col("blocks"), 6).alias("hit_rate"), F.round(F.try_divide("_c", "_r"), 6).alias("covered_share"), "spent")


def round_trips(rows: DataFrame, by: list[str], k: int = 10, good: float = 0.7) -> DataFrame:
    """Commits by state: atomised, root among the first k, score of ``good`` or more, as shares, and the number and first of those that fail any.

    rows: id, atomised, rank (null: not found), score.
    """
    found = F.coalesce(F.col("rank") <= k, F.lit(False))
    strong = F.coalesce(F.col("score") >= good, F.lit(False))
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    bad = ~(F.col("atomised") & found & strong)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("atomised"), "atomised"), share(found, "in_top"), share(strong, "strong"), F.count_if(bad).alias("failing"), F.min(F.when(bad, F.col("id"))).alias("first_failing"))
