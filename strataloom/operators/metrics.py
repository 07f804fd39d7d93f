"""Retrieval quality: hit rate, precision, recall and reciprocal rank, calibration per band, worst lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bands with the lower edge and the expected share of right answers.
BANDS = (("strong", 0.85, 0.925), ("confident", 0.70, 0.775), ("weak", 0.50, 0.60), ("poor", 0.0, 0.25))


def per_query(results: DataFrame, k: int = 10) -> DataFrame:
    """results: query_id, rank, score, relevant -> query_id, top_score, top_right, first_right (null if none in k)."""
    right = F.col("relevant") & (F.col("rank") <= k)
    return results.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.bool_or((F.col("rank") == 1) & F.col("relevant")).alias("top_right"),
        F.min(F.when(right, F.col("rank"))).alias("first_right"),
    )


def quality(queries: DataFrame, bar: float = 0.5) -> DataFrame:
    """One row: queries, hit_rate (top score at or over the bar), p_at_1, recall, mrr."""
    return queries.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("top_score") >= bar).cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(F.col("top_right").cast("double")), 6).alias("p_at_1"),
        F.round(F.avg(F.col("first_right").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first_right"), F.lit(0.0))), 6).alias("mrr"),
    )


def reliability(queries: DataFrame) -> DataFrame:
    """band, n, p_right, brier (null without queries), passed; every band has a row."""
    spine = queries.sparkSession.createDataFrame(list(BANDS), "band string, low double, midpoint double")
    band = F.coalesce(*[F.when(F.col("top_score") >= low, name) for name, low, _ in BANDS])
    got = queries.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col("top_right").cast("double")).alias("p"))
    rows = F.broadcast(spine).join(got, "band", "left")
    brier = F.pow(F.col("p") - F.col("midpoint"), 2)
    return rows.select("band", F.coalesce("n", F.lit(0)).alias("n"), F.round("p", 6).alias("p_right"), F.round(brier, 6).alias("brier"), (brier < 0.1).alias("passed"))


def worst(queries: DataFrame, n: int, by: str | None = None) -> DataFrame:
    order = [F.asc_nulls_first("top_right"), F.desc_nulls_first("first_right"), F.asc("top_score"), F.asc("query_id")]
    if by is None:
        return queries.orderBy(*order).limit(n)
    return queries.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def reliability_diagram(queries: DataFrame, bins: int = 10) -> DataFrame:
    """bin, low, n, mean_score, p_right: the calibration of top scores in equal bins; every bin has a row."""
    spine = queries.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    b = F.least(F.floor(F.col("top_score") * bins), F.lit(bins - 1)).cast("int")
    got = queries.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("top_score").alias("s"), F.avg(F.col("top_right").cast("double")).alias("p"))
    rows = spine.join(got, "bin", "left")
    return rows.select("bin", (F.col("bin") / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), F.round("s", 6).alias("mean_score"), F.round("p", 6).alias("p_right"))


def judged(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results (query_id, id, rank, score) with relevant, joined to what is expected (query_id, ids: the expected one or any acceptable). Queries that expect nothing
    aren't eligible and drop out; results stay whole otherwise, and an eligible query without results gives one row of nulls."""
    rows = expected.where("ids is not null and size(ids) > 0").join(results, "query_id", "left")
    return rows.select("query_id", "id", "rank", "score", F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)).alias("relevant"))
