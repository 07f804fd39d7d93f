"""Exact retrieval over vectors, scores, bands and tiers, and the staged discovery query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import DIGITS, knn


def score_of(distance: Column) -> Column:
    """1 - d*d/4, not below 0 nor above 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance * distance / 4))


def band_of(score: Column) -> Column:
    return F.when(score >= 0.85, "strong").when(score >= 0.70, "confident").when(score >= 0.50, "weak").otherwise("poor")


def cosine(a: Column, b: Column) -> Column:
    """0 when a norm is 0; null for different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    denominator = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(denominator == 0, 0.0).otherwise(dot / denominator))


def with_gap(ranked: DataFrame, score: str = "score", by: str = "query_id", rank: str = "rank") -> DataFrame:
    """Adds second (the next score, 0 if none) and gap."""
    nxt = F.lead(score, 1, 0.0).over(Window.partitionBy(by).orderBy(rank))
    return ranked.withColumn("second", nxt).withColumn("gap", F.col(score) - nxt)


def confidence_tier(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """by, top, gap, tier: auto_accept over 0.92, or over 0.85 with a gap over 0.05; else a candidate list."""
    first = with_gap(ranked, by=by).where("rank = 1")
    tier = F.when((F.col("score") > 0.92) | ((F.col("score") > 0.85) & (F.col("gap") > 0.05)), "auto_accept").otherwise("candidate_list")
    return first.select(by, F.col("score").alias("top"), "gap", tier.alias("tier"))


def discover(cards: DataFrame, vectors: DataFrame, blocks: DataFrame, top_k: int = 10, min_score: float = 0.0) -> DataFrame:
    """The five-stage query for many cards at once: one row per candidate or, where a card has none, near miss.

    cards: card_id, embedding, inputs, outputs (arrays; both null: no signature, one null: an empty list), purity, thread (ranks; null: not asked for).
    vectors: spec_id, embedding. blocks: best block per spec: spec_id, root, inputs, outputs, n_errors, purity, thread.
    A table without the column inputs counts as one where it is null (cards) or empty (blocks).
    A card takes the max(5 * top_k, 50) nearest specs; specs without a block drop out and aren't filled up again.
    failed_at names the first failing layer; candidates have null there.
    """
    none = F.expr("cast(array() as array<string>)")
    cards = cards if "inputs" in cards.columns else cards.withColumn("inputs", F.lit(None).cast("array<string>"))
    blocks = blocks if "inputs" in blocks.columns else blocks.withColumn("inputs", none)
    k = max(5 * top_k, 50)
    near = knn(vectors.select(F.col("spec_id").alias("vec_id"), "embedding"), cards.select(F.col("card_id").alias("vec_id"), "embedding"), k)
    asked = cards.select(F.col("card_id").alias("query_id"), F.col("inputs").alias("q_inputs"), F.col("outputs").alias("q_outputs"), F.col("purity").alias("q_purity"), F.col("thread").alias("q_thread"))
    rows = near.join(blocks, near["id"] == blocks["spec_id"]).join(asked, "query_id")
    score = score_of(F.col("distance"))
    same = (F.coalesce("q_inputs", none) == F.col("inputs")) & (F.coalesce("q_outputs", none) == F.col("outputs")) & (F.col("n_errors") == 0)
    structural = (F.col("q_inputs").isNotNull() | F.col("q_outputs").isNotNull()) & ~same
    strict = ~(F.coalesce(F.col("purity") >= F.col("q_purity"), F.lit(True)) & F.coalesce(F.col("thread") >= F.col("q_thread"), F.lit(True)))
    failed = F.when(structural, "structural").when(strict, "strictness").when(score < min_score, "min_score")
    rows = rows.select("query_id", "root", F.round(score, DIGITS).alias("score"), failed.alias("failed_at"))
    per = Window.partitionBy("query_id")
    rows = rows.withColumn("passing", F.count_if(F.col("failed_at").isNull()).over(per))
    rows = rows.where("failed_at is null or passing = 0")
    rows = rows.withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "root"))).where(F.col("rank") <= top_k)
    rows = with_gap(rows)
    auto = F.col("failed_at").isNull() & (F.col("rank") == 1) & (F.col("score") > 0.85) & (F.col("gap") > 0.15)
    return rows.select("query_id", "root", "score", "failed_at", "rank", auto.alias("auto_accepted"))
