"""Retrieval quality over embeddings: a hit is right if it has the query's label and isn't the query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import vectors as V
from .discovery import cards
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

_EVAL = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label AS q_label FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id AS id, q_label, label, round(list_distance(q.e, v.embedding::DOUBLE[]), 6) AS distance FROM q, embeddings v WHERE vec_id != query_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d),
r AS (SELECT query_id, rank, q_label, round(greatest(0, 1 - distance * distance / 4), 6) AS score, label = q_label AS relevant FROM n WHERE rank <= 10),
p AS (SELECT query_id, any_value(q_label) AS label, max(score) FILTER (rank = 1) AS top_score, bool_or(rank = 1 AND relevant) AS top_right, min(rank) FILTER (relevant) AS first_right FROM r GROUP BY query_id)"""


def results(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels = e.select(F.col("vec_id").alias("id"), "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    rows = V.knn(e, cards(spark, sf_dir), 11).where("id != query_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where("rank <= 10")
    rows = rows.join(labels, "id").join(asked, "query_id")
    return rows.select("query_id", "rank", "q_label", F.round(V.score_of(F.col("distance")), 6).alias("score"), (F.col("label") == F.col("q_label")).alias("relevant"))


def queries_of(spark, sf_dir):
    rows = results(spark, sf_dir)
    return M.per_query(rows).join(rows.where("rank = 1").select("query_id", F.col("q_label").alias("label")), "query_id")


@query(f"WITH {_EVAL} SELECT count(*) AS queries, round(avg((top_score >= 0.5)::INT), 6) AS hit_rate, round(avg(top_right::INT), 6) AS p_at_1, round(avg((first_right IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1 / first_right, 0)), 6) AS mrr FROM p")
def retrieval_metrics(spark, sf_dir):
    return M.quality(queries_of(spark, sf_dir))


@query(f"WITH {_EVAL} SELECT label, count(*) AS queries, round(avg(coalesce(1 / first_right, 0)), 6) AS mrr FROM p GROUP BY label")
def mrr_by_label(spark, sf_dir):
    return queries_of(spark, sf_dir).groupBy("label").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first_right"), F.lit(0.0))), 6).alias("mrr"))


_BANDS = f"""{_EVAL}, s(band, low, high, midpoint) AS (VALUES ('strong', 0.85, 9.0, 0.925), ('confident', 0.7, 0.85, 0.775), ('weak', 0.5, 0.7, 0.6), ('poor', 0.0, 0.5, 0.25)),
g AS (SELECT band, any_value(midpoint)::DOUBLE AS midpoint, count(query_id) AS n, avg(top_right::INT) AS p FROM s LEFT JOIN p ON top_score >= low AND top_score < high GROUP BY band)"""


@query(f"WITH {_BANDS} SELECT band, n, round(p, 6) AS p_right, round((p - midpoint) ** 2, 6) AS brier, (p - midpoint) ** 2 < 0.1 AS passed FROM g")
def brier_bands(spark, sf_dir):
    return M.reliability(queries_of(spark, sf_dir))


@query(f"WITH {_EVAL} SELECT query_id, top_score, top_right, first_right::INT AS first_right FROM p ORDER BY top_right NULLS FIRST, first_right DESC NULLS FIRST, top_score, query_id LIMIT 5")
def worst_n(spark, sf_dir):
    return M.worst(queries_of(spark, sf_dir), 5).select("query_id", "top_score", "top_right", "first_right")


@query(f"WITH {_EVAL}, w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY top_right NULLS FIRST, first_right DESC NULLS FIRST, top_score, query_id) AS r FROM p) SELECT label, query_id, top_score FROM w WHERE r <= 2")
def worst_by_label(spark, sf_dir):
    return M.worst(queries_of(spark, sf_dir), 2, "label").select("label", "query_id", "top_score")


@query(f"WITH {_EVAL} SELECT query_id, rank::INT AS rank FROM r WHERE relevant QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1")
def rank_of_expected(spark, sf_dir):
    return M.per_query(results(spark, sf_dir)).where("first_right is not null").select("query_id", F.col("first_right").alias("rank"))
