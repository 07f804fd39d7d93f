"""Vector retrieval and discovery over embeddings; queries are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import vectors as V
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

_KNN = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label AS q_label FROM embeddings WHERE vec_id % 100 = 0),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
d AS (SELECT query_id, id, q_label, label, round(list_distance(q.e, v.e), 6) AS distance FROM q, v),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d),
t AS (SELECT *, round(greatest(0, 1 - distance * distance / 4), 6) AS score FROM n WHERE rank <= {k})"""
KNN10 = _KNN.format(k=10)
KNN50 = _KNN.format(k=50)


def cards(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


def top10(spark, sf_dir):
    found = V.knn(table(spark, sf_dir, "embeddings"), cards(spark, sf_dir), 10)
    return found.withColumn("score", F.round(V.score_of(F.col("distance")), V.DIGITS))


@query(f"WITH {KNN10} SELECT query_id, id, distance, rank::INT AS rank FROM t")
def knn_top10(spark, sf_dir):
    return top10(spark, sf_dir).select("query_id", "id", "distance", "rank")


@query(f"""WITH {KNN10}, b AS (SELECT CASE WHEN score >= 0.85 THEN 'strong' WHEN score >= 0.7 THEN 'confident' WHEN score >= 0.5 THEN 'weak' ELSE 'poor' END AS band, score FROM t)
SELECT band, count(*) AS n, round(avg(score), 5) AS mean_score FROM b GROUP BY band""")
def score_bands(spark, sf_dir):
    return top10(spark, sf_dir).groupBy(V.band_of(F.col("score")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


_GAP = """g AS (SELECT *, lead(score, 1, 0) OVER (PARTITION BY query_id ORDER BY rank) AS second FROM t)"""


@query(f"""WITH {KNN10}, {_GAP} SELECT query_id, score AS top, round(score - second, 6) AS gap,
CASE WHEN score > 0.92 OR (score > 0.85 AND round(score - second, 6) > 0.05) THEN 'auto_accept' ELSE 'candidate_list' END AS tier FROM g WHERE rank = 1""")
def confidence_tier(spark, sf_dir):
    out = V.confidence_tier(top10(spark, sf_dir))
    return out.withColumn("gap", F.round("gap", 6))


@query(f"""WITH {KNN10}, o AS (SELECT query_id, id, distance, score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM t WHERE id != query_id),
g AS (SELECT *, lead(score, 1, 0) OVER (PARTITION BY query_id ORDER BY r) AS second FROM o)
SELECT query_id, id, score, round(score - second, 6) AS gap, score > 0.85 AND round(score - second, 6) > 0.15 AS substitute FROM g WHERE r = 1""")
def substitute_decision(spark, sf_dir):
    """The best hit other than the query itself replaces it if it scores over 0.85 and 0.15 over the next."""
    rows = top10(spark, sf_dir).where("id != query_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    gap = F.round("gap", 6)
    return V.with_gap(rows).where("rank = 1").select("query_id", "id", "score", gap.alias("gap"), ((F.col("score") > 0.85) & (gap > 0.15)).alias("substitute"))


#: Blocks of a spec: documents by doc_id // 2; the best has a passing label, then the smallest root.
_BEST = """b AS (SELECT d.doc_id // 2 AS spec_id, sha256(d.text) AS root, coalesce(l.quality, 0) AS passing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
best AS (SELECT spec_id, root FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY passing DESC, root) AS r FROM b) WHERE r = 1),
blocks AS (SELECT best.spec_id, root, CASE WHEN p_size % 6 = 0 THEN [] ELSE [p_brand] END AS inputs, CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_type] END AS outputs, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS n_errors, p_size % 4 AS purity, p_size % 3 AS thread FROM best JOIN part ON p_partkey = best.spec_id)"""


def best_blocks(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("root")).join(labels, "doc_id", "left")
    rows = rows.select(F.expr("doc_id div 2").alias("spec_id"), "root", F.coalesce("quality", F.lit(0)).alias("passing"))
    best = rows.groupBy("spec_id").agg(F.min(F.struct((-F.col("passing")).alias("o"), "root")).alias("b")).select("spec_id", "b.root")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("spec_id"), F.when(F.col("p_size") % 6 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("p_brand")).alias("inputs"), F.when(F.col("p_size") % 7 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("p_type")).alias("outputs"), F.when(F.col("p_size") % 5 == 0, 1).otherwise(0).alias("n_errors"), (F.col("p_size") % 4).alias("purity"), (F.col("p_size") % 3).alias("thread"))
    return best.join(part, "spec_id")


def discovered(spark, sf_dir, min_score):
    rows = cards(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_type", "p_brand", "p_size"), "vec_id")
    asked = rows.select(
        F.col("vec_id").alias("card_id"),
        "embedding",
        F.when(F.expr("vec_id % 500 = 0"), F.array("p_brand")).alias("inputs"),
        F.when(F.expr("vec_id % 300 = 0"), F.array("p_type")).alias("outputs"),
        F.when(F.expr("vec_id % 200 = 0"), F.col("p_size") % 4).alias("purity"),
        F.when(F.expr("vec_id % 200 = 0"), F.col("p_size") % 3).alias("thread"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spec_id"), "embedding")
    return V.discover(asked, vectors, best_blocks(spark, sf_dir), 10, min_score)


def _discover_sql(min_score: float) -> str:
    return f"""WITH {KNN50}, {_BEST},
c AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 500 = 0 THEN [p_brand] END AS q_inputs, CASE WHEN p_partkey % 300 = 0 THEN [p_type] END AS q_outputs, CASE WHEN p_partkey % 200 = 0 THEN p_size % 4 END AS q_purity, CASE WHEN p_partkey % 200 = 0 THEN p_size % 3 END AS q_thread FROM part),
f AS (SELECT t.query_id, root, score, CASE WHEN (q_inputs IS NOT NULL OR q_outputs IS NOT NULL) AND NOT (coalesce(q_inputs, []) = inputs AND coalesce(q_outputs, []) = outputs AND n_errors = 0) THEN 'structural'
  WHEN NOT (coalesce(purity >= q_purity, true) AND coalesce(thread >= q_thread, true)) THEN 'strictness'
  WHEN score < {min_score} THEN 'min_score' END AS failed_at
  FROM t JOIN c ON t.query_id = c.query_id JOIN blocks ON blocks.spec_id = t.id),
w AS (SELECT *, count(*) FILTER (failed_at IS NULL) OVER (PARTITION BY query_id) AS passing FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, root) AS rank FROM w WHERE failed_at IS NULL OR passing = 0),
x AS (SELECT *, lead(score, 1, 0) OVER (PARTITION BY query_id ORDER BY rank) AS second FROM r WHERE rank <= 10)
SELECT query_id, root, score, failed_at, rank::INT AS rank, failed_at IS NULL AND rank = 1 AND score > 0.85 AND score - second > 0.15 AS auto_accepted FROM x"""


@query(_discover_sql(0.0))
def discovery_pipeline(spark, sf_dir):
    return discovered(spark, sf_dir, 0.0)


@query(f"SELECT query_id, root, score, failed_at, rank FROM ({_discover_sql(0.9)}) WHERE failed_at IS NOT NULL")
def near_misses(spark, sf_dir):
    return discovered(spark, sf_dir, 0.9).where("failed_at is not null").select("query_id", "root", "score", "failed_at", "rank")


@query(f"SELECT query_id, root, score FROM ({_discover_sql(0.0)}) WHERE auto_accepted")
def auto_accept(spark, sf_dir):
    return discovered(spark, sf_dir, 0.0).where("auto_accepted").select("query_id", "root", "score")


@query(f"""WITH {KNN10}, s AS (SELECT query_id, id, rank, score, CASE WHEN id % 7 = 0 THEN 'retracted' WHEN id % 3 = 0 THEN 'accepted' END AS status FROM t),
r AS (SELECT query_id, id, rank, round(least(1, greatest(0, score + CASE status WHEN 'retracted' THEN -0.2 WHEN 'accepted' THEN 0.05 ELSE 0 END)), 6) AS score FROM s)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS rank FROM r""")
def proof_rescoring(spark, sf_dir):
    """Scores moved by proof status (retracted down, accepted up), clamped and ranked again; equals keep their order."""
    status = F.when(F.col("id") % 7 == 0, "retracted").when(F.col("id") % 3 == 0, "accepted")
    return M.rescored(top10(spark, sf_dir), status, "preferred").select("query_id", "id", "score", "rank")


@query(f"WITH {KNN10} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS rank FROM t WHERE id % 3 = 0 AND id % 7 <> 0")
def proof_required(spark, sf_dir):
    """Only accepted candidates stay."""
    status = F.when(F.col("id") % 7 == 0, "retracted").when(F.col("id") % 3 == 0, "accepted")
    return M.rescored(top10(spark, sf_dir), status, "required").select("query_id", "id", "score", "rank")


@query(f"""WITH {KNN10}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM t)
SELECT query_id, CASE WHEN query_id % 700 = 0 OR max(top) >= 0.7 THEN 'matched' WHEN max(top) >= 0.5 THEN 'weak_only' ELSE 'no_match' END AS status,
count(*) FILTER (top - score <= 0.02) AS close, CASE WHEN query_id % 700 <> 0 AND count(*) FILTER (top - score <= 0.02) >= 5 THEN CASE WHEN query_id % 200 = 0 THEN '' ELSE 'inputs,' END || CASE WHEN query_id % 300 = 0 THEN '' ELSE 'outputs,' END || 'purity,thread' END AS hint FROM m GROUP BY query_id""")
def resolve_status(spark, sf_dir):
    """Status by the best score or a hit by hash, and the dimensions that a query with many close candidates could name."""
    k = F.col("vec_id")
    none = F.lit(None).cast("string")
    asked = cards(spark, sf_dir).select(k.alias("query_id"), (k % 700 == 0).alias("hash_hit"), F.when(k % 200 == 0, "i").alias("inputs"), F.when(k % 300 == 0, "o").alias("outputs"), none.alias("purity"), none.alias("thread"))
    return M.resolved(top10(spark, sf_dir), asked)


@query(f"""WITH {KNN10}, local AS (SELECT query_id, substr(sha256(id::VARCHAR), 1, 8) AS address, score, rank FROM t WHERE rank <= 5),
wide AS (SELECT query_id, substr(sha256((id + id % 2)::VARCHAR), 1, 8) AS address, min(rank) AS rank FROM t GROUP BY ALL),
new AS (SELECT g.query_id, g.address, row_number() OVER (PARTITION BY g.query_id ORDER BY g.rank, g.address) AS r FROM wide g ANTI JOIN local l ON g.query_id = l.query_id AND g.address = l.address)
SELECT query_id, address, score, 'local' AS origin FROM local UNION ALL SELECT query_id, address, 0.0, 'global' FROM new WHERE r <= 3""")
def merge_local_global(spark, sf_dir):
    """Local hits, then global ones whose short address isn't local, up to eight in all, scored 0."""
    rows = top10(spark, sf_dir)
    address = lambda c: F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 8)
    local = rows.where("rank <= 5").select("query_id", address(F.col("id")).alias("address"), "score")
    far = rows.groupBy("query_id", address(F.col("id") + F.col("id") % 2).alias("address")).agg(F.min("rank").alias("rank"))
    new = far.join(local, ["query_id", "address"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "address")))
    return local.withColumn("origin", F.lit("local")).unionByName(new.where("r <= 3").select("query_id", "address", F.lit(0.0).alias("score"), F.lit("global").alias("origin")))
