"""Replication between registries: odd documents are remote, even ones and those with doc_id % 3 = 0 local."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources import wire
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

_SIDES = "d AS (SELECT doc_id, sha256(text) AS root, text, lang FROM documents), far AS (SELECT * FROM d WHERE doc_id % 2 = 1), near AS (SELECT * FROM d WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)"
_OUT = f"WITH {_SIDES}, o AS (SELECT far.*, CASE WHEN root IN (SELECT root FROM near) THEN 'skipped' WHEN lang = 'es' THEN 'failed' ELSE 'inserted' END AS outcome FROM far)"


def sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", R.sha(F.col("text")).alias("root"), "lang")
    return d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0 or doc_id % 3 = 0")


@query(f"{_OUT} SELECT doc_id, root FROM o WHERE outcome <> 'skipped'")
def mirror_diff(spark, sf_dir):
    far, near = sides(spark, sf_dir)
    return far.join(near.select("root").distinct(), "root", "left_anti").select("doc_id", "root")


@query(f"{_OUT} SELECT count(*) AS considered, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, count(DISTINCT lang) AS specs_walked FROM o")
def mirror_report(spark, sf_dir):
    far, near = sides(spark, sf_dir)
    rows = R.mirrored(far, near, F.col("lang") != "es", versions=(3, 3))
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return rows.agg(F.count("*").alias("considered"), count("inserted"), count("skipped"), count("failed"), F.count_distinct("lang").alias("specs_walked"))


@query("WITH e AS (SELECT l_partkey AS stricter, l_suppkey AS looser FROM lineitem) SELECT DISTINCT stricter, looser FROM e WHERE stricter IN (SELECT p_partkey FROM part WHERE p_size < 10) AND looser IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_edges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("stricter"), F.col("l_suppkey").alias("looser"))
    a = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("stricter"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("looser"))
    return e.join(a, "stricter", "left_semi").join(b, "looser", "left_semi").select("stricter", "looser").distinct()


@query("WITH fresh AS (SELECT DISTINCT sha256(text) AS root, source FROM documents), kept AS (SELECT DISTINCT sha256(text) AS root FROM documents WHERE doc_id % 4 = 0) SELECT source, count(*) AS missing, min(root) AS first_root FROM fresh WHERE root NOT IN (SELECT root FROM kept) GROUP BY source")
def verify_subset(spark, sf_dir):
    """Fresh roots that the committed manifest doesn't have, by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", R.sha(F.col("text")).alias("root"), "source")
    fresh = d.select("root", "source").distinct()
    missing = fresh.join(d.where("doc_id % 4 = 0").select("root").distinct(), "root", "left_anti")
    return missing.groupBy("source").agg(F.count("*").alias("missing"), F.min("root").alias("first_root"))


@query("WITH a AS (SELECT sha256(text) AS root, 0 AS prior, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT sha256(text), 1, doc_id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 5 = 0) SELECT root, min(prior)::INT AS prior, arg_min(doc_id, (prior, doc_id)) AS doc_id FROM a GROUP BY root")
def manifest_merge(spark, sf_dir):
    """A union by root in which the prior manifest wins."""
    d = table(spark, sf_dir, "documents").select(R.sha(F.col("text")).alias("root"), "doc_id")
    both = d.where("doc_id % 2 = 0").withColumn("prior", F.lit(0)).unionByName(d.where("doc_id % 2 = 1 or doc_id % 5 = 0").withColumn("prior", F.lit(1)))
    return R.first_wins(both, ["root"], ["prior", "doc_id"])


@query("SELECT doc_id, CASE WHEN length(text) < 100 THEN 'short_text' WHEN lang = 'es' THEN 'language' WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source' END AS reject_reason, to_base64(encode(left(text, 20))) AS head FROM documents")
def wire_validation(spark, sf_dir):
    """Rows to the wire form and back, with the first rule that a row breaks."""
    d = table(spark, sf_dir, "documents")
    rules = [("short_text", F.length("text") < 100), ("language", F.col("lang") == "es"), ("source", ~F.col("source").rlike("^src[0-9]$"))]
    sent = wire.to_wire(d.select("doc_id", "lang", "source", "text", F.left("text", F.lit(20)).cast("binary").alias("head")), binary=["head"])
    back = wire.from_wire(sent, "doc_id long, lang string, source string, text string, head binary", binary=["head"])
    return back.select("doc_id", wire.first_broken(rules).alias("reject_reason"), F.base64("head").alias("head"))


@query("SELECT source, count(*) AS n, count(*) FILTER (doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)) AS to_pull FROM documents GROUP BY source")
def pull_plan(spark, sf_dir):
    far, near = sides(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = far.join(near.select("root").distinct(), "root", "left_anti").select("doc_id", F.lit(1).alias("x"))
    return d.join(new, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("x").alias("to_pull"))
