"""Specification matching over part: name words as inputs, type as output, sizes as ranks, brand as error."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.blocks import against
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

_SPECS = "s AS (SELECT p_partkey AS id, [x || ':' || p_type FOR x IN string_split(p_name, ' ')] AS ins, ['out:' || p_type] AS outs, [p_brand] AS errs, p_size % 4 AS purity, p_size % 3 AS thread, CASE WHEN p_size % 5 <> 0 THEN p_size % 2 END AS time FROM part)"
_PAIRS = f"WITH {_SPECS}, p AS (SELECT a.id AS a, b.id AS b, a.ins AS wi, b.ins AS hi, a.outs AS wo, b.outs AS ho, a.errs AS we, b.errs AS he, a.purity AS wp, b.purity AS hp, a.thread AS wt, b.thread AS ht, a.time AS wc, b.time AS hc FROM s a, s b WHERE a.id % 100 = 0)"
_REASONS = "list_filter([CASE WHEN len(wi) != len(hi) THEN 'input_count' END, CASE WHEN len(wi) = len(hi) AND wi != hi THEN 'input_mismatch' END, CASE WHEN len(wo) != len(ho) THEN 'output_count' END, CASE WHEN len(wo) = len(ho) AND wo != ho THEN 'output_mismatch' END, CASE WHEN len(list_filter(he, lambda x: NOT list_contains(we, x))) > 0 THEN 'undeclared_error' END, CASE WHEN hp < wp THEN 'purity' END, CASE WHEN ht < wt THEN 'thread_safety' END, CASE WHEN wc <> hc THEN 'time' END], lambda x: x IS NOT NULL)"


def specs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.transform(F.split("p_name", " "), lambda x: F.struct(x.alias("name"), F.col("p_type").alias("type"))).alias("ins"), F.array(F.struct(F.lit("out").alias("name"), F.col("p_type").alias("type"))).alias("outs"), F.array("p_brand").alias("errs"), (F.col("p_size") % 4).alias("purity"), (F.col("p_size") % 3).alias("thread"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 2).alias("time"))


@query(f"{_PAIRS}, r AS (SELECT a, b, {_REASONS} AS reasons FROM p) SELECT a, b FROM r WHERE len(reasons) = 0")
def structural_match(spark, sf_dir):
    """What matches has equal inputs and outputs, so those join; the other reasons are told of these pairs only."""
    s = specs(spark, sf_dir)
    a = s.where("id % 100 = 0").select(F.col("id").alias("a"), "ins", "outs", *[F.col(c).alias(f"w_{c}") for c in ("errs", "purity", "thread", "time")])
    rows = a.join(s.select(F.col("id").alias("b"), "ins", "outs", *[F.col(c).alias(f"h_{c}") for c in ("errs", "purity", "thread", "time")]), ["ins", "outs"])
    of = lambda c: (F.col(f"w_{c}"), F.col(f"h_{c}"))
    same = F.col("ins"), F.col("ins"), F.col("outs"), F.col("outs")
    return rows.where(F.size(M.reasons(*same, *of("errs"), *of("purity"), *of("thread"), costs={"time": of("time")})) == 0).select("a", "b")


@query(f"{_PAIRS}, r AS (SELECT unnest({_REASONS}) AS reason FROM p) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def match_reasons(spark, sf_dir):
    s = specs(spark, sf_dir)
    return M.reason_counts(s.where("id % 100 = 0"), s)


@query(f"{_PAIRS} SELECT a, count(*) FILTER (coalesce(hp >= wp, true) AND (b % 7 = 0 OR ht >= wt)) AS passed, count(*) AS seen FROM p GROUP BY a")
def strictness_gate(spark, sf_dir):
    """Candidates weaker in a field that both declare are rejected; every seventh declares no thread safety."""
    s = specs(spark, sf_dir)
    have = s.groupBy(F.col("purity").alias("hp"), F.when(F.col("id") % 7 != 0, F.col("thread")).alias("ht")).agg(F.count("*").alias("n"))  # ranks are few
    want = s.where("id % 100 = 0").select(F.col("id").alias("a"), F.col("purity").alias("wp"), F.col("thread").alias("wt"))
    ok = M.strict_enough(F.col("wp"), F.col("hp")) & M.strict_enough(F.col("wt"), F.col("ht"))
    return against(want, have).groupBy("a").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("passed"), F.sum("n").alias("seen"))


@query("SELECT p_partkey AS id, (10 * (p_size % 4) + p_size % 3)::INT AS score FROM part")
def nf_score(spark, sf_dir):
    return specs(spark, sf_dir).select("id", M.nf_score(F.col("purity"), F.col("thread")).alias("score"))


@query(f"{_PAIRS}, r AS (SELECT a, b, 1.0 - len({_REASONS}) / 8.0 AS match FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY match DESC, b) AS rank FROM r) SELECT a, b, round(match, 6)::DOUBLE AS match, rank::INT AS rank FROM o WHERE rank <= 5")
def structural_search(spark, sf_dir):
    """The five best candidates by the share of checks that hold."""
    s = specs(spark, sf_dir)
    return M.search(s.where("id % 100 = 0"), s, 5).select("a", "b", F.round(1 - F.col("n") / 8, 6).alias("match"), "rank")
