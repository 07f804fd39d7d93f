"""The ledger over orders (bounties) and lineitem (claims, attestations, reputation events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

NOW = 915148800000  # 1999-01-01 UTC


def ms(c):
    return F.expr(f"unix_micros(cast({c} as timestamp)) div 1000")


def bounties(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bounty"), ms("o_orderdate").alias("created"), ((1 + F.col("o_orderkey") % 80) * 3_600_000).alias("commit_ms"), ((1 + F.col("o_orderkey") % 14) * 1_800_000).alias("reveal_ms"))


_BOUNTIES = "b AS (SELECT o_orderkey AS bounty, epoch_ms(o_orderdate) AS created, (1 + o_orderkey % 80) * 3600000 AS commit_ms, (1 + o_orderkey % 14) * 1800000 AS reveal_ms FROM orders)"


@query(f"WITH {_BOUNTIES} SELECT bounty, commit_ms BETWEEN 3600000 AND 259200000 AND reveal_ms BETWEEN 1800000 AND 21600000 AS valid FROM b")
def bounty_validation(spark, sf_dir):
    return bounties(spark, sf_dir).select("bounty", L.valid_windows(F.col("commit_ms"), F.col("reveal_ms")).alias("valid"))


@query(f"WITH {_BOUNTIES}, s AS (SELECT CASE WHEN {NOW} < created THEN 'FUTURE' WHEN {NOW} < created + commit_ms THEN 'COMMIT' WHEN {NOW} < created + commit_ms + reveal_ms THEN 'REVEAL' ELSE 'CHECK' END AS state, bounty FROM b) SELECT state, count(*) AS n, min(bounty) AS first_bounty FROM s GROUP BY state")
def bounty_state_asof(spark, sf_dir):
    state = L.bounty_state(F.lit(NOW), F.col("created"), F.col("commit_ms"), F.col("reveal_ms"))
    return bounties(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("bounty").alias("first_bounty"))


_TALLY = "t AS (SELECT l_orderkey AS bounty, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) AS total FROM lineitem GROUP BY 1), a AS (SELECT *, total > 0 AND 3 * valid >= 2 * total AS accepted FROM t)"


def tallied(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bounty"), "l_returnflag")
    return L.tally(rows, ["bounty"], F.col("l_returnflag") != "R")


@query(f"WITH {_TALLY} SELECT bounty, valid, total, accepted FROM a")
def attestation_tally(spark, sf_dir):
    return tallied(spark, sf_dir)


@query(f"WITH {_BOUNTIES}, {_TALLY}, f AS (SELECT b.bounty, CASE WHEN coalesce(accepted, false) THEN 'ACCEPT' ELSE 'REJECT' END AS verdict FROM b LEFT JOIN a ON a.bounty = b.bounty) SELECT verdict, count(*) AS bounties, sum(n)::BIGINT AS claims FROM f LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = bounty GROUP BY verdict")
def bounty_finalize(spark, sf_dir):
    """All claims of a bounty become valid or invalid with it; a bounty without attestations is rejected."""
    rows = bounties(spark, sf_dir).select("bounty").join(tallied(spark, sf_dir), "bounty", "left")
    verdict = F.when(F.coalesce("accepted", F.lit(False)), "ACCEPT").otherwise("REJECT")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("bounties"), F.sum("total").alias("claims"))


@query("SELECT l_suppkey AS claimant, count(*) AS active FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY 1 HAVING count(*) >= 5")
def sybil_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' and l_returnflag = 'N'")
    return rows.groupBy(F.col("l_suppkey").alias("claimant")).agg(F.count("*").alias("active")).where("active >= 5")


@query("WITH e AS (SELECT l_suppkey AS account, epoch_ms(l_shipdate) AS t, CASE WHEN l_returnflag = 'R' THEN -10 ELSE 50 END AS delta FROM lineitem), n AS (SELECT max(t) AS now FROM e) SELECT account, round(sum(delta * pow(0.5, (now - t) / 15552000000.0)) + 100 * pow(0.5, (any_value(now) - min(t)) / 15552000000.0), 4) AS score, max(t) AS last_event, count(*) AS events FROM e, n GROUP BY account")
def reputation_decay(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("account"), ms("l_shipdate").alias("t"), F.when(F.col("l_returnflag") == "R", -10).otherwise(50).alias("delta"))
    now = rows.agg(F.max("t")).first()[0] or 0
    return L.reputation(rows, "account", "t", "delta", F.lit(now))


@query("""WITH r AS (SELECT l_orderkey AS claim, l_suppkey AS retractor, l_linenumber AS n, epoch_ms(l_shipdate) AS t, l_quantity * 100 AS base, l_discount >= 0.03 AS ok FROM lineitem WHERE l_returnflag = 'R'),
o AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY claim ORDER BY t, n, retractor, base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, t - min(t) OVER (PARTITION BY claim) AS age FROM r),
s AS (SELECT *, CASE WHEN ok AND before = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, floor(base * pow(2.0, -age / 2592000000.0) + 0.5) AS slashed FROM o)
SELECT status, count(*) AS n, sum(slashed)::BIGINT AS slashed, sum(floor(slashed * 0.5 + 0.5))::BIGINT AS reward, sum(slashed - floor(slashed * 0.5 + 0.5))::BIGINT AS treasury FROM s GROUP BY status""")
def retraction_slash(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("retractor"), F.col("l_linenumber").alias("n"), ms("l_shipdate").alias("t"), (F.col("l_quantity") * 100).alias("base"), (F.col("l_discount") >= 0.03).alias("ok"))
    rows = rows.withColumn("age", F.col("t") - F.min("t").over(Window.partitionBy("claim")))
    rows = L.resolved(rows, F.col("ok"), "claim", ["t", "n", "retractor", "base"])
    rows = rows.withColumn("slashed", L.slash(F.col("base"), F.col("age")))
    reward = F.floor(F.col("slashed") * 0.5 + 0.5)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("slashed").cast("long").alias("slashed"), F.sum(reward).cast("long").alias("reward"), F.sum(F.col("slashed") - reward).cast("long").alias("treasury"))


@query("SELECT doc_id, sha256(unhex(sha256(text)) || encode(source) || encode(lang)) AS commit_hash, doc_id % 4 != 0 AS opens FROM documents")
def commit_reveal_check(spark, sf_dir):
    """Commitments, and whether what is revealed opens them: every fourth reveals another nonce."""
    d = table(spark, sf_dir, "documents")
    made = L.commitment(F.col("text"), F.col("source"), F.col("lang"))
    told = L.commitment(F.col("text"), F.when(F.col("doc_id") % 4 == 0, F.lit("other")).otherwise(F.col("source")), F.col("lang"))
    return d.select("doc_id", made.alias("commit_hash"), (made == told).alias("opens"))


@query(f"SELECT l_suppkey AS claimant, count(*) FILTER (epoch_ms(l_shipdate) <= {NOW}) AS in_time, count(*) FILTER (epoch_ms(l_shipdate) > {NOW}) AS lapsed, min(epoch_ms(l_shipdate)) AS first_ms FROM lineitem GROUP BY 1")
def claims_asof(spark, sf_dir):
    t = ms("l_shipdate")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("claimant")).agg(F.count_if(t <= NOW).alias("in_time"), F.count_if(t > NOW).alias("lapsed"), F.min(t).alias("first_ms"))
