"""Exports, pages, submissions, batches and queues, each beside the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as B
from ..operators import ledger as L
from ..operators import matching as M
from ..operators import registry as R
from ..operators import telemetry as T
from ..operators import validation as C
from ..operators.cluster import cut, new_path
from ..sources import catalogue, jsonl
from .benchmarks import _TURNS, turns
from .discovery import KNN10, top10
from .records import _ROOT, block_rows
from .registering import slice_of, table
from .telemetry import EVENTS, events

QUERIES, SQL, query = slice_of()


folder = new_path


@query("SELECT vec_id, len(embedding)::BIGINT AS dims, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum([x::DOUBLE FOR x IN embedding]), 5) AS total FROM embeddings")
def vectors_export(spark, sf_dir):
    """Vectors written as JSON and read back."""
    path = folder(spark, "vectors")
    R.export_vectors(table(spark, sf_dir, "embeddings"), path)
    rows = spark.read.schema("vec_id long, vector array<double>").json(path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.size("vector").cast("long").alias("dims"), F.round(F.col("vector")[0], 6).alias("first"), F.round(total, 5).alias("total"))


@query("WITH c AS (SELECT doc_id // 2 AS spec, min(sha256(text)) AS root FROM documents GROUP BY 1), v AS (SELECT vec_id AS spec FROM embeddings) SELECT (SELECT count(*) FROM c WHERE spec IN (SELECT spec FROM v)) AS cards, (SELECT count(*) FROM v WHERE spec IN (SELECT spec FROM c)) AS vectors, (SELECT count(*) FROM c WHERE spec NOT IN (SELECT spec FROM v)) AS no_vector, (SELECT count(*) FROM v WHERE spec NOT IN (SELECT spec FROM c)) AS no_card, (SELECT min(root) FROM c WHERE spec IN (SELECT spec FROM v)) AS first_root")
def atom_index_files(spark, sf_dir):
    """The index's two files, written and counted, and what either side lacks."""
    cards = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("spec"), R.sha(F.col("text")).alias("root"))
    best, vectors, missing = R.atom_index(cards, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spec"), "embedding"), "spec", "root")
    path = folder(spark, "index")
    best.write.json(f"{path}/cards")
    vectors.write.json(f"{path}/vectors")
    a = spark.read.schema("spec long, root string").json(f"{path}/cards").agg(F.count("*").alias("cards"), F.min("root").alias("first_root"))
    n = spark.read.schema("spec long").json(f"{path}/vectors").count()
    number = lambda x, name: F.lit(x).cast("long").alias(name)
    return a.select("cards", number(n, "vectors"), number(missing["vectors"], "no_vector"), number(missing["cards"], "no_card"), "first_root")


@query("WITH u AS (SELECT DISTINCT sha256(text) AS root FROM documents), n AS (SELECT root, row_number() OVER (ORDER BY root) AS i, count(*) OVER () AS k FROM u) SELECT root, ceil(i / 100)::BIGINT AS page, ceil(i / 100) * 100 < k AS more FROM n")
def catalog_pages(spark, sf_dir):
    """All pages of the catalog at once, a hundred roots each."""
    return R.pages(table(spark, sf_dir, "documents").select(R.sha(F.col("text")).alias("root")), "root", 100, cut)


@query(f"""WITH b AS (SELECT doc_id, {_ROOT} AS made FROM documents), r AS (SELECT doc_id, made, CASE WHEN doc_id % 11 = 0 THEN sha256('other') ELSE made END AS root FROM b), n AS (SELECT * FROM r WHERE doc_id % 3 <> 0), f AS (SELECT root, min(doc_id) AS first FROM n WHERE doc_id % 9 <> 1 AND root = made AND (doc_id % 13 <> 0 OR doc_id % 26 = 0) GROUP BY root)
SELECT doc_id, CASE WHEN doc_id % 9 = 1 THEN 'rejected:level' WHEN n.root <> made THEN 'integrity_failed' WHEN doc_id % 13 = 0 AND doc_id % 26 <> 0 THEN 'foreign_incomplete' WHEN n.root IN (SELECT root FROM r WHERE doc_id % 3 = 0) OR doc_id <> first THEN 'skipped' ELSE 'inserted' END AS outcome FROM n LEFT JOIN f ON f.root = n.root""")
def submitted_blocks(spark, sf_dir):
    """What clients submit: bad levels are rejected before the store looks at the rest."""
    rows = block_rows(spark, sf_dir)
    errors = F.array_compact(F.array(F.when(F.col("doc_id") % 9 == 1, "level")))
    return R.submitted(rows.where("doc_id % 3 != 0"), rows.where("doc_id % 3 = 0"), errors, F.col("made"), ["doc_id"]).select("doc_id", "outcome")


@query(f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN sha256('other') ELSE {_ROOT} END AS root, {_ROOT} AS made FROM documents),
v AS (SELECT DISTINCT root FROM b WHERE root = made AND doc_id % 9 <> 1) SELECT (SELECT count(*) FROM b) AS exported, (SELECT count(*) FROM b WHERE root <> made OR doc_id % 9 = 1) AS refused, count(*) AS stored, min(root) AS first_root, max(root) AS last_root FROM v""")
def catalogue_round_trip(spark, sf_dir):
    """A catalogue that is written, read page by page, checked row by row, and what passes written to another one and read again."""
    theirs, ours = new_path(spark, "catalogue"), new_path(spark, "catalogue")
    made = block_rows(spark, sf_dir)
    level = F.when(F.col("doc_id") % 9 == 1, "L9").otherwise("L0")
    wire = F.to_json(F.struct("doc_id", "made", level.alias("level"), R.sha(F.lit("spec")).alias("spec_hash"), F.lit("YQ==").alias("impl_base64"), F.lit('{"artifacts":[]}').alias("manifest"), F.col("doc_id").alias("created_at"), F.create_map(F.lit("a"), F.lit("YQ==")).alias("artifacts")))
    catalogue.append(made.select("root", wire.alias("wire")), theirs)
    half = "8"
    pages = catalogue.read(spark, theirs, until=half).unionByName(catalogue.read(spark, theirs, after=half))
    kind = "doc_id long, made string, level string, spec_hash string, impl_base64 string, manifest string, created_at long, parent string, artifacts map<string,string>"
    rows = pages.select("root", "wire", F.from_json("wire", kind).alias("r"))
    row = {"root": F.col("root")} | {k: F.col("r")[k] for k in ("spec_hash", "impl_base64", "manifest", "level", "created_at", "parent", "artifacts")}
    rows = cut(rows.withColumn("errors", C.wire_errors(row, F.col("r")["made"])))
    good = rows.where(F.size("errors") == 0)
    catalogue.append(good.groupBy("root").agg(F.min("wire").alias("wire")), ours)
    told = rows.agg(F.count("*").alias("exported"), F.count_if(F.size("errors") > 0).alias("refused"))
    return told.join(catalogue.read(spark, ours).agg(F.count("*").alias("stored"), F.min("root").alias("first_root"), F.max("root").alias("last_root")), F.lit(True))


@query("WITH d AS (SELECT doc_id, sha256(text) AS root, source FROM documents), f AS (SELECT DISTINCT root, source FROM d WHERE doc_id % 2 = 0), k AS (SELECT DISTINCT root FROM d WHERE doc_id % 2 = 1 OR doc_id % 3 = 0) SELECT source, count(*) AS missing, min(root) AS first_root FROM f WHERE root NOT IN (SELECT root FROM k) GROUP BY source UNION ALL SELECT NULL, count(*), NULL FROM k WHERE root NOT IN (SELECT root FROM f)")
def verify_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", R.sha(F.col("text")).alias("root"), "source")
    return R.subset_report(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 or doc_id % 3 = 0"), "root", "source")


@query(f"WITH {EVENTS}, a AS (SELECT *, (t - min(t) OVER (PARTITION BY session)) // 86400000 AS tick FROM e), n AS (SELECT *, (row_number() OVER (PARTITION BY session, tick ORDER BY t, seq) - 1) // 2 AS part FROM a) SELECT session, tick::BIGINT AS tick, part::INT AS part, count(*) AS n, max(t) AS sent_at, arg_min(outcome, (t, seq)) AS first_outcome FROM n GROUP BY session, tick, part")
def envelope_ticks(spark, sf_dir):
    """Batches of two events at most, flushed once a day."""
    rows = jsonl.ticks(events(spark, sf_dir).select("session", "t", "seq", "outcome", "tool"), 86_400, 2)
    get = lambda path: F.get_json_object("body", path)
    return rows.select("session", "tick", "part", "n", get("$.sentAt").cast("long").alias("sent_at"), get("$.events[0].outcome").alias("first_outcome"))


@query(f"WITH {EVENTS}, f AS (SELECT outcome AS name, count(*) AS n, max(t) AS modified FROM e GROUP BY 1) SELECT name, n, modified, row_number() OVER (ORDER BY modified DESC, name)::INT AS position FROM f")
def file_listing(spark, sf_dir):
    """Files (here outcomes) with their counts, the newest first."""
    return jsonl.listing(events(spark, sf_dir).select(F.col("outcome").alias("name"), F.col("t").alias("modified")))


@query(f"WITH {KNN10}, r AS (SELECT query_id, id, round(1 - distance + (b.p_type = a.p_type)::INT, 6) AS score, rank, CASE b.p_partkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'go' ELSE 'ts' END AS lang, CASE WHEN b.p_size % 3 = 0 THEN 'no' WHEN b.p_size % 3 = 1 THEN 'yes' END AS s FROM t JOIN part a ON a.p_partkey = query_id JOIN part b ON b.p_partkey = id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM r), k AS (SELECT * FROM o WHERE NOT (lang = 'py' AND coalesce(s, '') = 'no')) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank, CASE lang WHEN 'ts' THEN NULL WHEN 'go' THEN 'unknown' ELSE coalesce(s, 'unknown') END AS lowerable FROM k")
def intent_query(spark, sf_dir):
    """Neighbours, ranked again by structural match, then filtered by what the target can hold; ranks close up."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("q_type"))
    k = F.col("p_partkey") % 4
    status = F.when(F.col("p_size") % 3 == 0, "no").when(F.col("p_size") % 3 == 1, "yes")
    have = part.select(F.col("p_partkey").alias("id"), "p_type", F.when(k == 0, "py").when(k == 1, "go").otherwise("ts").alias("target"), status.alias("s"))
    ranked = M.reranked(top10(spark, sf_dir).join(asked, "query_id").join(have, "id"), F.col("p_type") == F.col("q_type"))
    kept = M.lowerable(ranked, F.col("s"), F.col("target"))
    return L.listed(kept.withColumnRenamed("rank", "place"), "query_id", ["place"], "rank").select("query_id", "id", "score", "rank", "lowerable")


@query("WITH c AS (SELECT o_orderkey AS claim, o_custkey % 50 AS bounty FROM orders WHERE o_orderstatus <> 'P'), t AS (SELECT bounty, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) AS total FROM lineitem JOIN c ON claim = l_orderkey GROUP BY bounty) SELECT bounty, valid, total, total > 0 AND 3 * valid >= 2 * total AS accepted FROM t")
def claim_tally(spark, sf_dir):
    """Attestations joined to the claims of a bounty, then counted."""
    claims = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("claim"), (F.col("o_custkey") % 50).alias("bounty"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), "l_returnflag").join(claims, "claim")
    return L.tally(rows, ["bounty"], F.col("l_returnflag") != "R")


@query(f"WITH {_TURNS}, b AS (SELECT conv_id, raw, turn % 3 = 0 AS h FROM t) SELECT conv_id, count(*) AS blocks, count(*) FILTER (h) AS hits, round(count(*) FILTER (h) / count(*), 6) AS hit_rate, round(sum(CASE WHEN h THEN raw ELSE 0 END) / nullif(sum(raw), 0), 6) AS covered_share, sum(CASE WHEN h THEN 45 ELSE raw END)::BIGINT AS spent FROM b GROUP BY conv_id")
def hit_simulation(spark, sf_dir):
    return B.simulated(turns(spark, sf_dir), "conv_id", F.col("turn") % 3 == 0, "raw")


@query("WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS state, o_orderstatus = 'F' AS atomised, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 14 END AS rank, (o_orderkey % 100) / 100.0 AS score FROM orders), b AS (SELECT *, NOT (atomised AND coalesce(rank <= 10, false) AND score >= 0.7) AS bad FROM r) SELECT state, count(*) AS n, round(avg(atomised::INT), 6) AS atomised, round(avg(coalesce(rank <= 10, false)::INT), 6) AS in_top, round(avg((score >= 0.7)::INT), 6) AS strong, count(*) FILTER (bad) AS failing, min(id) FILTER (bad) AS first_failing FROM b GROUP BY state")
def commit_round_trips(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("state"), (F.col("o_orderstatus") == "F").alias("atomised"), F.when(k % 9 != 0, k % 14).alias("rank"), ((k % 100) / 100).alias("score"))
    return B.round_trips(rows, ["state"])


@query(f"WITH {EVENTS}, m AS (SELECT session, max(t) AS queued_at FROM e WHERE outcome = 'synthesis-required' GROUP BY 1), c AS (SELECT session, t, outcome FROM e WHERE outcome IN ('registry-hit', 'passthrough')), d AS (SELECT session, max(t) AS t FROM c GROUP BY 1), l AS (SELECT c.session, c.t, max(outcome) AS outcome FROM c JOIN d ON c.session = d.session AND c.t = d.t GROUP BY 1, 2) SELECT m.session, queued_at, CASE WHEN l.t >= queued_at THEN outcome ELSE 'pending' END AS status FROM m LEFT JOIN l ON l.session = m.session")
def miss_queue(spark, sf_dir):
    e = events(spark, sf_dir).select("session", "t", "outcome")
    return T.queue_states(e.where("outcome = 'synthesis-required'"), e.where("outcome in ('registry-hit', 'passthrough')"), "session")
