"""Point reads, exports, caches, validations, projections and rerankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import ledger as L
from ..operators import matching as M
from ..operators import registry as R
from ..operators import validation as C
from ..operators.blocks import positions
from ..operators.cluster import cut
from .discovery import KNN10, top10
from .registering import slice_of, table
from .store import BLOCKS, blocks

QUERIES, SQL, query = slice_of()


@query("WITH a AS (SELECT o_orderkey AS root, l_linenumber AS position, l_shipdate AS at, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT o_orderkey AS root, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY position, l_partkey), '') AS artifacts FROM orders LEFT JOIN a ON root = o_orderkey GROUP BY o_orderkey")
def hydrated_blocks(spark, sf_dir):
    """Every block with its artifacts in declared order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("root")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root")).join(rows, "root", "left")
    return out.select("root", F.coalesce(F.array_join(F.transform("a", lambda x: x["l_partkey"].cast("string")), ","), F.lit("")).alias("artifacts"))


@query(f"WITH {BLOCKS} SELECT root, created_at FROM b WHERE spec_hash = sha256('en|src5') ORDER BY created_at, root")
def find_by_hash(spark, sf_dir):
    wanted = R.sha(F.lit("en|src5"))
    return blocks(spark, sf_dir).where(F.col("spec_hash") == wanted).orderBy("created_at", "root").select("root", "created_at")


@query("""WITH s AS (SELECT lang || '|' || source AS spec, min(sha256(text)) AS root, min(doc_id) AS vec FROM documents GROUP BY 1), v AS (SELECT vec_id FROM embeddings)
SELECT spec, root, CASE WHEN vec IN (SELECT vec_id FROM v) THEN 'ok' ELSE 'no_vector' END AS state FROM s""")
def atom_index(spark, sf_dir):
    """One representative per specification (smallest root) and whether it has a vector."""
    d = table(spark, sf_dir, "documents")
    s = d.groupBy(F.concat_ws("|", "lang", "source").alias("spec")).agg(F.min(R.sha(F.col("text"))).alias("root"), F.min("doc_id").alias("vec_id"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(1).alias("has"))
    return s.join(v, "vec_id", "left").select("spec", "root", F.when(F.col("has").isNull(), "no_vector").otherwise("ok").alias("state"))


@query("SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 5) AS norm, round(list_sum([x::DOUBLE FOR x IN embedding]), 5) AS total, len(embedding)::INT AS dims FROM embeddings")
def embedding_export(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("vec_id", F.round(F.sqrt(square), 5).alias("norm"), F.round(total, 5).alias("total"), F.size("embedding").alias("dims"))


@query("WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT DISTINCT key, doc_id % 10 = 0 AS damaged FROM k WHERE doc_id % 2 = 0), h AS (SELECT key, bool_and(damaged) AS damaged FROM c GROUP BY key) SELECT substr(k.key, 1, 1) AS shard, count(*) FILTER (NOT coalesce(damaged, true)) AS hits, count(*) FILTER (coalesce(damaged, true)) AS misses FROM k LEFT JOIN h ON k.key = h.key GROUP BY 1")
def intent_cache(spark, sf_dir):
    """Lookups in a keyed cache: absent and damaged entries are misses."""
    d = table(spark, sf_dir, "documents").select("doc_id", R.sha(F.col("text")).alias("key"))
    cache = d.where("doc_id % 2 = 0").select("key", F.col("doc_id").alias("value"))
    rows = R.looked_up(d, cache, "key", "value", F.col("value") % 10 != 0)
    return rows.groupBy(F.substring("key", 1, 1).alias("shard")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("WITH d AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'py' WHEN 'de' THEN 'go' WHEN 'es' THEN 'rs' ELSE 'ts' END AS l, CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 2 THEN 'no' END AS s FROM documents) SELECT doc_id, CASE WHEN l = 'ts' THEN NULL WHEN l IN ('go', 'rs') THEN 'unknown' ELSE coalesce(s, 'unknown') END AS lowerable FROM d WHERE l <> 'py' OR coalesce(s, '') <> 'no'")
def lowerability_filter(spark, sf_dir):
    """Four languages stand for the targets; the status of a block comes from its id."""
    k = F.col("doc_id") % 3
    target = F.when(F.col("lang") == "fr", "py").when(F.col("lang") == "de", "go").when(F.col("lang") == "es", "rs").otherwise("ts")
    return M.lowerable(table(spark, sf_dir, "documents"), F.when(k == 0, "yes").when(k == 2, "no"), target).select("doc_id", "lowerable")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) NOT BETWEEN 1 AND 200 THEN 'behavior' END, CASE WHEN doc_id % 5 = 0 THEN 'source_hash' END, CASE WHEN doc_id % 7 = 0 THEN 'schema_version' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents")
def intent_card_validation(spark, sf_dir):
    digest = F.substr(R.sha(F.col("text")), F.lit(1), F.when(F.col("doc_id") % 5 == 0, 63).otherwise(64))
    broken = C.card_errors(F.col("text"), digest, F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(broken, ",").alias("broken"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'L3' WHEN 1 THEN 'L1' ELSE 'L0' END AS level FROM part")
def proof_level(spark, sf_dir):
    """Level by the first proof of a manifest: lean or coq is L3, smt L1, else L0."""
    k = F.col("p_size") % 4
    kinds = F.when(k == 0, '{"artifacts":[{"kind":"property"},{"kind":"lean"},{"kind":"smt"}]}').when(k == 1, '{"artifacts":[{"kind":"smt"},{"kind":"coq"}]}').when(k == 2, '{"artifacts":[{"kind":"property"}]}').otherwise("{}")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.proof_level(kinds).alias("level"))


@query("SELECT doc_id, left(sha256(text), 8) AS address, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), '. ')[1] AS behavior, '(' || lang || ') => ' || source AS signature, array_to_string(string_split(text, chr(10))[1:3], '|') AS guarantees, len(string_split(text, chr(10)))::INT AS n FROM documents")
def evidence_projection(spark, sf_dir):
    """Short address, first sentence, signature, the first three guarantees and their number."""
    return table(spark, sf_dir, "documents").select("doc_id", *R.evidence(F.col("text"), F.col("lang"), F.col("source"), R.sha(F.col("text"))))


@query(f"WITH {KNN10}, r AS (SELECT query_id, id, round(1 - distance + (b.p_type = a.p_type AND b.p_size >= a.p_size)::INT, 6) AS score, rank FROM t JOIN part a ON a.p_partkey = query_id JOIN part b ON b.p_partkey = id) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS rank FROM r")
def intent_rerank(spark, sf_dir):
    """Neighbours by 1 - distance plus 1 for a structural match: the asked output type, and no weaker rank."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.array("p_type").alias("q_out"), F.col("p_size").alias("q_rank"))
    have = part.select(F.col("p_partkey").alias("id"), F.array("p_type").alias("out"), F.col("p_size").alias("own_rank"))
    none = F.array().cast("array<string>")
    why = M.reasons(none, none, F.col("q_out"), F.col("out"), none, none, F.col("q_rank"), F.col("own_rank"), F.lit(0), F.lit(0))
    rows = top10(spark, sf_dir).join(asked, "query_id").join(have, "id")
    return M.reranked(rows, F.size(why) == 0).select("query_id", "id", "score", "rank")


@query(f"WITH {KNN10}, l AS (SELECT query_id, id, rank, score, lead(score) OVER w AS s2, lead(id) OVER w AS id2 FROM t WINDOW w AS (PARTITION BY query_id ORDER BY rank)) SELECT query_id, CASE WHEN score - s2 > 0.02 OR s2 IS NULL THEN 'none' WHEN id % 5 > id2 % 5 THEN 'more_tests' ELSE 'lexicographic' END AS reason FROM l WHERE rank = 1")
def tiebreak_reason(spark, sf_dir):
    """Why the first of two close candidates leads: more tests (id % 5), else its name."""
    return M.tiebreaks(top10(spark, sf_dir), F.col("id") % 5)


@query("SELECT l_orderkey AS block, string_agg(DISTINCT s_name || '#' || l_partkey, ',' ORDER BY s_name || '#' || l_partkey) AS refs FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def foreign_refs(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = table(spark, sf_dir, "lineitem").join(names, "l_suppkey")
    return R.reference_lists(rows.withColumnRenamed("l_orderkey", "block"), "block", F.col("s_name"), F.col("l_partkey"))


@query("WITH i AS (SELECT p_name AS stem, min(p_partkey) AS id FROM part GROUP BY 1), c AS (SELECT string_split(p_name, ' ')[1] || upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) AS stem, min(p_partkey) AS id FROM part GROUP BY 1), w AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[1] || upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) END AS stem FROM part UNION SELECT 'missing') SELECT w.stem, coalesce(i.id, c.id) AS id FROM w LEFT JOIN i ON i.stem = w.stem LEFT JOIN c ON c.stem = w.stem")
def stem_lookup(spark, sf_dir):
    """Import stems resolved by name, else by camel-case name."""
    p = table(spark, sf_dir, "part")
    camel = X.camel(F.replace("p_name", F.lit(" "), F.lit("-")))
    asked = p.select(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(camel).alias("stem")).union(spark.createDataFrame([("missing",)], "stem string")).distinct()
    index = p.select(F.col("p_name").alias("stem"), "p_name", F.col("p_partkey").alias("id"))
    return R.resolved_stems(asked, index, "stem", camel, "id")


@query("SELECT l_returnflag AS flag, count(*) FILTER (l_linestatus = 'F' AND l_quantity >= 2 * 10 AND epoch_ms(l_shipdate) <= 891388800000 AND epoch_ms(l_shipdate) >= 883612800000) AS admissible, count(*) AS filed FROM lineitem GROUP BY 1")
def retraction_filing(spark, sf_dir):
    """Retractions that may be filed: a valid claim, twice the stake, within 90 days of the reveal."""
    t = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000")
    start = 883612800000
    ok = L.may_retract(F.when(F.col("l_linestatus") == "F", "VALID"), F.col("l_quantity"), F.lit(10), t, F.lit(start))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(ok).alias("admissible"), F.count("*").alias("filed"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN '' ELSE sha256(text) END, '') = '' AS was_missing, sha256(text) AS canonical_hash FROM documents")
def hash_backfill(spark, sf_dir):
    """The canonical hash where it was empty."""
    stored = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "").otherwise(R.sha(F.col("text"))).alias("canonical_hash"))
    return R.backfilled(stored.withColumn("was_missing", F.col("canonical_hash") == ""), "canonical_hash", R.sha(F.col("text"))).drop("text")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 1 THEN p_size END AS size, CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS brand FROM part")
def schema_migration(spark, sf_dir):
    """Old rows without later columns and new rows with them, under one schema."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return R.migrated(p.where("id % 2 = 0").select("id", "name"), p.where("id % 2 = 1"), 1, 2).select("id", "name", "size", "brand")


@query("SELECT source, doc_id, left(sha256(text), 6) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, count(*) OVER (PARTITION BY source) AS n FROM documents")
def source_glue(spark, sf_dir):
    """The pieces of each source in order, a row each with its place: one range sort over all sources, of which the first place of each is taken off."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.left(R.sha(F.col("text")), F.lit(6)).alias("h"))
    placed = positions(rows, [F.col("source"), F.col("doc_id")], cut, "_at")
    first = placed.groupBy("source").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))  # a row a source
    return placed.join(first, "source").select("source", "doc_id", "h", (F.col("_at") - F.col("_first") + 1).alias("position"), "n")


@query("WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'foreign_leaf' WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) THEN 'pointer' WHEN length(text) < 200 THEN 'glue' ELSE 'novel_glue' END AS kind, length(text) AS bytes FROM documents) SELECT kind, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM f GROUP BY kind")
def slice_plan(spark, sf_dir):
    """Fragments by what the store knows of them, with their sizes."""
    d = table(spark, sf_dir, "documents").select("doc_id", R.sha(F.col("text")).alias("h"), F.length("text").alias("bytes"))
    rows = R.slice_kinds(d, d.where("doc_id % 3 = 0"), "h", F.col("doc_id") % 7 == 0, F.col("bytes"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("WITH s AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, arg_max(length(text), turn) AS last_length, max(turn) AS last_turn, count(*) FILTER (regexp_matches(text, '\\?$')) AS questions FROM s GROUP BY conv_id")
def last_state(spark, sf_dir):
    """The status of each key is its last outcome."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.length(t).cast("long"), "turn").alias("last_length"), F.max("turn").alias("last_turn"), F.count_if(t.rlike(r"\?$")).alias("questions"))
