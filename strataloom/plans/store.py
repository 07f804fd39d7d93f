"""Writes and reads of the block store over documents: a document is a block, its text's digest the root."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..operators.cluster import cut, new_path
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

BLOCKS = "b AS (SELECT sha256(text) AS root, sha256(lang || '|' || source) AS spec_hash, doc_id AS created_at, source, lang, n_chars FROM documents)"


def blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(R.sha(F.col("text")).alias("root"), R.sha(F.concat_ws("|", "lang", "source")).alias("spec_hash"), F.col("doc_id").alias("created_at"), "source", "lang", "n_chars")


@query(f"WITH {BLOCKS} SELECT root, min(created_at) AS created_at, arg_min(spec_hash, created_at) AS spec_hash FROM b GROUP BY root")
def first_wins_dedup(spark, sf_dir):
    return R.first_wins(blocks(spark, sf_dir).select("root", "created_at", "spec_hash"), ["root"], ["created_at"])


@query(f"WITH {BLOCKS} SELECT root, min(created_at) AS created_at FROM b WHERE created_at % 2 = 1 AND root NOT IN (SELECT root FROM b WHERE created_at % 2 = 0) GROUP BY root")
def first_wins_append(spark, sf_dir):
    """Odd documents arrive where even ones are stored."""
    rows = blocks(spark, sf_dir).select("root", "created_at")
    return R.first_wins(rows.where("created_at % 2 = 1"), ["root"], ["created_at"], rows.where("created_at % 2 = 0"))


@query(f"WITH {BLOCKS} SELECT source, lang, max(created_at) AS created_at, arg_max(root, created_at) AS root FROM b GROUP BY source, lang")
def last_wins_upsert(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("source", "lang", "created_at", "root")
    return R.last_wins(rows.where("created_at % 3 != 0"), rows.where("created_at % 3 = 0"), ["source", "lang"], ["created_at"])


@query(f"WITH {BLOCKS} SELECT DISTINCT spec_hash FROM b")
def distinct_specs(spark, sf_dir):
    return blocks(spark, sf_dir).select("spec_hash").distinct()


@query(f"WITH {BLOCKS}, u AS (SELECT DISTINCT root FROM b), p AS (SELECT root FROM u WHERE root > '8' ORDER BY root LIMIT 51) SELECT root, (SELECT count(*) > 50 FROM p) AS more FROM (SELECT root FROM p ORDER BY root LIMIT 50)")
def keyset_page(spark, sf_dir):
    return R.page(blocks(spark, sf_dir).select("root").distinct(), "root", "8", 50)


@query(f"WITH {BLOCKS} SELECT substr(root, 1, 2) AS shard, count(DISTINCT root) AS blocks, count(*) AS rows, min(created_at) AS first_seen FROM b GROUP BY 1")
def catalog_shards(spark, sf_dir):
    """The catalog by the first two digits of the root, as a keyed table's folders."""
    return blocks(spark, sf_dir).groupBy(F.substring("root", 1, 2).alias("shard")).agg(F.count_distinct("root").alias("blocks"), F.count("*").alias("rows"), F.min("created_at").alias("first_seen"))


@query("""WITH r AS (SELECT DISTINCT sha256(text) AS root FROM documents), a AS (SELECT sha256(d.text) AS root, p.url AS path_url, p.html FROM documents d JOIN pages p ON p.page_id = d.doc_id)
SELECT r.root, coalesce(max(CASE WHEN path_url LIKE 'http://%' THEN sha256(path_url) END), sha256('')) AS plain_hash, coalesce(max(CASE WHEN path_url LIKE 'https://%' THEN sha256(path_url) END), sha256('')) AS secure_hash
FROM r LEFT JOIN a ON r.root = a.root GROUP BY r.root""")
def manifest_export(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", R.sha(F.col("text")).alias("root"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("url").startswith("http://"), "plain").when(F.col("url").startswith("https://"), "secure").alias("path"), F.col("url").alias("bytes"))
    artifacts = d.join(pages, "doc_id").select("root", "path", "bytes")
    return R.manifest(d.select("root").distinct(), artifacts, {"plain_hash": "plain", "secure_hash": "secure"})


@query(f"WITH {BLOCKS} SELECT root, created_at FROM b WHERE created_at % 4 != 0 ORDER BY created_at, root LIMIT 100")
def unsubmitted_queue(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("submitted_at", F.when(F.col("created_at") % 4 == 0, F.col("created_at")))
    return R.unsubmitted(rows, 100).select("root", "created_at")


@query("WITH o AS (SELECT source, doc_id, n_chars FROM documents) SELECT source, doc_id, CASE WHEN source IN (SELECT DISTINCT source FROM o WHERE doc_id % 50 = 0) THEN n_chars + 1 ELSE n_chars END AS length FROM o WHERE doc_id % 50 = 0 OR source NOT IN (SELECT DISTINCT source FROM o WHERE doc_id % 50 = 0)")
def replace_occurrences(spark, sf_dir):
    """The occurrences of every source that a new scan names are replaced by the scan's."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("length"))
    return R.replaced(rows, rows.where("doc_id % 50 = 0").withColumn("length", F.col("length") + 1), ["source"])


@query("SELECT doc_id, doc_id % 16 AS part, sha256(CASE WHEN doc_id % 16 IN (3, 7) THEN text || '!' ELSE text END) AS content_hash, doc_id % 16 IN (3, 7) AS rewritten FROM documents")
def rewritten_sources(spark, sf_dir):
    """A stored table whose changed files are written anew, by partition; partitions without a change keep their files."""
    path = new_path(spark, "sources")
    rows = lambda text: table(spark, sf_dir, "documents").select("doc_id", R.sha(text).alias("content_hash"))
    part = F.col("doc_id") % 16
    R.rewrite(rows(F.col("text")), path, ["doc_id"], "content_hash", part)
    before = cut(spark.read.parquet(path).select("_part", F.input_file_name().alias("file")).distinct())
    changed = F.concat(F.col("text"), F.when(part.isin(3, 7), "!").otherwise(""))
    R.rewrite(rows(changed), path, ["doc_id"], "content_hash", part)
    now = spark.read.parquet(path).withColumn("file", F.input_file_name())
    return now.join(before.withColumn("_same", F.lit(True)), ["_part", "file"], "left").select("doc_id", F.col("_part").cast("long").alias("part"), "content_hash", F.col("_same").isNull().alias("rewritten"))


@query("SELECT source, doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 5 = 0")
def changed_sources(spark, sf_dir):
    """Files whose content hash isn't the stored one; every fifth stored hash is out of date."""
    now = table(spark, sf_dir, "documents").select("source", "doc_id", R.sha(F.col("text")).alias("content_hash"))
    stored = now.withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return R.changed(now, stored, ["source", "doc_id"], "content_hash")


@query("SELECT p_partkey AS partkey, count(*) FILTER (l_returnflag <> 'R') AS passing, count(l_partkey) AS runs, max(l_shipdate) AS last_run, count(*) FILTER (l_returnflag <> 'R') > 0 AS verified FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def provenance(spark, sf_dir):
    """Passing runs per block and whether any run passed; blocks without runs are unverified."""
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(F.count_if(F.col("l_returnflag") != "R").alias("passing"), F.count("*").alias("runs"), F.max("l_shipdate").alias("last_run"))
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey")).join(runs, "partkey", "left")
    passing = F.coalesce("passing", F.lit(0))
    return out.select("partkey", passing.alias("passing"), F.coalesce("runs", F.lit(0)).alias("runs"), "last_run", (passing > 0).alias("verified"))


_RANGES = "r AS (SELECT l_suppkey AS supplier, l_shipdate::DATE AS a, l_shipdate::DATE + 3 AS z, count(*) AS k FROM lineitem GROUP BY ALL), o AS (SELECT *, max(z) OVER (PARTITION BY supplier ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r), i AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM o), m AS (SELECT supplier, min(a) AS a, max(z) AS z, sum(k)::BIGINT AS n FROM i GROUP BY supplier, island)"


def ranges(spark, sf_dir):
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), day.alias("a"), F.date_add(day, 3).alias("z"))


@query(f"WITH {_RANGES} SELECT supplier, a, z, n FROM m")
def interval_merge(spark, sf_dir):
    return R.merged_intervals(ranges(spark, sf_dir), ["supplier"], "a", "z")


@query(f"WITH {_RANGES}, g AS (SELECT supplier, z AS gap_start, lead(a) OVER (PARTITION BY supplier ORDER BY a) AS gap_end FROM m) SELECT * FROM g WHERE gap_end IS NOT NULL")
def interval_gaps(spark, sf_dir):
    return R.gaps(ranges(spark, sf_dir), ["supplier"], "a", "z")


@query("""WITH b AS (SELECT doc_id FROM documents), c AS (SELECT vec_id AS doc_id FROM embeddings)
SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'no_vector' WHEN b.doc_id IS NULL THEN 'no_card' ELSE 'both' END AS state FROM b FULL JOIN c ON b.doc_id = c.doc_id""")
def consistency_check(spark, sf_dir):
    """Cards and vectors by id: which side lacks the other."""
    return R.consistency(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query(r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{9,}') AS ws, text FROM documents), c AS (SELECT doc_id, text, greatest(0, strpos(text, ws[1]) - 1) AS a, greatest(0, strpos(text, ws[1]) - 1) + coalesce(length(ws[1]), 0) AS z FROM r)
SELECT doc_id, sha256(substr(text, 1, a) || chr(0) || substr(text, z + 1)) AS uncovered, (a > 0)::INT + (z < length(text))::INT AS parts FROM c""")
def uncovered_text(spark, sf_dir):
    """What the shards of a source don't cover: here a document's first long word is the only shard."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    word = F.regexp_extract("text", r"[A-Za-z]{9,}", 0)
    start = F.greatest(F.lit(0), F.instr("text", word) - 1)
    shards = d.where(word != "").select("doc_id", start.alias("a"), (start + F.length(word)).alias("z"))
    found = R.uncovered(d, shards, "doc_id", "text", "a", "z")
    joined = F.when(F.size("glue") == 1, F.when(F.col("glue")[0]["a"] == 0, F.concat(F.col("glue")[0]["text"], F.lit("\0"))).otherwise(F.concat(F.lit("\0"), F.col("glue")[0]["text"]))).otherwise(F.array_join(F.transform("glue", lambda g: g["text"]), "\0"))
    bare = F.when(F.size("glue") == 0, F.lit("\0")).otherwise(joined)
    whole = ~F.col("text").rlike(r"[A-Za-z]{9,}")
    return found.join(d, "doc_id").select("doc_id", F.sha2(F.when(whole, F.concat(F.lit("\0"), "text")).otherwise(bare).cast("binary"), 256).alias("uncovered"), F.size("glue").alias("parts"))
