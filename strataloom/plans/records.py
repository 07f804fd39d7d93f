"""Stored blocks, wire rows, source texts, JSON texts and walks, each beside the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import json_texts as J
from ..functions import scalars as X
from ..operators import benchmarks as B
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import registry as R
from ..operators import sources as SRC
from ..operators import texts as T
from ..operators import trees as W
from ..operators import validation as C
from ..operators import vectors as V
from ..operators.blocks import best, spread
from ..operators.cluster import new_path
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

_ROOT = "sha256(unhex(sha256(lang || '|' || source)) || unhex(sha256(text)) || unhex(sha256(encode('{}') || unhex(sha256(lang)) || unhex(sha256(source)))))"


def block_rows(spark, sf_dir):
    """Documents as blocks; every eleventh names another root, every thirteenth is foreign and half of those lack their export."""
    d = table(spark, sf_dir, "documents")
    root = R.block_root(R.sha(F.concat_ws("|", "lang", "source")), F.col("text"), F.lit("{}"), F.array("lang", "source"))
    k = F.col("doc_id")
    return d.select("doc_id", F.when(k % 11 == 0, R.sha(F.lit("other"))).otherwise(root).alias("root"), root.alias("made"), F.when(k % 13 == 0, "foreign").otherwise("local").alias("kind"), F.when(k % 13 == 0, F.lit("pkg")).alias("pkg"), F.when(k % 26 == 0, F.lit("run")).alias("export"))


@query(f"""WITH b AS (SELECT doc_id, {_ROOT} AS made FROM documents), r AS (SELECT doc_id, made, CASE WHEN doc_id % 11 = 0 THEN sha256('other') ELSE made END AS root FROM b),
n AS (SELECT * FROM r WHERE doc_id % 3 <> 0), o AS (SELECT *, CASE WHEN root <> made THEN 'integrity_failed' WHEN doc_id % 13 = 0 AND doc_id % 26 <> 0 THEN 'foreign_incomplete' END AS bad FROM n),
f AS (SELECT root, min(doc_id) AS first FROM o WHERE bad IS NULL GROUP BY root)
SELECT o.doc_id, coalesce(bad, CASE WHEN o.root IN (SELECT root FROM r WHERE doc_id % 3 = 0) OR o.doc_id <> first THEN 'skipped' ELSE 'inserted' END) AS outcome FROM o LEFT JOIN f ON f.root = o.root""")
def stored_outcomes(spark, sf_dir):
    """Two thirds of the blocks arrive where the rest is stored."""
    rows = block_rows(spark, sf_dir)
    return R.stored(rows.where("doc_id % 3 != 0"), rows.where("doc_id % 3 = 0"), F.col("made"), ["doc_id"]).select("doc_id", "outcome")


@query("SELECT 'documents' AS name, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS last FROM documents UNION ALL SELECT 'vectors', count(*), min(vec_id), max(vec_id) FROM embeddings")
def snapshot_export(spark, sf_dir):
    """Two tables written as a snapshot, opened again with the model's check, and counted."""
    folder = new_path(spark, "snapshot")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit("hash-64").alias("model"))
    R.snapshot({"documents": table(spark, sf_dir, "documents").select("doc_id", "lang"), "vectors": v}, folder)
    dims = v.select(F.size("embedding")).limit(1).collect()
    store = R.open_store(spark, folder, "hash-64", dims[0][0]) if dims else {}
    count = lambda name, key: store[name].agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    return G.cut(count("documents", "doc_id").unionByName(count("vectors", "vec_id")))


@query("WITH k AS (SELECT doc_id, substr(sha256(text), 1, 12) AS key FROM documents), c AS (SELECT key, min(key || '=' || doc_id) AS value FROM k WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0 GROUP BY key) SELECT doc_id, value, value IS NOT NULL AS hit FROM k LEFT JOIN c ON c.key = k.key")
def cache_lookup(spark, sf_dir):
    """Half of the keys are cached; every tenth entry is damaged and so a miss."""
    k = table(spark, sf_dir, "documents").select("doc_id", F.left(R.sha(F.col("text")), F.lit(12)).alias("key"))
    value = F.when(F.col("doc_id") % 10 == 0, "damaged").otherwise(F.concat("key", F.lit("="), F.col("doc_id").cast("string")))
    return R.looked_up(k, k.where("doc_id % 2 = 0").select("key", value.alias("value")), "key", "value", F.col("value").startswith(F.concat("key", F.lit("=")))).select("doc_id", "value", "hit")


_BYTES = "[(('0x' || substr(h, 2 * i + 1, 2))::INT - 128) / 128.0 FOR i IN range({dims})]"


@query(f"""WITH h AS (SELECT p_partkey AS id, array_to_string([sha256(p_name || '|' || i) FOR i IN range(2)], '') AS h FROM part), r AS (SELECT id, {_BYTES.format(dims=48)} AS raw FROM h), n AS (SELECT id, raw, sqrt(list_sum([x * x FOR x IN raw])) AS norm FROM r)
SELECT id, len(raw)::BIGINT AS dims, round(raw[1] / norm, 6) AS first, round(raw[48] / norm, 6) AS last, round(list_sum([x / norm FOR x IN raw]), 6) AS total, id % 3 <> 0 AS resized, id % 3 = 0 AS added FROM n""")
def rebuilt_vectors(spark, sf_dir):
    """Vectors made anew from names by the offline provider; a third was missing, the others had 64 components."""
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    old = cards.where("id % 3 != 0").select("id", X.hash_embedding(F.col("text"), 64).alias("embedding"))
    rows = R.rebuilt(old, cards, lambda c: X.hash_embedding(c, 48), "id", "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[47], 6).alias("last"), F.round(total, 6).alias("total"), "resized", "added")


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 40 = 0)")
def unlisted_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return R.unlisted(d, d.where("doc_id % 40 = 0").distinct(), "source")


@query("SELECT l_orderkey AS bounty, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey)::INT AS position FROM lineitem")
def listed_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bounty"), F.col("l_linenumber").alias("line"), "l_shipdate", "l_partkey")
    return L.listed(rows, "bounty", ["l_shipdate", "line", "l_partkey"]).select("bounty", "line", "position")


@query("SELECT o_orderkey AS id, '{\"bounty\":' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',\"note\":\"' || o_orderpriority || '\"' END || ',\"valid\":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || '}' AS body FROM orders")
def attestation_bodies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    body = L.attestation_json({"valid": F.col("o_orderstatus") == "F", "note": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")), "bounty": F.col("o_orderkey")})
    return o.select(F.col("o_orderkey").alias("id"), body.alias("body"))


_NOW = 820454400000
_CLAIMS = f"""c AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS created, (1 + o_orderkey % 72) * 3600000 AS commit_ms, (1 + o_orderkey % 12) * 1800000 AS reveal_ms, epoch_ms(o_orderdate) + (o_orderkey % 90) * 3600000 AS committed FROM orders),
k AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE created + commit_ms + (id % 5) * 900000 END AS revealed, {_NOW} AS now FROM c)"""


@query(f"""WITH {_CLAIMS} SELECT id, CASE WHEN committed <= created + commit_ms AND committed <= now THEN CASE WHEN coalesce(revealed >= created + commit_ms AND revealed <= created + commit_ms + reveal_ms AND revealed <= now, false) THEN 'REVEALED' WHEN now >= created + commit_ms + reveal_ms THEN 'LAPSED' ELSE 'COMMITTED' END END AS state,
now >= created AND now <= created + commit_ms AND id % 7 <> 0 AS may_commit, now >= created + commit_ms AND now <= created + commit_ms + reveal_ms AND id % 5 <> 0 AS may_reveal FROM k""")
def claim_states(spark, sf_dir):
    """The life of a claim at one time: committed, revealed, lapsed, or never in time."""
    created = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000")
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), created.alias("created"), ((1 + k % 72) * 3_600_000).alias("commit_ms"), ((1 + k % 12) * 1_800_000).alias("reveal_ms"))
    rows = rows.withColumn("committed", F.col("created") + (F.col("id") % 90) * 3_600_000).withColumn("revealed", F.when(F.col("id") % 4 != 0, F.col("created") + F.col("commit_ms") + (F.col("id") % 5) * 900_000))
    now, c, m, r = F.lit(_NOW), F.col("created"), F.col("commit_ms"), F.col("reveal_ms")
    digest = R.sha(F.col("id").cast("string"))
    taken = F.when(F.col("id") % 7 == 0, F.lit("short")).otherwise(digest)
    told = F.when(F.col("id") % 5 == 0, R.sha(F.lit("x"))).otherwise(digest)
    return rows.select("id", L.claim_state(now, c, m, r, F.col("committed"), F.col("revealed")).alias("state"), L.may_commit(now, c, m, taken).alias("may_commit"), L.may_reveal(now, c, m, r, digest, told).alias("may_reveal"))


@query("SELECT l_returnflag AS arm, median(l_discount) AS median_rate, min(l_discount) AS least_rate, max(l_discount) AS greatest_rate, max(l_linenumber) AS most_escapes FROM lineitem GROUP BY 1")
def refusal_summary(spark, sf_dir):
    return B.refusals(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "arm"), ["arm"], "l_discount", "l_linenumber")


@query("""WITH m AS (SELECT p_brand AS suite, CASE p_size % 4 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'killed' ELSE 'survived' END AS o, p_type AS reason FROM part), t AS (SELECT suite, count(*) FILTER (o <> 'equivalent') AS non_equivalent, count(*) FILTER (o = 'killed') AS killed FROM m GROUP BY 1),
s AS (SELECT suite, reason, count(*) AS n FROM m WHERE o = 'survived' GROUP BY ALL), j AS (SELECT suite, string_agg(reason || '=' || n, ',' ORDER BY reason) AS survivors FROM s GROUP BY 1) SELECT t.*, survivors, round(killed / nullif(non_equivalent, 0), 6) AS score FROM t LEFT JOIN j USING (suite)""")
def mutation_survivors(spark, sf_dir):
    k = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("suite"), F.when(k == 0, "equivalent").when(k == 1, "killed").otherwise("survived").alias("outcome"), F.col("p_type").alias("reason"))
    found = B.mutants(rows, ["suite"], "outcome", "reason")
    names = F.array_join(F.transform(F.map_entries("survivors"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("suite", "non_equivalent", "killed", names.alias("survivors"), "score")


@query(f"""WITH b AS (SELECT doc_id, {_ROOT} AS made FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'root' END, CASE WHEN doc_id % 7 = 0 THEN 'impl_empty' END, CASE WHEN doc_id % 11 = 0 AND doc_id % 7 <> 0 THEN 'impl_base64' END,
CASE WHEN doc_id % 9 = 0 THEN 'created_at' END, CASE WHEN doc_id % 4 = 3 THEN 'parent' END, CASE WHEN doc_id % 6 = 5 THEN 'level' END, CASE WHEN doc_id % 6 = 4 THEN 'level_unsupported' END, CASE WHEN doc_id % 8 = 7 THEN 'manifest' END, CASE WHEN doc_id % 10 = 9 THEN 'artifacts' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 2 THEN 'integrity' END], lambda x: x IS NOT NULL), ',') AS errors FROM b""")
def wire_rows(spark, sf_dir):
    """All rules of a wire row at once, broken in turn."""
    rows = block_rows(spark, sf_dir)
    k, made = F.col("doc_id"), F.col("made")
    row = {
        "root": F.when(k % 5 == 0, F.upper(made)).when(k % 3 == 2, R.sha(F.lit("y"))).otherwise(made),
        "spec_hash": R.sha(F.lit("spec")),
        "impl_base64": F.when(k % 7 == 0, "").when(k % 11 == 0, "a=b").otherwise(F.base64(F.lit("impl").cast("binary"))),
        "manifest": F.when(k % 8 == 7, '{"artifacts":[{"kind":"property"}]}').otherwise('{"artifacts":[{"kind":"property","path":"a.ts"}]}'),
        "level": F.when(k % 6 == 5, "L9").when(k % 6 == 4, "L2").otherwise("L0"),
        "created_at": F.when(k % 9 == 0, -1).otherwise(k),
        "parent": F.when(k % 4 == 3, "none"),
        "artifacts": F.when(k % 10 == 9, F.create_map(F.lit("a.ts"), F.lit("not base64!"))).otherwise(F.create_map(F.lit("a.ts"), F.lit("YQ=="))),
    }
    return rows.select("doc_id", F.array_join(C.wire_errors(row, made), ",").alias("errors"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE sha256(text) END AS root, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'L' || (doc_id % 4) END AS level FROM documents")
def wire_triplets(spark, sf_dir):
    """Rows read from wire text; every fourth has a hash that is too short."""
    root = F.when(F.col("doc_id") % 4 == 0, F.lit("12ab")).otherwise(R.sha(F.col("text")))
    wire = F.to_json(F.struct(root.alias("root"), R.sha(F.lit("s")).alias("specHash"), F.concat(F.lit("L"), (F.col("doc_id") % 4).cast("string")).alias("level")))
    t = C.triplet(wire)
    return table(spark, sf_dir, "documents").select("doc_id", t["root"].alias("root"), t["level"].alias("level"))


_SCHEMA = {
    "type": "object",
    "required": ["name", "size"],
    "properties": {
        "name": {"type": "string", "minLength": 3, "maxLength": 12, "pattern": "^[a-z ]+$"},
        "size": {"$ref": "#/$defs/size"},
        "tags": {"type": "array", "items": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "minItems": 1, "contains": {"const": "x"}, "uniqueItems": True},
        "kind": {"enum": ["a", "b", 3]},
        "price": {"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]},
    },
    "$defs": {"size": {"type": "integer", "minimum": 1, "exclusiveMaximum": 45}},
    "additionalProperties": False,
    "dependentRequired": {"price": ["kind"]},
    "not": {"required": ["kind"], "properties": {"kind": {"const": "b"}}},
    "if": {"properties": {"size": {"minimum": 30}}},
    "then": {"required": ["kind"]},
}


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, p_partkey % 7 AS k FROM part) SELECT id, length(name) BETWEEN 3 AND 12 AND size >= 1 AND size < 45
AND CASE k WHEN 0 THEN size < 30 WHEN 1 THEN (size % 2 = 0) <> (size % 3 = 0) WHEN 2 THEN false WHEN 3 THEN size < 30 WHEN 4 THEN false WHEN 5 THEN false ELSE true END AS valid FROM p""")
def schema_checks(spark, sf_dir):
    """Documents of seven forms against one schema."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    more = F.when(k == 0, "").when(k == 1, F.concat(F.lit(',"kind":"a","price":'), size)).when(k == 2, ',"kind":"b"').when(k == 3, ',"tags":["x",null]').when(k == 4, ',"tags":["x","x"]').when(k == 5, ',"extra":1').otherwise(',"kind":3')
    doc = F.concat(F.lit('{"name":"'), F.col("p_name"), F.lit('","size":'), size, more, F.lit("}"))
    return p.select(F.col("p_partkey").alias("id"), C.schema_valid(doc, _SCHEMA).alias("valid"))


_NESTED = {
    "$ref": "#/$defs/part",
    "$defs": {"part": {"type": "object", "properties": {"name": {"type": "string"}, "size": {"type": "integer", "maximum": 45}, "within": {"type": "array", "prefixItems": [{"$ref": "#/$defs/part"}, {"type": "number"}], "items": False}}, "required": ["name"], "unevaluatedProperties": False}},
}


@query("WITH p AS (SELECT p_partkey AS id, p_size AS size, p_partkey % 5 AS k, p_partkey % 4 AS deep FROM part) SELECT id, size <= 45 AND k <> 1 AND (deep = 0 OR k <> 2) AND (deep < 2 OR k <> 3) AS valid FROM p")
def schema_nested(spark, sf_dir):
    """Parts within parts, up to three deep, against a schema that recurs; faults stand on the outermost, the next, or the innermost of three levels."""
    p = table(spark, sf_dir, "part")
    k, deep, size = F.col("p_partkey") % 5, F.col("p_partkey") % 4, F.col("p_size").cast("string")
    part = lambda more: F.concat(F.lit('{"name":"'), F.col("p_name"), F.lit('"'), more, F.lit("}"))
    third = F.when(k == 3, '{"size":1}').otherwise('{"name":"x"}')
    second = F.concat(F.when(k == 2, ',"odd":1').otherwise(""), F.when(deep >= 2, F.concat(F.lit(',"within":['), third, F.lit(",2]"))).otherwise(""))
    first = F.concat(F.lit(',"size":'), size, F.when(k == 1, ',"odd":1').otherwise(""), F.when(deep >= 1, F.concat(F.lit(',"within":['), part(second), F.lit("]"))).otherwise(""))
    return C.schema_checked(p.select(F.col("p_partkey").alias("id"), part(first).alias("doc")), "id", "doc", _NESTED)


@query(r"""WITH p AS (SELECT *, p_partkey % 7 <> 0 AS fine FROM part)
SELECT p_partkey AS id, CASE WHEN fine THEN p_name || ' // .7' END AS name, CASE WHEN fine THEN p_size + 0.5 END AS size, CASE WHEN fine THEN p_partkey % 3 END::INT AS first,
CASE WHEN fine THEN 'it''s .5, /* not */ "x.5"\' END AS note, CASE WHEN fine THEN p_size + 16 END::INT AS hex FROM p""")
def json5_rows(spark, sf_dir):
    """JSON5 texts whose strings hold what looks like comments and bare points; every seventh has a text behind the value and is refused."""
    p = table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("{ // a comment \\\n name: '"), F.col("p_name"), F.lit(" // .7', size: +"), F.col("p_size").cast("string"), F.lit(".5, /* two, */ list: ["), (F.col("p_partkey") % 3).cast("string"), F.lit(', .5,], "note": "it\'s \\\n.5, /* not */ \\"x.5\\"\\\\", $hex_: 0x'),
        F.hex(F.col("p_size") + 16), F.lit(",}"), F.when(F.col("p_partkey") % 7 == 0, " 1.").otherwise(""),
    )
    r = J.from_json5(text, "name string, size double, list array<double>, note string, `$hex_` int")
    return p.select(F.col("p_partkey").alias("id"), r["name"].alias("name"), r["size"].alias("size"), r["list"][0].cast("int").alias("first"), r["note"].alias("note"), r["$hex_"].alias("hex"))


@query(r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE '{"B":1,"a":[' || CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE p_size::VARCHAR END || ',' || CASE WHEN p_partkey % 6 = 4 THEN (p_size * 100)::VARCHAR ELSE p_size || '.5' END || ',"x \"-0.50\"/\\"],"b":{"c":null,"d":true},"😀":"' || p_name || '","｡":"\u000b"}' END AS canonical FROM part""")
def canonical_texts(spark, sf_dir):
    """Nested texts in canonical form; every sixth has a number that needs an exponent and is refused."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    number = F.when(k % 6 == 5, F.concat(size, F.lit("e-9"))).when(k % 6 == 4, F.concat(size, F.lit(".0e2"))).otherwise(F.concat(size, F.lit(".50")))
    text = F.concat(F.lit('{ "｡": "\\u000B", "\\ud83d\\ude00":"'), F.col("p_name"), F.lit('", "b": {"d":true, "c":null},\n"a": ['), F.when(k % 3 == 0, "-0").otherwise(F.concat(size, F.lit(".0"))), F.lit(", "), number, F.lit(', "x \\"-0.50\\"\\/\\\\"], "B":1.0 }'))
    return p.select(k.alias("id"), J.canonical_json(text).alias("canonical"))


@query("SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN 'tilde' WHEN 3 THEN NULL WHEN 4 THEN 'seven' WHEN 5 THEN 'it''s' WHEN 6 THEN 'null' ELSE NULL END AS found FROM part")
def pointer_rows(spark, sf_dir):
    """Pointers that differ from row to row."""
    p = table(spark, sf_dir, "part")
    doc = F.concat(F.lit('{"n":{"x/y":"'), F.col("p_name"), F.lit('"},"l":[1,'), F.col("p_size").cast("string"), F.lit('],"m~n":"tilde","7":"seven","q\'\\"":["it\'s"],"none":null}'))
    pointer = F.element_at(F.array(*map(F.lit, ("/n/x~1y", "/l/1", "/m~0n", "n", "/7", "/q'\"/0", "/none", "/l/01"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), J.json_at(doc, pointer).alias("found"))


@query("""SELECT p_partkey AS id, '{' || CASE WHEN p_partkey % 2 = 0 THEN '"behavior":"' || p_name || '",' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '"errorConditions":[{"description":"' || p_type || '"}],"guarantees":[{"description":"total","id":"q0"},{"description":"' || p_brand || '","id":"q1"}],' ELSE '' END
|| '"inputs":[{"name":"arg0","type":"' || p_brand || '"},{"name":"n","type":"number"}]' || CASE WHEN p_partkey % 4 = 0 THEN ',"nonFunctional":{"purity":"pure","time":"O(' || p_size || ')"}' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ',"outputs":[{"name":"out0","type":"' || p_type || '"}]' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ',"propertyTests":[{"description":"idempotent","id":"p0"}]' ELSE '' END || '}' AS text FROM part""")
def query_texts(spark, sf_dir):
    """The text of a query card: only the dimensions that it has, keys in order."""
    k = F.col("p_partkey")
    parameter = lambda name, kind: F.struct(F.lit(name).cast("string").alias("name"), kind.alias("type"))
    every = lambda n, c: F.when(k % n == 0, c)
    text = T.query_text(
        behavior=every(2, F.col("p_name")).otherwise(""), errors=every(5, F.array("p_type")), guarantees=every(5, F.array(F.lit("total"), F.col("p_brand"))), inputs=F.array(parameter(None, F.col("p_brand")), parameter("n", F.lit("number"))),
        purity=every(4, F.lit("pure")), time=every(4, F.concat(F.lit("O("), F.col("p_size").cast("string"), F.lit(")"))), outputs=every(3, F.array(parameter(None, F.col("p_type")))), property_tests=every(7, F.array(F.lit("idempotent"))),
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("text"))


def sources(spark, sf_dir):
    """Source texts made from part names: two words a name, the size as a number. Strings and comments hold what would break rules if it were code."""
    p = table(spark, sf_dir, "part")
    a, b, n = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_")), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("2")), F.col("p_size").cast("string")
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("\r\n/**\r\n * Adds "), a, F.lit(" things.\r\n * Twice.\r\n *\r\n * @param x one\r\n */\r\nexport function "), a, F.lit("Of(x: number, y?: string): Promise<"), F.col("p_brand"), F.lit("> {\r\n  const "), a, F.lit(" = "), n, F.lit("; // the size: eval(x)\r\n  let "), b, F.lit(" = "), a, F.lit(" + 1; /* and\r\n let more: any */\r\n  const note = \"// throw 'no' \" + o."), a, F.lit(";\r\n"),
        F.when(k % 3 == 0, "  if (x) { return eval('1'); }\r\n").when(k % 3 == 1, "  for (;;) { throw 'no'; }\r\n").otherwise("  while (y as any) { Reflect.get(x, y); }\r\n"), F.lit("  { let "), a, F.lit(" = "), b, F.lit("; use("), a, F.lit("); }\r\n  return "), b, F.lit(";\r\n}\r\n"),
        F.when(k % 4 == 0, F.lit("run()\r\n")).when(k % 4 == 1, "let state = `a ${run(1)} b`\r\n").otherwise(""),
    )
    return p.select(k.alias("id"), T.normal_source(text).alias("source"))


def code(spark, sf_dir):
    return SRC.code(SRC.tokens(sources(spark, sf_dir)))


@query("""SELECT p_partkey AS id, split_part(p_name, ' ', 1) || '_Of' AS name, 'x:number,y:string' AS params, 'Promise<' || p_brand || '>' AS result, 'Adds ' || split_part(p_name, ' ', 1) || '_ things.' AS summary, 'x=one' AS described FROM part""")
def source_signatures(spark, sf_dir):
    """Name, parameters and result of exported functions, and what their comment blocks say."""
    s = SRC.signatures(sources(spark, sf_dir), code(spark, sf_dir))
    doc = SRC.documentation(F.col("doc"))
    listed = lambda c, sep, k: F.array_join(F.transform(c, lambda p: F.concat(p["name"], F.lit(sep), p[k])), ",")
    return s.select("id", "name", listed(F.col("params"), ":", "type").alias("params"), "result", doc["summary"].alias("summary"), listed(doc["params"], "=", "text").alias("described"))


@query("""SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 3 = 2 THEN 'any_type' END, CASE WHEN p_partkey % 3 = 0 THEN 'eval' END, CASE WHEN p_partkey % 3 = 2 THEN 'reflection' END, CASE WHEN p_partkey % 4 = 1 THEN 'mutable_global' END, CASE WHEN p_partkey % 3 = 1 THEN 'throw_non_error' END, CASE WHEN p_partkey % 4 = 0 THEN 'top_level_effect' END) AS broken FROM part""")
def subset_rules(spark, sf_dir):
    """The rules of the strict subset that each source breaks, by its tokens."""
    return SRC.broken_rules(code(spark, sf_dir)).select("id", F.array_join("rules", ",").alias("broken"))


@query("SELECT p_partkey AS id, 1::INT AS boundaries, p_partkey % 4 >= 2 AS single FROM part")
def atom_sources(spark, sf_dir):
    """Control-flow boundaries, and whether a source is a single typed exported function."""
    rows = code(spark, sf_dir)
    return SRC.atoms(rows, SRC.signatures(sources(spark, sf_dir), rows)).where("single is not null")


@query("""WITH t AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) || '_' AS a, p_partkey % 3 AS k, p_partkey % 4 AS m, p_size AS n, replace(p_brand, '#', ' # ') AS brand FROM part)
SELECT id, sha256('export function ' || a || 'Of ( x : number , y ? : string ) : Promise < ' || brand || ' > { const __v0 = ' || n || ' ; let __v1 = __v0 + 1 ; const __v2 = "// throw ''no'' " + o . ' || a || ' ; '
|| CASE k WHEN 0 THEN 'if ( x ) { return eval ( ''1'' ) ; }' WHEN 1 THEN 'for ( ; ; ) { throw ''no'' ; }' ELSE 'while ( y as any ) { Reflect . get ( x , y ) ; }' END || ' { let __v3 = __v1 ; use ( __v3 ) ; } return __v1 ; }' || CASE m WHEN 0 THEN ' run ( )' WHEN 1 THEN ' let __v4 = `a ${ run ( 1 ) } b`' ELSE '' END) AS digest FROM t""")
def canonical_sources(spark, sf_dir):
    """Names of locals don't matter to a source's digest, nor do comments and spacing; strings, properties and inner scopes do."""
    return SRC.canonical_sources(code(spark, sf_dir)).select("id", F.sha2(F.col("canonical").cast("binary"), 256).alias("digest"))


_TREE = "e AS (SELECT p_partkey // 8 AS a, p_partkey AS b FROM part WHERE p_partkey // 8 <> p_partkey)"


@query(f"WITH RECURSIVE {_TREE}, c AS (SELECT a, b, 1 AS hops FROM e UNION ALL SELECT c.a, e.b, hops + 1 FROM c JOIN e ON c.b = e.a), l AS (SELECT p_partkey AS node, p_size AS value FROM part WHERE p_partkey NOT IN (SELECT a FROM e)) SELECT c.a AS node, count(value) AS leaves, coalesce(sum(value), 0)::BIGINT AS total, max(hops)::INT AS height FROM c LEFT JOIN l ON l.node = c.b GROUP BY c.a")
def tree_totals(spark, sf_dir):
    """Leaves, their sum and the height below every inner node of a tree of part keys, eight a node."""
    p = table(spark, sf_dir, "part")
    e = p.select(F.expr("p_partkey div 8").alias("a"), F.col("p_partkey").alias("b")).where("a != b")
    leaves = p.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("value")).join(e.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    return W.rolled_up(e, leaves)


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT a AS root, a AS node, 0 AS depth, true AS ok FROM (SELECT DISTINCT a FROM e WHERE a NOT IN (SELECT b FROM e)) UNION ALL SELECT root, b, depth + 1, b % 5 <> 4 FROM w JOIN e ON e.a = w.node WHERE ok)
SELECT root, node, depth::INT AS depth, CASE WHEN ok THEN 'module' ELSE 'unresolved' END AS kind FROM w""")
def module_walk(spark, sf_dir):
    """All modules reached from the tree's roots; every fifth can't be resolved, and these aren't gone through."""
    p = table(spark, sf_dir, "part")
    e = p.select(F.expr("p_partkey div 8").alias("a"), F.col("p_partkey").alias("b")).where("a != b")
    roots = e.select(F.col("a").alias("node")).distinct().join(e.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
    known = p.where("p_partkey % 5 != 4").select(F.col("p_partkey").alias("node")).unionByName(roots)
    return W.walked(e, roots, known, most=None)


_CHAIN = "e AS (SELECT p_partkey AS a, lead(p_partkey) OVER o AS b, p_size AS w, lag(p_partkey) OVER o AS before, sum(p_size) OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d, p_brand, p_type, row_number() OVER o AS n FROM part WINDOW o AS (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey))"


@query(f"WITH {_CHAIN} SELECT s.a AS source, t.a AS node, (coalesce(t.d, 0) - coalesce(s.d, 0))::DOUBLE AS distance, CASE WHEN t.a <> s.a THEN t.before END AS before FROM e s JOIN e t ON s.p_brand = t.p_brand AND s.p_type = t.p_type AND t.n >= s.n WHERE s.a % 100 = 0")
def path_steps(spark, sf_dir):
    """Distances from every hundredth part and the step before each node."""
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_size"), "p_partkey")
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b"), F.col("p_size").cast("double").alias("w")).where("b is not null")
    nodes = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node"))
    return G.stepped(e, nodes).drop("hops")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id AS id, round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(q.e, v.embedding::DOUBLE[]))), 6) AS distance FROM q, embeddings v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, id, rank::INT AS rank, round(greatest(0, 1 - distance * distance / 4), 5) AS score, CASE WHEN round(greatest(0, 1 - distance * distance / 4), 5) >= 0.85 THEN 'strong' WHEN round(greatest(0, 1 - distance * distance / 4), 5) >= 0.7 THEN 'confident' WHEN round(greatest(0, 1 - distance * distance / 4), 5) >= 0.5 THEN 'weak' ELSE 'poor' END AS band FROM r WHERE rank <= 10""")
def cosine_rank(spark, sf_dir):
    """Candidates by cosine, as scores and bands."""
    e = table(spark, sf_dir, "embeddings")
    rows = V.knn(e, e.where("vec_id % 100 = 0"), 10, metric="cosine")
    score = F.round(V.score_of(F.col("distance")), 5)
    return rows.select("query_id", "id", "rank", score.alias("score"), V.band_of(score).alias("band"))


@query("SELECT p_brand AS suite, p_partkey AS id, r::INT AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('m' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 5")
def mutant_sample(spark, sf_dir):
    """Five mutants a suite, by digest, so that a larger sample holds the smaller one."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("suite"), F.col("p_partkey").alias("id"))
    return best(rows, ["suite"], [F.md5(F.concat(F.lit("m"), F.col("id").cast("string"))), F.col("id")], 5, F.col("id"))


@query("""WITH b AS (SELECT *, 'eyJhbGciOiJIUzI1NiJ9.' || rtrim(replace(replace(to_base64(encode(p_name)), '+', '-'), '/', '_'), '=') AS body FROM part)
SELECT p_partkey AS id, sha256(unhex('3739255c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c') || unhex(sha256(unhex('5d534f36363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636') || encode(body)))) AS signature, p_partkey % 3 <> 0 AS signed, regexp_matches(p_name, '(?i)^(red|blue)') AS allowed FROM b""")
def signed_tokens(spark, sf_dir):
    """HS256 signatures checked against the key; and names that allow patterns let through, an invalid one aside."""
    name = F.col("p_name")
    body = F.concat(X.base64url(F.lit('{"alg":"HS256"}')), F.lit("."), X.base64url(name))
    sent = X.hmac_sha256(b"key", F.when(F.col("p_partkey") % 3 == 0, F.concat(body, F.lit("x"))).otherwise(body))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.hmac_sha256(b"key", body).alias("signature"), (X.hmac_sha256(b"key", body) == sent).alias("signed"), C.allowed(name, ["^red", "^BLUE", "(["]).alias("allowed"))


@query("SELECT p_partkey AS id, substr(p_name, 4, 1) AS sign, ascii(substr(p_name, 4, 1))::INT AS code, 3::INT AS after, CASE WHEN p_partkey % 2 = 0 THEN -p_size ELSE p_size END::BIGINT AS number, NULL::BIGINT AS bad, NULL::VARCHAR AS past FROM part")
def character_checks(spark, sf_dir):
    """Places in strings: characters, codes, white space skipped, signed integers; null past the end and for bad forms."""
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), size)).otherwise(size)
    spaced = F.concat(F.lit("x \t"), n)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.char_at(n, F.lit(3)).alias("sign"), X.code_at(n, F.lit(3)).alias("code"), X.skip_space(spaced, F.lit(1)).alias("after"), X.signed_integer(text).alias("number"), X.signed_integer(F.concat(text, F.lit("x"))).alias("bad"), X.char_at(n, F.length(n)).alias("past"))
