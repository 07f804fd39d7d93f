"""Scalar functions over strings derived from part, orders, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import registry as R
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()


def part(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))


_P = "p AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_size AS size, p_brand AS brand FROM part)"


@query(f"WITH {_P} SELECT id, levenshtein(name, lower(type))::INT AS distance FROM p")
def levenshtein(spark, sf_dir):
    return part(spark, sf_dir).select("id", F.levenshtein("name", F.lower("type")).alias("distance"))


_V = f"{_P}, v AS (SELECT id, (size % 4) || '.' || (id % 10) || '.' || CASE WHEN id % 13 = 0 THEN 'x' ELSE (size % 7)::VARCHAR END AS v, size % 4 AS a, id % 10 AS b, size % 7 AS c FROM p)"


def version():
    return F.concat_ws(".", (F.col("size") % 4).cast("string"), (F.col("id") % 10).cast("string"), F.when(F.col("id") % 13 == 0, "x").otherwise((F.col("size") % 7).cast("string")))


@query(f"WITH {_V} SELECT id, CASE WHEN id % 13 <> 0 THEN (a, b, c) >= (1, 2, 0) AND (a, b, c) < (2, 5, 0) OR (a, b, c) = (3, 3, 3) END AS ranged, CASE WHEN id % 13 <> 0 THEN (a, b, c) >= (1, 2, 3) AND (a, b, c) < (2, 0, 0) END AS caret, CASE WHEN id % 13 <> 0 THEN (a, b, c) >= (0, 2, 1) AND (a, b, c) < (0, 3, 0) END AS caret0, CASE WHEN id % 13 <> 0 THEN (a, b, c) >= (1, 2, 3) AND (a, b, c) < (1, 3, 0) END AS tilde FROM v")
def semver_range(spark, sf_dir):
    ok = lambda rule: X.semver_satisfies(version(), rule)
    return part(spark, sf_dir).select("id", ok(">=1.2.0 <2.5.0 || =3.3.3").alias("ranged"), ok("^1.2.3").alias("caret"), ok("^0.2.1").alias("caret0"), ok("~1.2.3").alias("tilde"))


@query(f"WITH {_P} SELECT id, CASE id % 3 WHEN 0 THEN size || '.0.0' WHEN 1 THEN size || '.' || (id % 10) || '.0' ELSE size || '.' || (id % 10) || '.7' END AS coerced FROM p")
def semver_coerce(spark, sf_dir):
    s, k = F.col("size").cast("string"), (F.col("id") % 10).cast("string")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), s)).when(F.col("id") % 3 == 1, F.concat(F.lit("release "), s, F.lit("."), k)).otherwise(F.concat(s, F.lit("."), k, F.lit(".7-beta")))
    return part(spark, sf_dir).select("id", F.array_join(X.semver_coerced(text).cast("array<string>"), ".").alias("coerced"))


@query("SELECT event_id AS id, (props->>'$.k')::BIGINT AS k, ((props->>'$.k')::BIGINT + 1)::VARCHAR AS second, 'v' AS escaped, NULL::VARCHAR AS missing FROM events")
def json_pointer(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"a":['), k, F.lit(","), (k.cast("long") + 1).cast("string"), F.lit('],"x/y":{"m~n":"v"}}'))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "props", doc.alias("doc"))
    return e.select("id", X.json_pointer(F.col("props"), "/k").cast("long").alias("k"), X.json_pointer(F.col("doc"), "/a/1").alias("second"), X.json_pointer(F.col("doc"), "/x~1y/m~0n").alias("escaped"), X.json_pointer(F.col("doc"), "/a/01").alias("missing"))


@query("SELECT event_id AS id, (props->>'$.k')::DOUBLE + round(value, 2) - 1.5 AS total FROM events")
def json_leaf_sum(spark, sf_dir):
    doc = F.concat(F.lit('{"a":['), F.get_json_object("props", "$.k"), F.lit(',{"b 7":'), F.round("value", 2).cast("string"), F.lit(',"c":"9 \\" 8"}],"d":-15e-1}'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), X.json_leaf_sum(doc).alias("total"))


@query(f"WITH {_P} SELECT id, name AS a, type || ', \"' || brand || '\"' AS b, size::VARCHAR AS c FROM p")
def csv_row(spark, sf_dir):
    line = F.concat(F.col("name"), F.lit(',"'), F.col("type"), F.lit(', ""'), F.col("brand"), F.lit('""",'), F.col("size").cast("string"))
    row = X.csv_row(line, 3)
    return part(spark, sf_dir).select("id", row[0].alias("a"), row[1].alias("b"), row[2].alias("c"))


@query(f"WITH {_P}, w AS (SELECT id, string_split(name, ' ') AS w FROM p) SELECT id, w[1] || upper(left(w[2], 1)) || substr(w[2], 2) AS camel, array_to_string(w, '_') AS snake, upper(left(w[1], 1)) || substr(w[1], 2) || upper(left(w[2], 1)) || substr(w[2], 2) AS pascal FROM w")
def name_case(spark, sf_dir):
    kebab = F.replace("name", F.lit(" "), F.lit("-"))
    return part(spark, sf_dir).select("id", X.camel(kebab).alias("camel"), X.snake(X.camel(kebab)).alias("snake"), X.pascal(F.col("name")).alias("pascal"))


@query(f"WITH {_P}, t AS (SELECT id, '[' || size || ', -' || (id % 7) || ',0]' AS s, size, id % 7 AS k FROM p) SELECT id, CASE WHEN id % 9 <> 0 THEN size - k END::BIGINT AS total, CASE WHEN id % 9 <> 0 THEN (CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) + 1 END::INT AS evens, list_sum([c::INT FOR c IN regexp_extract_all(s, '[0-9]')])::BIGINT AS digits FROM t")
def int_list(spark, sf_dir):
    text = F.concat(F.lit("["), F.col("size").cast("string"), F.lit(", -"), (F.col("id") % 7).cast("string"), F.lit(",0]"))
    rows = part(spark, sf_dir).withColumn("s", text)
    got = X.int_list(F.when(F.col("id") % 9 == 0, F.concat("s", F.lit(","))).otherwise(F.col("s")))
    rows = rows.withColumn("l", got)
    return rows.select("id", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.when(F.col("l").isNotNull(), F.size(F.filter("l", lambda x: x % 2 == 0))).alias("evens"), X.digit_sum(F.col("s")).alias("digits"))


@query(f"WITH {_P} SELECT id, CASE WHEN id % 5 <> 0 THEN size + 0.5 END::DOUBLE AS x, CASE WHEN id % 5 <> 0 THEN -(id % 7) END::DOUBLE AS y FROM p")
def coord_pair(spark, sf_dir):
    text = F.concat(F.when(F.col("id") % 5 == 0, "[").otherwise("("), F.col("size").cast("string"), F.lit(".5 , -"), (F.col("id") % 7).cast("string"), F.lit(")"))
    c = X.coordinate(text)
    return part(spark, sf_dir).select("id", c[0].alias("x"), (c[1] + 0.0).alias("y"))


@query(f"WITH {_P} SELECT id, to_base64(encode(name)) AS std, rtrim(replace(replace(to_base64(encode(name || '?>~')), '+', '-'), '/', '_'), '=') AS url, hex(encode(name)) AS hexed FROM p")
def encodings(spark, sf_dir):
    n = F.col("name")
    return part(spark, sf_dir).select("id", F.base64(n.cast("binary")).alias("std"), X.base64url(F.concat(n, F.lit("?>~"))).alias("url"), F.hex(n.cast("binary")).alias("hexed"))


_BIT = " + ".join(f"substr(s, {k + 1}, 1)::INT * {16 >> k}" for k in range(5))


@query(f"""WITH {_P}, b AS (SELECT id, array_to_string([lpad(to_base(ascii(substr(name, i, 1)), 2), 8, '0') FOR i IN range(1, length(name) + 1)], '') AS bits,
list_reduce([4294967295::BIGINT] || flatten([[ascii(substr(name, i, 1))::BIGINT] || [-1::BIGINT FOR k IN range(8)] FOR i IN range(1, length(name) + 1)]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 2197175160 ELSE 0 END) END) AS c FROM p),
f AS (SELECT id, c, [rpad(substr(bits, (5 * i + 1)::BIGINT, 5), 5, '0') FOR i IN range(ceil(length(bits) / 5)::BIGINT)] AS fives FROM b)
SELECT id, rpad(array_to_string(list_transform(fives, lambda s: substr('{X.BASE32}', 1 + {_BIT}, 1)), ''), (ceil(len(fives) / 8) * 8)::INT, '=') AS b32, xor(c, 4294967295) AS crc FROM f""")
def base32_crc32c(spark, sf_dir):
    """Known vectors are in the tests as well."""
    return part(spark, sf_dir).select("id", X.base32(F.col("name")).alias("b32"), X.crc32c(F.col("name")).alias("crc"))


@query(f"WITH {_P} SELECT id, id % 4 <> 1 AS email, id % 3 = 0 AS uuid, CASE WHEN length(name) < 9 THEN 'shorter than 9' WHEN length(name) > 12 THEN 'longer than 12' END AS message, true AS ascii FROM p")
def validations(spark, sf_dir):
    n = F.replace("name", F.lit(" "), F.lit("."))
    mail = F.concat(n, F.when(F.col("id") % 4 == 1, "..x@host.org").otherwise("@mail.host.org"))
    u = F.concat(F.lpad(F.hex("id"), 8, "0"), F.lit("-0000-"), F.when(F.col("id") % 3 == 0, "4").otherwise("1"), F.lit("abc-9000-0123456789ab"))
    return part(spark, sf_dir).select("id", X.email_valid(mail).alias("email"), X.uuid4_valid(u).alias("uuid"), X.bounds_message(F.col("name"), 9, 12).alias("message"), X.ascii_only(F.col("name")).alias("ascii"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 3 THEN epoch_ms(o_orderdate) - 7200000 + 250 END AS ms, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, (o_orderdate::DATE + (o_orderkey % 9)::INT)::DATE AS later FROM orders")
def dates(spark, sf_dir):
    """RFC 3339 to milliseconds, ISO with offset, and days added (calendar days)."""
    t = F.col("o_orderdate").cast("timestamp")
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 10 == 3, " 250").otherwise(".250+02:00"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.rfc3339(text).alias("ms"), F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"), F.date_add(F.to_date(t), (F.col("o_orderkey") % 9).cast("int")).alias("later"))


@query("SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), '. ')[1] AS first, CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS short FROM documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("first"), X.shortened(F.col("text")).alias("short"))


@query(f"WITH {_P}, j AS (SELECT id, '{{\"level\":' || CASE WHEN id % 4 = 0 THEN '' ELSE '\"L' || (size % 4) || '\",\"name\":\"' || name || '\",\"size\":' || size END || '}}' AS s, name, size FROM p) SELECT id, CASE WHEN id % 4 = 0 THEN '{{\"name\":\"' || name || '\",\"size\":' || size || '}}' ELSE '{{\"level\":\"L' || (size % 4) || '\",\"name\":\"' || name || '\",\"size\":' || size || '}}' END AS canonical, sha256(CASE WHEN id % 4 = 0 THEN '{{\"name\":\"' || name || '\",\"size\":' || size || '}}' ELSE '{{\"level\":\"L' || (size % 4) || '\",\"name\":\"' || name || '\",\"size\":' || size || '}}' END) AS spec_hash FROM j")
def canonical_json(spark, sf_dir):
    """Keys in order, absent ones left out, no spaces; its digest is the specification's hash."""
    row = F.struct(F.when(F.col("id") % 4 != 0, F.concat(F.lit("L"), (F.col("size") % 4).cast("string"))).alias("level"), "name", "size")
    text = F.to_json(row)
    return part(spark, sf_dir).select("id", text.alias("canonical"), F.sha2(text.cast("binary"), 256).alias("spec_hash"))


@query("SELECT doc_id, sha256(unhex(sha256(lang || '|' || source)) || unhex(sha256(text)) || unhex(sha256(encode('{}') || unhex(sha256(lang)) || unhex(sha256(source))))) AS root FROM documents")
def merkle_root(spark, sf_dir):
    """Root of specification, implementation, and manifest with its artifacts in order."""
    root = R.block_root(R.sha(F.concat_ws("|", "lang", "source")), F.col("text"), F.lit("{}"), F.array("lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", root.alias("root"))


@query(f"WITH {_P} SELECT id, '{{\"alg\":\"HS256\"}}' AS header, '{{\"sub\":\"' || name || '\",\"n\":' || size || '}}' AS claims, rtrim(replace(replace(to_base64(unhex(sha256(name))), '+', '-'), '/', '_'), '=') AS challenge FROM p")
def tokens(spark, sf_dir):
    """A token made and read back, and a code challenge."""
    claims = F.concat(F.lit('{"sub":"'), F.col("name"), F.lit('","n":'), F.col("size").cast("string"), F.lit("}"))
    token = F.concat_ws(".", X.base64url(F.lit('{"alg":"HS256"}')), X.base64url(claims), F.lit("sig"))
    return part(spark, sf_dir).select("id", X.jwt_part(token, 0).alias("header"), X.jwt_part(token, 1).alias("claims"), X.pkce_challenge(F.col("name")).alias("challenge"))


@query(f"WITH {_P} SELECT id, ((size + 2) * 3 - id % 5)::DOUBLE / 2 AS value FROM p")
def expression_value(spark, sf_dir):
    text = F.concat(F.lit("(("), F.col("size").cast("string"), F.lit(" + 2) * 3 - "), (F.col("id") % 5).cast("string"), F.lit(") / -(-2)"))
    return part(spark, sf_dir).select("id", X.arithmetic_column(text).alias("value"))


@query(f"""WITH {_P}, h AS (SELECT id, sha256(name || '|0') || sha256(name || '|1') AS h FROM p), r AS (SELECT id, [(('0x' || substr(h, 2 * i + 1, 2))::INT - 128) / 128.0 FOR i IN range(64)] AS raw FROM h), n AS (SELECT *, sqrt(list_sum([x * x FOR x IN raw])) AS norm FROM r)
SELECT id, array_to_string([round(x / norm * 1000000)::BIGINT FOR x IN raw], ',') AS millionths FROM n""")
def offline_embedding(spark, sf_dir):
    """Digest vectors of the names, as whole millionths; lengths and components are tested as well."""
    v = F.transform(X.hash_embedding(F.col("name"), 64), lambda x: F.round(x * 1_000_000).cast("long").cast("string"))
    return part(spark, sf_dir).select("id", F.array_join(v, ",").alias("millionths"))
