"""Gates over strings derived from part, and routing of page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from .registering import slice_of, table

QUERIES, SQL, query = slice_of()

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_INTENT = """i AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'parse the ' || p_name || ' from (string) input' WHEN 1 THEN p_name || ' helper for various stuff' WHEN 2 THEN split_part(p_name, ' ', 1)
WHEN 3 THEN 'isValid ' || p_name || ' subset: string' WHEN 4 THEN 'the ' || p_name || ' of a large thing' WHEN 5 THEN 'Convert, ' || p_name || ' into normalised deserialised representation.' WHEN 6 THEN repeat('split ' || p_name || ' ', 8) ELSE p_name || '!' END AS intent FROM part)"""
_HINT = r"(?is):\s*(string|number|boolean|object|array|uint8array|buffer|date|bigint|symbol|null|undefined|void|never)\b|\bfrom\s+|\bto\s+|\([^\n]*\)"
_GATE = rf"""{_INTENT}, t AS (SELECT id, intent, [regexp_replace(lower(x), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') FOR x IN regexp_split_to_array(trim(intent), '\s+') IF x != ''] AS t FROM i),
f AS (SELECT *, list_filter([CASE WHEN len(t) < 4 THEN 'too_short' END, CASE WHEN len(t) > 20 THEN 'too_long' END, CASE WHEN list_has_any(t, {_LIST(G.STOP_WORDS)}) THEN 'stop_word_present' END, CASE WHEN list_has_any(t, {_LIST(G.META_WORDS)}) THEN 'meta_word_present' END], lambda x: x IS NOT NULL) AS a FROM t),
r AS (SELECT *, CASE WHEN len(t) = 1 THEN ['single_word'] WHEN len(a) = 0 AND NOT list_has_any(t, {_LIST(G.ACTION_VERBS)}) AND len(list_filter(t, lambda x: regexp_matches(x, '^(is.|has.|can.)'))) = 0 THEN ['no_action_verb'] ELSE a END AS reasons FROM f)"""


def intents(spark, sf_dir):
    p, name = table(spark, sf_dir, "part"), F.col("p_name")
    cases = [
        F.concat(F.lit("parse the "), name, F.lit(" from (string) input")),
        F.concat(name, F.lit(" helper for various stuff")),
        F.split_part(name, F.lit(" "), F.lit(1)),
        F.concat(F.lit("isValid "), name, F.lit(" subset: string")),
        F.concat(F.lit("the "), name, F.lit(" of a large thing")),
        F.concat(F.lit("Convert, "), name, F.lit(" into normalised deserialised representation.")),
        F.repeat(F.concat(F.lit("split "), name, F.lit(" ")), 8),
        F.concat(name, F.lit("!")),
    ]
    text = F.coalesce(*[F.when(F.col("p_partkey") % 8 == k, c) for k, c in enumerate(cases)])
    return p.select(F.col("p_partkey").alias("id"), text.alias("intent"))


@query(f"WITH {_GATE} SELECT id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN round(greatest(0, least(1, 0.5 + CASE WHEN regexp_matches(intent, '{_HINT}') THEN 0.1 ELSE 0 END + CASE WHEN len(t) BETWEEN 6 AND 14 THEN 0.1 ELSE 0 END + least(0.3, 0.05 * len(list_filter(t, lambda x: list_contains({_LIST(G.ACTION_VERBS)}, x) OR length(x) > 6))))), 6)::DOUBLE END AS score FROM r")
def intent_gate(spark, sf_dir):
    return G.intent_gate(intents(spark, sf_dir), "intent").select("id", F.array_join("reasons", ",").alias("reasons"), "score")


@query("SELECT p_partkey AS id, round((len(string_split(p_name, ' ')) + p_size % 6 + 5 * (p_size % 3) + 2 * (p_size % 17)) / greatest(1, (p_size % 4) * (p_size % 5)), 6) AS ratio, CASE WHEN len(string_split(p_name, ' ')) + p_size % 6 + 5 * (p_size % 3) + 2 * (p_size % 17) < 20 THEN 'bypassed' WHEN (len(string_split(p_name, ' ')) + p_size % 6 + 5 * (p_size % 3) + 2 * (p_size % 17)) / greatest(1, (p_size % 4) * (p_size % 5)) > 10 THEN 'too_large' ELSE 'ok' END AS status FROM part")
def size_ratio_gate(spark, sf_dir):
    s = F.col("p_size")
    ratio, status = G.size_ratio(F.size(F.split("p_name", " ")) + s % 6, s % 3, s % 17, s % 4, s % 5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(ratio, 6).alias("ratio"), status.alias("status"))


_IMPORTS = "m AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN './' || p_name WHEN 1 THEN 'node:fs' WHEN 2 THEN '@own/' || p_name WHEN 3 THEN 'fs/promises' WHEN 4 THEN '@scope/' || replace(p_name, ' ', '/') WHEN 5 THEN split_part(p_name, ' ', 1) || '/sub' ELSE split_part(p_name, ' ', 2) END AS spec FROM part)"
_BARE = "CASE WHEN spec LIKE '@%' THEN coalesce(string_split(substr(spec, 2), '/')[2], spec) ELSE string_split(spec, '/')[1] END"


@query(f"WITH {_IMPORTS} SELECT id, {_BARE} AS bare, CASE WHEN regexp_matches(spec, '^\\.{{1,2}}(/|$)') THEN 'relative' WHEN spec LIKE 'node:%' THEN 'builtin' WHEN spec LIKE '@own/%' THEN 'workspace' WHEN spec NOT LIKE '@%' AND list_contains({_LIST(G.CORE_MODULES)}, {_BARE}) THEN 'core' WHEN {_BARE} IN ('red', 'ring', 'small') THEN 'allowed' ELSE 'foreign' END AS class FROM m")
def import_classify(spark, sf_dir):
    name, k = F.col("p_name"), F.col("p_partkey") % 7
    spec = F.when(k == 0, F.concat(F.lit("./"), name)).when(k == 1, "node:fs").when(k == 2, F.concat(F.lit("@own/"), name)).when(k == 3, "fs/promises").when(k == 4, F.concat(F.lit("@scope/"), F.replace(name, F.lit(" "), F.lit("/")))).when(k == 5, F.concat(F.split_part(name, F.lit(" "), F.lit(1)), F.lit("/sub"))).otherwise(F.split_part(name, F.lit(" "), F.lit(2)))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), spec.alias("spec"))
    return rows.select("id", G.bare_name(F.col("spec")).alias("bare"), G.import_class(F.col("spec"), "@own/", ["red", "ring", "small"]).alias("class"))


@query("""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', ''), '/') AS s FROM pages),
c AS (SELECT page_id, s, CASE WHEN len(s) = 2 AND s[1] = 'en' AND s[2] = '25' THEN 1 WHEN len(s) = 2 AND s[1] = 'en' THEN 2 WHEN s[1] = 'fr' THEN 3 WHEN len(s) = 2 THEN 4 ELSE 5 END AS rule FROM p)
SELECT page_id AS path_id, rule AS rule_id, CASE rule WHEN 2 THEN s[2] WHEN 4 THEN s[1] || ',' || s[2] ELSE '' END AS captures FROM c""")
def route_match(spark, sf_dir):
    """The most specific of five rules for every page address, with what its named parts take."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    paths = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path_id"), F.split(path, "/").alias("segments"))
    rules = spark.createDataFrame([(1, ["en", "25"]), (2, ["en", ":id"]), (3, ["fr", "*"]), (4, [":lang", ":id"]), (5, ["*"])], "rule_id int, parts array<string>")
    return G.routed(paths, rules).select("path_id", "rule_id", F.array_join("captures", ",").alias("captures"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '\\b(eval|any)\\b') THEN 'dynamic' END AS violation, length(text) - length(replace(text, ',', '')) AS commas FROM documents WHERE regexp_matches(text, '\\b(eval|any)\\b') OR text LIKE '%,%,%'")
def subset_violations(spark, sf_dir):
    """Rule patterns over the text (an approximation of rules on syntax trees)."""
    t = F.col("text")
    bad = t.rlike(r"\b(eval|any)\b")
    return table(spark, sf_dir, "documents").where(bad | t.like("%,%,%")).select("doc_id", F.when(bad, "dynamic").alias("violation"), (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))).cast("long").alias("commas"))
