"""Quality rules: a threshold table compiled into one projection of SQL expressions.

Null text counts as empty. Every row gives one row, repeated rows and ties included; an empty table gives an
empty one. Only ``id_col`` and ``text_col`` are read, so further columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that it be for on with as at by this an are was or from have not a "
    "der die das und ist von mit zu den ein eine für auf nicht im sich des auch "
    "le la les de et en un une est que pour dans du sur par au qui "
    "el los las y por para con del se es al lo su"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text where ``value`` leaves low..high. ``value`` is SQL over the measures of ``measured``."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


BASE = (
    Rule("too_few_words", "n_words", low=50),
    Rule("repeated_windows", "100 * n_repeat_words - 50 * n_words", high=0),
)
VERDICT = (
    Rule("too_many_words", "n_words", high=10_000_000),
    Rule("word_length", "word_chars / n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("stop_words", "n_stop_words / n_words", low=0.1),
    Rule("shouted_words", "n_upper_words / n_words", high=0.5),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.45),
)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measures: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_upper_words.

    Windows of three words are sorted as (hash, place) where some hash occurs twice; neighbours of equal hash are found twice or more.
    The covered words are the sum of the gaps between found places, three at most. O(n log n) a text.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.select(F.col(id_col).alias(id_col), t.alias("_t"))
    df = df.withColumns(
        {
            "_w": F.filter(F.split("_t", rf"[{SPACE}]+"), lambda w: w != ""),
            "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(rf"[^{SPACE}]")),
            "n_symbols": F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long"),
        }
    )
    stop = lambda w: F.rtrim(F.lower(w), F.lit(".,")).isin(STOP_WORDS)
    upper = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_stop_words": F.size(F.filter("_w", stop)).cast("long"),
            "n_upper_words": F.size(F.filter("_w", upper)).cast("long"),
            "_h": F.expr("CASE WHEN size(_w) > 2 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END"),
        }
    )
    df = df.withColumn("_g", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) ELSE array() END"))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_g, (x, j) -> (j > 0 AND x.h = _g[greatest(j - 1, 0)].h) OR (j + 1 < size(_g) AND x.h = _g[least(j + 1, size(_g) - 1)].h)), x -> x.i))"))
    repeat = "aggregate(_p, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"
    # The partition id keeps filters on the measures above this projection: pushed below, they would carry copies of
    # the sorted windows into the lambda that reads them, and a text would cost the square of its length.
    return df.select(id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", (F.expr(repeat) + 0 * F.spark_partition_id()).alias("n_repeat_words"), "n_stop_words", "n_upper_words")


def broken(rules: tuple[Rule, ...]) -> Column:
    """The names of the broken rules, in the table's order. A ratio of an empty text breaks no rule here."""
    found = []
    for r in rules:
        v = F.expr(r.value.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))
        out = F.lit(False)
        if r.low is not None:
            out = out | (v < r.low)
        if r.high is not None:
            out = out | (v > r.high)
        found.append(F.when(out, F.lit(r.name)))
    return F.array_compact(F.array(*found))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, verdict: tuple[Rule, ...] = VERDICT) -> DataFrame:
    """One row per row: id, the measures, base_failed, reasons (array of names) and kept."""
    df = measured(df, id_col, text_col)
    return df.withColumns({"base_failed": F.size(broken(base)) > 0, "reasons": broken(base + verdict)}).withColumn("kept", F.size("reasons") == 0)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they came. Rows are judged in place, without a join."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    names = docs.columns
    return quality(packed, "_row", "_text").where("kept").select(*[F.col("_row").getField(c).alias(c) for c in names])


#: The same measures and rules for DuckDB.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT k, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT k, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g WHERE c IS NOT NULL),
e AS (SELECT k, count(DISTINCT i + o) AS n_repeat FROM r, (VALUES (0), (1), (2)) x(o) WHERE n > 1 GROUP BY k),
m AS (SELECT s.k, doc_id, len(ws)::BIGINT AS n_words,
  coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: rtrim(lower(x), '.,') IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop,
  len(list_filter(ws, lambda x: x = upper(x) AND x != lower(x))) AS n_upper
  FROM s LEFT JOIN e ON s.k = e.k),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 10000000
  AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 12.0
  AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.1 AND n_upper / n_words <= 0.5
  AND n_dup_lines / n_lines <= 0.45 AS kept
FROM b
"""


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
