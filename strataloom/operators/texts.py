"""Normal forms of source texts, and the text of a query. Rules and signatures stand on the token table of sources.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.json_texts import canonical_json

def normal_source(c: Column) -> Column:
    """Line ends as \\n, white space at both ends dropped."""
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


def query_text(**parts: Column) -> Column:
    """Canonical JSON of the dimensions of a query that are present (not null, and not empty but for single properties).

    behavior: text; errors, guarantees, property_tests: arrays of texts; inputs, outputs: arrays of (name, type), where a null name is named by its place;
    purity, space, thread_safety, time: texts of the non-functional part.
    """
    absent = F.lit(None)
    texts = lambda k: parts.get(k, absent.cast("array<string>"))
    some = lambda c: F.when(F.size(c) > 0, c)
    described = lambda k, key: some(F.transform(texts(k), lambda t, i: F.struct(t.alias("description"), F.concat(F.lit(key), i.cast("string")).alias("id"))))
    side = lambda k, name: some(F.transform(parts.get(k, absent.cast("array<struct<name:string,type:string>>")), lambda p, i: F.struct(F.coalesce(p["name"], F.concat(F.lit(name), i.cast("string"))).alias("name"), p["type"].alias("type"))))
    one = lambda k: parts.get(k, absent.cast("string"))
    extra = [one(k) for k in ("purity", "space", "thread_safety", "time")]
    rest = F.when(F.coalesce(*extra).isNotNull(), F.struct(*[c.alias(n) for c, n in zip(extra, ("purity", "space", "threadSafety", "time"), strict=True)]))
    whole = F.struct(
        F.nullif(one("behavior"), F.lit("")).alias("behavior"),
        some(F.transform(texts("errors"), lambda t: F.struct(t.alias("description")))).alias("errorConditions"),
        described("guarantees", "q").alias("guarantees"),
        side("inputs", "arg").alias("inputs"),
        rest.alias("nonFunctional"),
        side("outputs", "out").alias("outputs"),
        described("property_tests", "p").alias("propertyTests"),
    )
    return canonical_json(F.to_json(whole))
