"""Contracts of blocks: the weaknesses they leave open, how alike two of them are, and what several have in common.

A contract is columns by name: behavior (text), preconditions, postconditions, invariants, effects (arrays of texts), errors (array of description and type, null
or empty: none told), inputs, outputs (arrays of name and type), functional (the non-functional part: purity, time, space; null: absent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against, best
from .similarity import WEIGHTS, common, jaccard_of_sets, majority, normalized

FIELDS = ("behavior", "preconditions", "postconditions", "invariants", "effects", "errors", "inputs", "outputs", "functional")
#: Weaknesses of the family, in order.
WEAKNESSES = ("CWE-474", "CWE-440", "CWE-573", "CWE-684", "CWE-710")
DIMENSIONS = ("security", "behavioral", "error_handling", "performance", "interface")


def of(prefix: str = "") -> dict[str, Column]:
    return {f: F.col(f"{prefix}{f}") for f in FIELDS}


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c) == 0, F.lit(True)) | c.isNull()


def open_to(c: dict[str, Column]) -> dict[str, Column]:
    """Of each weakness, whether a contract leaves it open: effects that aren't told and no claim of purity; no postconditions; no preconditions; preconditions
    without an error; no non-functional part."""
    pure = F.coalesce(c["functional"]["purity"] == "pure", F.lit(False))
    tests = (_none(c["effects"]) & ~pure, _none(c["postconditions"]), _none(c["preconditions"]), ~_none(c["preconditions"]) & _none(c["errors"]), c["functional"].isNull())
    return dict(zip(WEAKNESSES, tests, strict=True))


def weaknesses(c: dict[str, Column]) -> tuple[Column, Column]:
    """(present, clear): the names of the weaknesses that a contract leaves open, and of the others."""
    found = open_to(c)
    pick = lambda want: F.array_compact(F.array(*[F.when(x if want else ~x, F.lit(n)) for n, x in found.items()]))
    return pick(True), pick(False)


def _texts(c: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: normalized(x)))


def features(c: dict[str, Column]) -> dict[str, Column]:
    """What likeness depends on, made once a contract: flags, normalized texts, and sets of them in order."""
    told = lambda k: _texts(F.filter(F.transform(c["errors"], lambda e: e[k]), lambda t: t.isNotNull()))
    named = lambda k: F.array_distinct(F.transform(F.coalesce(c[k], F.expr("cast(array() as array<struct<name:string,type:string>>)")), lambda p: F.concat(normalized(p["name"]), F.lit("::"), normalized(p["type"]))))
    sets = {"post": _texts(c["postconditions"]), "descriptions": told("description"), "types": told("type"), "ins": named("inputs"), "outs": named("outputs")}
    flags = {f"weak_{i}": w for i, w in enumerate(open_to(c).values())} | {"no_errors": _none(c["errors"]), "silent": c["functional"].isNull()}
    return flags | {k: normalized(c["functional"][k]) for k in ("time", "space")} | {k: F.array_sort(v) for k, v in sets.items()}


def _claims(a: Column, b: Column) -> Column:
    """1 where both sides are silent or say the same, else 0."""
    return a.eqNullSafe(b).cast("double")


def _alike(x: dict[str, Column], y: dict[str, Column]) -> dict[str, Column]:
    same = [(x[f"weak_{i}"] == y[f"weak_{i}"]).cast("int") for i in range(len(WEAKNESSES))]
    security = sum(same[1:], same[0]) / len(WEAKNESSES)
    of = lambda k: jaccard_of_sets(x[k], y[k])
    errors = F.when(x["no_errors"] & y["no_errors"], 1.0).when(x["no_errors"] | y["no_errors"], 0.0).otherwise(0.7 * of("descriptions") + 0.3 * of("types"))
    performance = F.when(x["silent"] & y["silent"], 1.0).when(x["silent"] | y["silent"], 0.0).otherwise(0.5 * _claims(x["time"], y["time"]) + 0.5 * _claims(x["space"], y["space"]))
    return dict(zip(DIMENSIONS, (security, of("post"), errors, performance, 0.5 * of("ins") + 0.5 * of("outs")), strict=True))


def dimensions(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """How alike two contracts are in five ways, each from 0 to 1."""
    return _alike(features(a), features(b))


def variance(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the dimensions; weights for all five that sum to 1 within 1e-9, else ValueError."""
    weights = dict(zip(DIMENSIONS, WEIGHTS, strict=True)) if weights is None else weights
    if missing := [d for d in DIMENSIONS if d not in weights]:
        raise ValueError(f"no weight for {missing}")
    if abs(sum(weights[d] for d in DIMENSIONS) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    return _weighed(dimensions(a, b), weights)


def _weighed(found: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for d in DIMENSIONS:
        out = out + weights[d] * found[d]
    return out


def likest(wants: DataFrame, haves: DataFrame, k: int) -> DataFrame:
    """(a, b, score, rank): for each want (id a) the k other haves (id b) of largest ``variance`` to 9 places, then of smaller id. Both sides: id and FIELDS.

    Contracts of equal ``features`` are a class. Only classes meet: of the k + 1 best classes by their least id, k + 1 ids each are ranked, as one may be the want itself.
    """
    made = lambda df: df.select("id", *[c.alias(n) for n, c in features(of()).items()])
    w, h = made(wants), made(haves)
    names = w.columns[1:]
    asked = w.groupBy(*names).agg(F.min("id").alias("wid"))
    known = best(h, names, [F.col("id")], k + 1, F.col("id")).groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    side = lambda df, key, p: df.select(key, *[F.col(n).alias(f"{p}{n}") for n in names])
    score = _weighed(_alike({n: F.col(f"x_{n}") for n in names}, {n: F.col(f"y_{n}") for n in names}), dict(zip(DIMENSIONS, WEIGHTS, strict=True)))
    known = known.withColumn("first", F.col("ids")[0])
    met = against(side(asked, "wid", "x_"), side(known, "first", "y_"), per_rows=1000).select("wid", "first", score.alias("score"))
    order = lambda b: [F.desc(F.round("score", 9)), b]
    top = best(met, ["wid"], order(F.col("first")), k + 1, F.col("first")).join(known.select("first", "ids"), "first").select("wid", F.explode("ids").alias("b"), "score")
    same = [w[n].eqNullSafe(asked[n]) for n in names]
    rows = w.join(asked, same).select(F.col("id").alias("a"), "wid").join(top, "wid").where("a != b").select("a", "b", "score")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(*order(F.col("b"))))).where(F.col("rank") <= k)


def merged(rows: DataFrame, by: str) -> DataFrame:
    """by, contributors, preconditions, invariants, clear (in all contracts of the group), postconditions (said at least half as often as there are contracts),
    behavior (the first of all), ties (how many behaviors it was chosen from, 0 if one), effects (of any). Texts are normalized but for behavior; arrays are sorted."""
    texts = lambda c: F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: normalized(x))
    flat = rows.select(by, "behavior", *[texts(F.col(c)).alias(c) for c in ("preconditions", "invariants", "postconditions", "effects")], weaknesses(of())[1].alias("clear"))
    said = F.when(F.col("behavior") != "", F.col("behavior"))
    out = flat.groupBy(by).agg(F.count("*").alias("contributors"), F.min(said).alias("behavior"), F.count(said).alias("_n"))
    out = out.withColumn("ties", F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).drop("_n")
    gather = lambda found, name: found.groupBy(by).agg(F.array_sort(F.collect_set("item")).alias(name))  # noqa: E731  what contracts say, not how many they are
    parts = [(common(flat, by, c), c) for c in ("preconditions", "invariants", "clear")] + [(majority(flat, by, "postconditions"), "postconditions"), (flat.select(by, F.explode("effects").alias("item")).distinct(), "effects")]
    for found, name in parts:
        out = out.join(gather(found, name), by, "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<string>)")))
    return out
