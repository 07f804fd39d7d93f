"""Structural and strictness matching of specifications, and the choice of the best block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against, best

PURITY = ("impure", "io", "stateful", "pure")
THREADS = ("unsafe", "sequential", "safe")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place in ``order``; unknown values are 0, null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for n, name in enumerate(order):
        out = out.when(value == name, n)
    return out.otherwise(0)


def nf_score(purity: Column, thread: Column) -> Column:
    return 10 * purity + thread


def reasons(want_in: Column, have_in: Column, want_out: Column, have_out: Column, want_errors: Column, have_errors: Column, want_purity: Column, have_purity: Column, want_thread: Column, have_thread: Column, costs: dict[str, tuple[Column, Column]] | None = None) -> Column:
    """All reasons why a candidate doesn't do for a caller; none where it matches. Inputs and outputs are arrays, of (name, type) or of one
    of these, compared place by place. costs: time and space of both sides by name, equal where both are given.
    """
    extra = F.array_except(have_errors, want_errors)
    return F.array_compact(
        F.array(
            F.when(F.size(want_in) != F.size(have_in), "input_count"),
            F.when((F.size(want_in) == F.size(have_in)) & (want_in != have_in), "input_mismatch"),
            F.when(F.size(want_out) != F.size(have_out), "output_count"),
            F.when((F.size(want_out) == F.size(have_out)) & (want_out != have_out), "output_mismatch"),
            F.when(F.size(extra) > 0, "undeclared_error"),
            F.when(have_purity < want_purity, "purity"),
            F.when(have_thread < want_thread, "thread_safety"),
            *[F.when(want != have, name) for name, (want, have) in (costs or {}).items()],
        )
    )


def reason_counts(wants: DataFrame, haves: DataFrame) -> DataFrame:
    """(reason, n): for how many pairs of a want and a have each reason of ``reasons`` holds, without making the pairs. Both sides: ins, outs, errs, purity, thread, time.

    A reason depends on one part of both sides, so rows are counted by that part first, and products of counts are summed: of sizes, ranks and costs, which are
    few, over all pairs of theirs; of the parts themselves over equal ones, which are taken from the pairs of equal size.
    """

    def sums(part: Column, bad, name: str) -> DataFrame:
        side = lambda df, key, n: df.groupBy(part.alias(key)).agg(F.count("*").alias(n)).withColumn("_j", F.lit(0))
        both = side(wants, "w", "kw").join(F.broadcast(side(haves, "h", "kh")), "_j")  # as many rows as there are sizes, ranks or costs
        return both.where(bad(F.col("w"), F.col("h"))).agg(F.sum(F.col("kw") * F.col("kh")).alias("n")).withColumn("reason", F.lit(name))

    def equal(part: str) -> DataFrame:
        side = lambda df, n: df.groupBy(part).agg(F.count("*").alias(n))
        return side(wants, "kw").join(side(haves, "kh"), part).agg(F.sum(F.col("kw") * F.col("kh")).alias("same"))

    def sized(part: str, count: str, mismatch: str) -> list[DataFrame]:
        size = F.size(part)
        apart = sums(size, lambda w, h: w == h, mismatch).withColumn("_j", F.lit(0)).join(equal(part).withColumn("_j", F.lit(0)), "_j")  # one row each
        return [sums(size, lambda w, h: w != h, count), apart.select((F.coalesce("n", F.lit(0)) - F.coalesce("same", F.lit(0))).alias("n"), "reason")]

    classes = lambda df, key, n: df.groupBy(F.array_sort(F.array_distinct("errs")).alias(key)).agg(F.count("*").alias(n))
    errors = against(classes(wants, "we", "kw"), classes(haves, "he", "kh")).where(F.size(F.array_except("he", "we")) > 0).agg(F.sum(F.col("kw") * F.col("kh")).alias("n")).withColumn("reason", F.lit("undeclared_error"))
    tables = [
        *sized("ins", "input_count", "input_mismatch"), *sized("outs", "output_count", "output_mismatch"), errors,
        sums(F.col("purity"), lambda w, h: h < w, "purity"), sums(F.col("thread"), lambda w, h: h < w, "thread_safety"), sums(F.col("time"), lambda w, h: w != h, "time"),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.where("n > 0").select("reason", F.col("n").cast("long").alias("n"))


def search(wants: DataFrame, haves: DataFrame, k: int) -> DataFrame:
    """(a, b, n, rank): of each want (id a) the k haves (id b) with the fewest ``reasons``, n of them, then the smaller id. Both sides: id, ins, outs, errs, purity, thread, time.

    Rows are not paired. Inputs and outputs only count as equal or not, and the other parts take few values, so haves are classes by these, with their k least ids each. For
    each choice of the two parts, classes of wants meet classes of haves that are equal in them, and the rest of the two counts as unequal. A have's fewest reasons of
    the four are the right ones, and what is told too many elsewhere can't push out a better one.
    """
    rest, both = ("errs", "purity", "thread", "time"), ("ins", "outs")
    known = lambda df: df.withColumns({"errs": F.array_sort(F.array_distinct("errs")), **{f"no_{c}": F.col(c).isNull() for c in both}})
    w, h = known(wants), known(haves)
    found = None
    for equal in ((), ("ins",), ("outs",), both):
        free = [f"no_{c}" for c in both if c not in equal]
        key = [*equal, *free, *rest]
        classes = w.select(*key).distinct()
        some = best(h.select("id", *key), key, [F.col("id")], k, F.col("id")).drop("rank")
        left = classes.select(*equal, *[F.col(c).alias(f"w_{c}") for c in [*free, *rest]])
        right = some.select(*equal, "id", *[F.col(c).alias(f"h_{c}") for c in [*free, *rest]])
        met = left.join(right.hint("merge"), list(equal)) if equal else against(left, right)
        of = lambda c: (F.col(f"w_{c}"), F.col(f"h_{c}"))
        none = F.array().cast("array<string>")
        told = F.size(reasons(none, none, none, none, *of("errs"), *of("purity"), *of("thread"), costs={"time": of("time")}))
        n = sum(((~F.col(f"w_{c}") & ~F.col(f"h_{c}")).cast("int") for c in free), told)
        met = met.select(*equal, *[F.col(f"w_{c}").alias(c) for c in [*free, *rest]], F.col("id").alias("b"), n.alias("n"))
        first = best(met, key, [F.col("n"), F.col("b")], k, F.col("b")).drop("rank").withColumnsRenamed({c: f"_{c}" for c in key})
        same = [w[c].eqNullSafe(first[f"_{c}"]) for c in key]
        part = w.join(first.hint("merge"), same).select(F.col("id").alias("a"), "b", "n")
        found = part if found is None else found.unionByName(part)
    right = found.groupBy("a", "b").agg(F.min("n").alias("n"))
    return right.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("n", "b"))).where(F.col("rank") <= k)


def strict_enough(want: Column, have: Column) -> Column:
    """A missing side passes."""
    return F.coalesce(have >= want, F.lit(True))


def best_per(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def selected(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """blocks (spec, root, passing) with dominated and rank: within a spec first the blocks that no other block of it is stricter than, then more
    passing runs, then the smaller root. edges: a stricter than b, as declared; of a chain within a spec each link is an edge of its own."""
    own = blocks.select("spec", "root").distinct()
    upper = own.withColumnRenamed("root", "a").join(edges.select("a", F.col("b").alias("root")).where("a != b").distinct(), "a")
    below = upper.join(own, ["spec", "root"]).select("spec", "root").distinct().withColumn("_d", F.lit(True))
    rows = blocks.join(below, ["spec", "root"], "left").withColumn("dominated", F.coalesce("_d", F.lit(False))).drop("_d")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("spec").orderBy("dominated", F.desc("passing"), "root")))


def lowerable(rows: DataFrame, status: Column, language: Column) -> DataFrame:
    """rows with lowerable (yes, no, unknown). Python blocks that are known not to lower drop out; Go and Rust are always unknown, and
    for TypeScript nothing is marked or dropped."""
    known = F.when(status.isin("yes", "no"), status).otherwise("unknown")
    mark = F.when(language == "ts", F.lit(None).cast("string")).when(language.isin("go", "rs"), "unknown").otherwise(known)
    return rows.withColumn("lowerable", mark).where(~F.coalesce((language == "py") & (F.col("lowerable") == "no"), F.lit(False)))


def reranked(rows: DataFrame, match: Column, by: str = "query_id") -> DataFrame:
    """Candidates by (1 - distance) + match, 1 for a structural match and 0 else; equals keep their order (rank)."""
    got = rows.withColumn("score", F.round(1 - F.col("distance") + match.cast("int"), 6)).withColumnRenamed("rank", "prior")
    return got.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "prior"))).drop("prior")


def tiebreaks(rows: DataFrame, tests: Column, by: str = "query_id", near: float = 0.02) -> DataFrame:
    """by, reason: why the first of two candidates within ``near`` leads: more_tests, else lexicographic; none if the second is farther."""
    w = Window.partitionBy(by).orderBy("rank")
    first = rows.withColumn("_t", tests).withColumns({"_s": F.lead("score").over(w), "_n": F.lead("_t").over(w)}).where("rank = 1")
    reason = F.when(F.col("_s").isNull() | (F.col("score") - F.col("_s") > near), "none").when(F.col("_t") > F.col("_n"), "more_tests").otherwise("lexicographic")
    return first.select(by, reason.alias("reason"))


def too_many(rows: DataFrame, by: str, score: str, most: int = 10, most_strong: int = 3, strong: float = 0.7) -> DataFrame:
    """by, n, strong, too_many: over ``most`` results, or over ``most_strong`` of ``strong`` or more."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(score) >= strong).alias("strong"))
    return out.withColumn("too_many", (F.col("n") > most) | (F.col("strong") > most_strong))


#: Dimensions of a query that a hint may name when it is ambiguous.
DIMENSIONS = ("inputs", "outputs", "purity", "thread")


def resolved(rows: DataFrame, asked: DataFrame, by: str = "query_id", near: float = 0.02, crowd: int = 5) -> DataFrame:
    """by, status, close, hint. rows: by, score. asked: by, hash_hit (a lookup by hash succeeded: matched with score 1) and DIMENSIONS, null where absent.

    Status by the best score; the hint names the absent dimensions when ``crowd`` or more candidates lie within ``near`` of it.
    """
    top = rows.groupBy(by).agg(F.max("score").alias("top"))
    close = rows.join(top, by).groupBy(by).agg(F.first("top").alias("top"), F.count_if(F.col("top") - F.col("score") <= near).alias("close"))
    out = asked.join(close, by, "left")
    status = F.when(F.col("hash_hit") | (F.col("top") >= 0.7), "matched").when(F.col("top") >= 0.5, "weak_only").otherwise("no_match")
    absent = F.array_join(F.array_compact(F.array(*[F.when(F.col(d).isNull(), F.lit(d)) for d in DIMENSIONS])), ",")
    n = F.coalesce("close", F.lit(0))
    return out.select(by, status.alias("status"), n.alias("close"), F.when(~F.col("hash_hit") & (n >= crowd), absent).alias("hint"))


def rescored(rows: DataFrame, status: Column, mode: str, by: str = "query_id", penalty: float = 0.2, bonus: float = 0.05) -> DataFrame:
    """Scores moved by proof status and ranked again, equals in their order: retracted ones lose, accepted ones gain if mode is preferred; mode
    required keeps accepted ones only."""
    moved = F.when(status == "retracted", -penalty).when((status == "accepted") & F.lit(mode == "preferred"), bonus).otherwise(0.0)
    got = rows.withColumn("_keep", F.coalesce(status == "accepted", F.lit(False))).withColumn("_new", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + moved)), 6))
    if mode == "required":
        got = got.where("_keep")
    got = got.withColumn("score", F.col("_new")).withColumnRenamed("rank", "prior").drop("_keep", "_new")
    return got.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "prior"))).drop("prior")
