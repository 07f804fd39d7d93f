"""The block store: first-wins and last-wins writes, catalog reads, pages, manifests, queues and replication by set difference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import positions
from .cluster import cut, exists

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def first_wins(new: DataFrame, key: list[str], order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The first row of each key by ``order`` whose key isn't stored yet. Minima combine before the shuffle; no window is sorted."""
    rest = [c for c in new.columns if c not in key]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
    out = new.groupBy(*key).agg(least).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])
    return out if stored is None else out.join(stored.select(*key), key, "left_anti")


def last_wins(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """An upsert: of old and new rows the last of each key by ``order``, new rows after old ones of the same order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    most = F.max(F.struct(*order, "_new", *[c for c in rest if c not in order])).alias("_b")
    return both.groupBy(*key).agg(most).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Delete-then-insert by key: rows of old keys that new doesn't name, and all new rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def rewrite(rows: DataFrame, path: str, key: list[str], digest: str, part: Column) -> list[int]:
    """Replace, in the table under ``path``, the rows of every key whose digest isn't the stored one; keys that rows don't name and keys with the same digest
    stay as they are. Returns the partitions that were written.

    The table is partitioned by ``part`` (a whole number, from the key alone). Only partitions that hold a changed key are written, each by a rename when all tasks are
    done, so a run that fails in a task changes nothing and one without changes writes nothing. One driver writes at a time.
    """
    spark = rows.sparkSession
    new = cut(rows.withColumn("_part", part.cast("int")))
    old = cut(spark.read.schema(new.schema).parquet(path)) if exists(spark, path) else new.where("false")
    keys = new.select("_part", *key, digest).distinct()
    moved = cut(keys.join(old.select(*key, digest).distinct(), [*key, digest], "left_anti").select("_part", *key).distinct())
    touched = sorted(r[0] for r in moved.select("_part").distinct().collect())  # numbers of partitions
    if touched:
        names = F.broadcast(spark.createDataFrame([(t,) for t in touched], "_part int"))
        kept = old.join(names, "_part", "left_semi").join(moved.select(*key), key, "left_anti")
        out = kept.select(new.columns).unionByName(new.join(moved.select(*key), key, "left_semi").select(new.columns))
        out.hint("rebalance", "_part").sortWithinPartitions("_part", *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return touched


def changed(new: DataFrame, stored: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Rows whose digest isn't the stored one of their key (new keys included)."""
    return new.join(stored.select(*key, digest), [*key, digest], "left_anti")


def point(blocks: DataFrame, artifacts: DataFrame, root: str, root_col: str = "root") -> DataFrame:
    """A block and its artifacts, an array of (position, path, bytes) in declared order."""
    own = artifacts.where(F.col(root_col) == root).groupBy(root_col).agg(F.array_sort(F.collect_list(F.struct("position", "path", "bytes"))).alias("artifacts"))
    return blocks.where(F.col(root_col) == root).join(own, root_col, "left")


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """One keyset page: key > after in order, 1000 rows at most, and whether more follow (column more)."""
    limit = max(1, min(limit, 1000))
    got = rows.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(key))  # limit + 1 rows
    got = got.withColumn("_n", n).withColumn("more", F.max("_n").over(Window.partitionBy()) > limit)
    return got.where(F.col("_n") <= limit).drop("_n")


def manifest(blocks: DataFrame, artifacts: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Root and the digests of named artifacts; a missing one has the digest of no bytes."""
    digests = [F.max(F.when(F.col("path") == p, sha(F.col("bytes")))).alias(c) for c, p in paths.items()]
    own = artifacts.where(F.col("path").isin(list(paths.values()))).groupBy("root").agg(*digests)
    return blocks.select("root").join(own, "root", "left").select("root", *[F.coalesce(c, F.lit(EMPTY_SHA256)).alias(c) for c in paths])


def unsubmitted(blocks: DataFrame, limit: int, submitted: str = "submitted_at") -> DataFrame:
    return blocks.where(F.col(submitted).isNull()).orderBy("created_at", "root").limit(limit)


def mirrored(remote: DataFrame, local: DataFrame, valid: Column, key: str = "root", versions: tuple[int, int] | None = None) -> DataFrame:
    """Every remote row with its outcome: skipped (present), failed (not valid) or inserted. Only keys are joined.

    versions: schema versions of the remote and the local side; a newer remote is an error.
    """
    if versions and versions[0] > versions[1]:
        raise ValueError(f"the remote schema {versions[0]} is newer than the local {versions[1]}")
    here = local.select(F.col(key).alias("_k")).distinct()
    rows = remote.join(here, remote[key] == F.col("_k"), "left")
    out = F.when(F.col("_k").isNotNull(), "skipped").when(~valid, "failed").otherwise("inserted")
    return rows.withColumn("outcome", out).drop("_k")


def merged_intervals(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Islands of touching or overlapping ranges: key, start, end and the number of ranges. Equal ranges are counted before the window."""
    rows = rows.groupBy(*key, start, end).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_k").alias("n")).drop("_island")


def gaps(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """The uncovered ranges between the islands of each key."""
    w = Window.partitionBy(*key).orderBy(start)
    found = merged_intervals(rows, key, start, end).select(*key, F.col(end).alias("gap_start"), F.lead(start).over(w).alias("gap_end"))
    return found.where("gap_end is not null")


def uncovered(sources: DataFrame, shards: DataFrame, key: str, text: str, start: str, end: str) -> DataFrame:
    """key, glue: the parts of each source text that no shard covers, as (a, z, text) by place; empty parts are left out.

    Shards are places a..z (z excluded) in characters, in any order, overlapping or not; places past the ends are cut off. A
    source without shards is one part, a null text none.
    """
    islands = merged_intervals(shards.where(F.col(start) < F.col(end)), [key], start, end)
    per = islands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("int").alias("a"), F.col(end).cast("int").alias("z")))).alias("_c"))
    n = F.length(text)
    covered = F.coalesce("_c", F.expr("cast(array() as array<struct<a:int,z:int>>)"))
    begins = F.concat(F.array(F.lit(0)), F.transform(covered, lambda c: F.least(F.greatest(c["z"], F.lit(0)), n)))
    ends = F.concat(F.transform(covered, lambda c: F.least(F.greatest(c["a"], F.lit(0)), n)), F.array(n))
    gaps = F.filter(F.zip_with(begins, ends, lambda a, z: F.struct(a.alias("a"), z.alias("z"))), lambda g: g["a"] < g["z"])
    parts = F.transform(gaps, lambda g: F.struct(g["a"].alias("a"), g["z"].alias("z"), F.substr(F.col(text), g["a"] + 1, g["z"] - g["a"]).alias("text")))
    return sources.select(key, text).join(per, key, "left").select(key, F.coalesce(F.when(F.col(text).isNotNull(), parts), F.expr("cast(array() as array<struct<a:int,z:int,text:string>>)")).alias("glue"))


def consistency(cards: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """key, state: both, no_vector or no_card, for every key of either side."""
    a = cards.select(key, F.lit(1).alias("_x")).distinct()
    b = vectors.select(key, F.lit(1).alias("_y")).distinct()
    state = F.when(F.col("_y").isNull(), "no_vector").when(F.col("_x").isNull(), "no_card").otherwise("both")
    return a.join(b, key, "full").select(key, state.alias("state"))


def block_root(spec_hash: Column, impl: Column, manifest: Column, artifacts: Column) -> Column:
    """Identity of a block: digest of the specification's hash, the implementation's digest, and the digest of the manifest followed
    by its artifacts' digests (an array of texts or bytes in the manifest's order)."""
    h = lambda c: F.unhex(sha(c))
    listed = F.aggregate(artifacts, manifest.cast("binary"), lambda a, x: F.concat(a, F.unhex(F.sha2(x.cast("binary"), 256))))
    return F.sha2(F.concat(F.unhex(spec_hash), h(impl), F.unhex(F.sha2(listed, 256))), 256)


def stored(new: DataFrame, present: DataFrame, root: Column, order: list[str]) -> DataFrame:
    """Every new row with its outcome: integrity_failed (its root isn't ``root``, made from its content), foreign_incomplete (kind foreign without pkg
    and export), skipped (the root is present, or an earlier new row has it) or inserted.

    new: root, kind, pkg, export and more. Only roots are joined; the first of equal roots comes from grouped minima.
    """
    foreign = (F.col("kind") == "foreign") & (F.col("pkg").isNull() | F.col("export").isNull())
    rows = new.withColumn("_bad", F.when(~F.col("root").eqNullSafe(root), "integrity_failed").when(F.coalesce(foreign, F.lit(False)), "foreign_incomplete"))
    least = rows.where("_bad is null").groupBy("root").agg(F.min(F.struct(*order)).alias("_first"))
    here = present.select("root").distinct().withColumn("_here", F.lit(True))
    rows = rows.join(least, "root", "left").join(here, "root", "left")
    own = F.struct(*[F.col(c) for c in order])
    outcome = F.coalesce("_bad", F.when(F.col("_here").isNotNull() | (own != F.col("_first")), "skipped").otherwise("inserted"))
    return rows.withColumn("outcome", outcome).drop("_bad", "_first", "_here")


def looked_up(keys: DataFrame, cache: DataFrame, key: str, value: str, check: Column) -> DataFrame:
    """keys with ``value`` and hit. A cache entry that fails ``check`` counts as absent, as it would be deleted and missed."""
    good = cache.where(F.coalesce(check, F.lit(False))).groupBy(key).agg(F.min(value).alias(value))
    return keys.join(good, key, "left").withColumn("hit", F.col(value).isNotNull())


def unlisted(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that the list doesn't have."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def model_guard(vectors: DataFrame, model: str, dims: int, model_col: str = "model", vec_col: str = "embedding") -> DataFrame:
    """The vectors, if all come from ``model`` with ``dims`` components; else ValueError names what was found."""
    n = F.size(vec_col)
    odd = vectors.where(~F.col(model_col).eqNullSafe(model) | ~n.eqNullSafe(F.lit(dims))).select(model_col, n.alias("dims")).limit(1).collect()
    if odd:
        raise ValueError(f"cross_provider_rejected: {odd[0][0]} with {odd[0][1]} components, wanted {model} with {dims}")
    return vectors


def open_store(spark, folder: str, model: str | None = None, dims: int | None = None) -> dict[str, DataFrame]:
    """The tables of a store's folder by name, one sub-folder (name.parquet) each. With ``model``, the table vectors must come from it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found)
    tables = {n[: -len(".parquet")]: spark.read.parquet(f"{folder}/{n}") for n in names if n.endswith(".parquet")}
    if model is not None:
        tables["vectors"] = model_guard(tables["vectors"], model, dims)
    return tables


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables as one folder that ``open_store`` reads; an existing one is an error, so a snapshot is never mixed."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder}/{name}.parquet")


def embedded(rows: DataFrame, text: str, provider, name: str = "embedding") -> DataFrame:
    """rows with a vector of their text. provider: a function from a column to a column, or an object with ``batch`` (texts to vectors), which gets
    64 texts at a time in Arrow batches and is tried up to four times."""
    if callable(provider):
        return rows.withColumn(name, provider(F.col(text)))
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for a in range(0, len(texts), 64):
            part = texts.iloc[a : a + 64].tolist()
            for left in (3, 2, 1, 0):
                try:
                    out += [list(map(float, v)) for v in provider.batch(part)]
                    break
                except Exception:  # noqa: BLE001  a provider may raise anything
                    if not left:
                        raise
        return pd.Series(out)

    return rows.withColumn(name, run(F.col(text)))


def rebuilt(vectors: DataFrame, cards: DataFrame, provider, key: str, text: str) -> DataFrame:
    """All vectors made anew from the cards' texts, with whether the stored one differs in length (column resized) or is missing (column added)."""
    old = vectors.select(key, F.size("embedding").alias("_n"))
    rows = embedded(cards.select(key, text), text, provider).join(old, key, "left")
    return rows.select(key, "embedding", F.coalesce(F.col("_n") != F.size("embedding"), F.lit(False)).alias("resized"), F.col("_n").isNull().alias("added"))


def backfilled(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """``column`` where it isn't empty, else ``value``."""
    return rows.withColumn(column, F.when(F.coalesce(F.col(column), F.lit("")) == "", value).otherwise(F.col(column)))


def reference_lists(refs: DataFrame, by: str, pkg: Column, export: Column) -> DataFrame:
    """by, refs: the distinct pkg#export of each key, sorted and joined by commas."""
    rows = refs.select(by, F.concat(pkg, F.lit("#"), export.cast("string")).alias("_r")).distinct()
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("_r")), ",").alias("refs"))


def resolved_stems(asked: DataFrame, index: DataFrame, stem: str, other: Column, value: str) -> DataFrame:
    """asked with the smallest ``value`` whose ``stem`` is asked for, else whose ``other`` form is; null where neither is."""
    a = index.groupBy(stem).agg(F.min(value).alias("_a"))
    b = index.groupBy(other.alias(stem)).agg(F.min(value).alias("_b"))
    return asked.join(a, stem, "left").join(b, stem, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def slice_kinds(fragments: DataFrame, known: DataFrame, key: str, foreign: Column, size: Column, least: int = 200) -> DataFrame:
    """fragments with kind: foreign_leaf, pointer (the store knows its hash), glue (shorter than ``least``) or novel_glue."""
    here = known.select(key).distinct().withColumn("_known", F.lit(True))
    kind = F.when(foreign, "foreign_leaf").when(F.col("_known"), "pointer").when(size < least, "glue").otherwise("novel_glue")
    return fragments.join(here, key, "left").withColumn("kind", kind).drop("_known")


def evidence(text: Column, lang: Column, source: Column, root: Column) -> list[Column]:
    """address (8 characters), behavior (first sentence), signature, guarantees (the first three) and their number."""
    from ..functions.scalars import first_sentence

    lines = F.split(text, "\n")
    return [F.left(root, F.lit(8)).alias("address"), first_sentence(text).alias("behavior"), F.concat(F.lit("("), lang, F.lit(") => "), source).alias("signature"), F.array_join(F.slice(lines, 1, 3), "|").alias("guarantees"), F.size(lines).alias("n")]


def migrated(old: DataFrame, new: DataFrame, version: int, current: int) -> DataFrame:
    """Rows of an older schema version under the current one: columns that came later are null. A newer version is an error, an equal one a plain union."""
    if version > current:
        raise ValueError(f"schema {version} is newer than {current}")
    return old.unionByName(new, allowMissingColumns=version < current)


def gap_reason(foreign: Column, unresolved: Column, null_provenance: Column, absorbed: Column) -> Column:
    """Why a block isn't rebuilt; the first reason that holds."""
    return F.when(foreign, "foreign").when(unresolved, "unresolved").when(null_provenance, "null_provenance").when(absorbed, "glue_absorbed").otherwise("other")


def artifact_status(text: Column, present: Column, least: int = 200, sentinel: str = "TODO") -> Column:
    """missing, placeholder (short, or with the sentinel) or real."""
    return F.when(~present, "missing").when((F.length(text) < least) | F.contains(text, F.lit(sentinel)), "placeholder").otherwise("real")


def pages(rows: DataFrame, key: str, limit: int, cut) -> DataFrame:
    """Every row with its keyset page (from 1) in the order of ``key``, and whether more pages follow: what a client that asks page by page would get."""
    limit = max(1, min(limit, 1000))
    placed = positions(rows.select(key).distinct(), [F.col(key)], cut)
    last = placed.agg(F.max("position")).first()[0] or 0
    page_no = F.ceil(F.col("position") / limit).cast("long")
    return placed.select(key, page_no.alias("page"), (page_no * limit < last).alias("more"))


def submitted(rows: DataFrame, present: DataFrame, errors: Column, made: Column, order: list[str]) -> DataFrame:
    """Rows that a client submits, with their outcome: rejected:<first error>, or what ``stored`` says of the others."""
    rows = rows.withColumn("_error", F.get(errors, 0))
    good = stored(rows.where("_error is null"), present, made, order).drop("_error")
    bad = rows.where("_error is not null").withColumn("outcome", F.concat(F.lit("rejected:"), "_error")).drop("_error")
    return good.unionByName(bad)


def export_vectors(vectors: DataFrame, folder: str, key: str = "vec_id", vec_col: str = "embedding") -> None:
    """Vectors as JSON rows (key, vector as an array of numbers), in the key's order over and within the files."""
    vectors.select(key, F.col(vec_col).cast("array<double>").alias("vector")).repartitionByRange(key).sortWithinPartitions(key).write.json(folder)


def atom_index(cards: DataFrame, vectors: DataFrame, spec: str, root: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(cards of the representatives, the least root of each specification; their vectors; what is missing on either side). An index is consistent
    when nothing is missing."""
    best = cards.groupBy(spec).agg(F.min(root).alias(root))
    has = vectors.select(spec).distinct()
    missing = {"vectors": best.join(has, spec, "left_anti").count(), "cards": has.join(best.select(spec), spec, "left_anti").count()}
    return best.join(has, spec, "left_semi"), vectors.join(best.select(spec), spec, "left_semi"), missing


def subset_report(fresh: DataFrame, committed: DataFrame, root: str, source: str) -> DataFrame:
    """source, missing, first_root of fresh roots that aren't committed, and under a null source the number of committed ones that aren't fresh any more (archived)."""
    lost = fresh.select(root, source).distinct().join(committed.select(root).distinct(), root, "left_anti")
    by_source = lost.groupBy(source).agg(F.count("*").alias("missing"), F.min(root).alias("first_root"))
    old = committed.select(root).distinct().join(fresh.select(root), root, "left_anti")
    return by_source.unionByName(old.agg(F.count("*").alias("missing")).select(F.lit(None).cast("string").alias(source), "missing", F.lit(None).cast("string").alias("first_root")))
