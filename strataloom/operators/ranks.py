"""Exact percentiles by rank, without gathering a group's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut


def percentiles(rows: DataFrame, by: list[str], value: str, **wanted: tuple[str, float]) -> DataFrame:
    """by, and a column for each of ``wanted``: ("middle", 0) is the median, the mean of the middle two; ("rank", p) the value of rank ceil(p n); ("floor", p)
    that of rank floor(p n) + 1. Null values don't count; groups without a value have no row.

    Values are counted, the counts sorted over a range exchange, and ranks are what stands before: in the partition, and in those before, of which each group has
    a row a partition. So a group may be all of the table.
    """
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    table = cut(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    per = table.groupBy(*keys, "_part").agg(F.sum("_n").alias("_own"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*keys, "_part", before.alias("_before"), F.sum("_own").over(group).alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    ranked = table.withColumn("_upto", upto).join(per, [*keys, "_part"])
    last = F.col("_before") + F.col("_upto")
    n = F.col("_total")
    at = lambda k: F.max(F.when((last >= k) & (last - F.col("_n") < k), F.col("_v")))
    pick = {
        "middle": lambda p: (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2,
        "rank": lambda p: at(F.greatest(F.lit(1), F.ceil(n * p - 1e-9))),
        "floor": lambda p: at(F.floor(n * p + 1e-9) + 1),
    }
    out = ranked.groupBy(*keys).agg(*[pick[kind](p).alias(name) for name, (kind, p) in wanted.items()])
    return out if by else out.drop("_all")
