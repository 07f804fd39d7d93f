"""The catalogue as a data source: pages by key, commits as a whole, streams of commits."""

import os

import pytest
from pyspark.sql import functions as F

from strataloom.sources import catalogue as C


def rows(spark, a, z):
    return spark.range(a, z).select(F.format_string("%05d", "id").alias("root"), F.to_json(F.struct("id")).alias("wire"))


def roots(df):
    return sorted(r["root"] for r in df.collect())


def test_pages_and_commits(spark, tmp_path):
    path = str(tmp_path / "c")
    assert C.read(spark, path).collect() == []
    C.append(rows(spark, 0, 1000), path)
    C.append(rows(spark, 1000, 1100), f"file://{path}")
    C.append(rows(spark, 0, 0), path)
    got = C.read(spark, path)
    assert roots(got) == [f"{i:05d}" for i in range(1100)]
    assert {r["wire"] for r in got.collect()} == {f'{{"id":{i}}}' for i in range(1100)}
    page = C.read(spark, path, after="00990", until="01005")
    assert roots(page) == [f"{i:05d}" for i in range(991, 1006)]
    assert C.read(spark, path, after="01005").rdd.getNumPartitions() < got.rdd.getNumPartitions()  # files out of the range aren't opened
    assert len(os.listdir(tmp_path / "c" / "log")) == 2


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    C.append(rows(spark, 0, 10), path)
    bad = rows(spark, 10, 500).withColumn("root", F.when(F.col("root") != "00400", F.col("root")))
    with pytest.raises(Exception, match="needs a root"):
        C.append(bad, path)
    assert roots(C.read(spark, path)) == [f"{i:05d}" for i in range(10)]
    assert len(os.listdir(tmp_path / "c" / "parts")) == 1  # the aborted write's files are gone
    with pytest.raises(Exception, match="appended"):
        rows(spark, 0, 5).write.format(C.NAME).mode("overwrite").option("path", path).save()


def test_streams_follow_commits(spark, tmp_path):
    path, out = str(tmp_path / "c"), str(tmp_path / "out")

    def run():
        C.follow(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return roots(spark.read.parquet(out))

    C.append(rows(spark, 0, 20), path)
    assert len(run()) == 20
    C.append(rows(spark, 20, 25), path)
    C.append(rows(spark, 25, 30), path)
    assert run() == [f"{i:05d}" for i in range(30)] == run()
