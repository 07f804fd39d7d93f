"""Telemetry as JSON lines, one file per session: tolerant reading, appending, batching and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "t long, intentHash string, toolName string, candidateCount long, topScore double, substituted boolean, substitutedAtomHash string, latencyMs double, outcome string, candidateAtomHashes array<string>"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of EVENT with session (the file's stem) and bad (not JSON, or without t, outcome or toolName). Blank lines are no rows."""
    lines = spark.read.text(path).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.jsonl)?$", 1).alias("session")).where(F.trim("value") != "")
    rows = lines.withColumn("e", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}))
    bad = F.col("e").isNull() | F.col("e.t").isNull() | F.col("e.outcome").isNull() | F.col("e.toolName").isNull()
    return rows.select("session", "e.*", bad.alias("bad"))


def append_sessions(events: DataFrame, path: str) -> None:
    """Append events under a folder per session."""
    events.write.mode("append").partitionBy("session").json(path)


def ticks(events: DataFrame, seconds: float = 5, most: int = 50) -> DataFrame:
    """session, tick, part, body: what a batcher sends that flushes every ``seconds`` or at ``most`` events, as whole envelopes in time order.

    Ticks count from the session's first event. An envelope has the schema's version, the session, the time of its last event and the events.
    """
    from pyspark.sql import Window

    first = events.groupBy("session").agg(F.min("t").alias("_first"))
    rows = events.join(first, "session").withColumn("tick", F.floor((F.col("t") - F.col("_first")) / (1000 * seconds)).cast("long"))
    n = F.row_number().over(Window.partitionBy("session", "tick").orderBy("t", "seq"))
    rows = rows.withColumn("part", F.floor((n - 1) / most).cast("int"))
    own = [c for c in events.columns if c not in ("session", "t", "seq")]
    batch = F.array_sort(F.collect_list(F.struct("t", "seq", *own)))  # ``most`` events at most
    body = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("session").cast("string").alias("sessionId"), F.max("t").alias("sentAt"), batch.alias("events")))
    return rows.groupBy("session", "tick", "part").agg(F.count("*").alias("n"), body.alias("body"))


def listing(lines: DataFrame) -> DataFrame:
    """name, n, modified, position of each file, the newest first. lines: name, modified."""
    from pyspark.sql import Window

    per = lines.groupBy("name").agg(F.count("*").alias("n"), F.max("modified").alias("modified"))
    return per.withColumn("position", F.row_number().over(Window.orderBy(F.desc("modified"), "name")))  # a row a file


def envelopes(events: DataFrame, most: int = 50) -> DataFrame:
    """session, part, n, body: the events of a session as JSON arrays of ``most`` events at most, in time order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("session").orderBy("t", "seq"))
    rows = events.withColumn("_n", n).withColumn("part", ((F.col("_n") - 1) / most).cast("int"))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t", "outcome"))), lambda e: F.struct(e["t"].alias("t"), e["outcome"].alias("outcome"))))
    return rows.groupBy("session", "part").agg(F.count("*").cast("long").alias("n"), body.alias("body"))


def latest(files: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of the newest file. files: name, modified. lines: name, number, value."""
    newest = files.agg(F.max_by("name", "modified").alias("name"))
    return lines.join(F.broadcast(newest), "name").orderBy(F.desc("number")).limit(n)


MARKER = "kind string, taskSlug string, category string, t long, sessionId string, outcome string"


def markers(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of MARKER with bad (not JSON, an unknown kind, or without slug or time) from lines of text; blank lines are no rows."""
    rows = lines.where(F.trim(value) != "").select(F.from_json(value, MARKER, {"mode": "PERMISSIVE"}).alias("m"))
    ok = F.col("m.kind").isin("task-begin", "task-end") & F.col("m.taskSlug").isNotNull() & F.col("m.t").isNotNull()
    return rows.select("m.*", (~F.coalesce(ok, F.lit(False))).alias("bad"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    return markers(spark.read.text(path))
