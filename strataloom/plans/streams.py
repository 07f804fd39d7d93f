"""Stream operators run to the end over events as a file source, and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cluster import new_path
from ..sources import jsonl
from ..streaming import bounties as BO
from ..streaming import ops as S
from .registering import slice_of, table
from .telemetry import EVENTS, events

QUERIES, SQL, query = slice_of()


def shared(spark) -> str:
    return new_path(spark, "stream")


def stream(spark, sf_dir):
    """events as a file stream with the columns of the telemetry view."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet" if not _is_file(spark, sf_dir) else sf_dir, pathGlobFilter="events.parquet" if _is_file(spark, sf_dir) else "*")
    kind = F.col("event_type")
    outcome = F.when(kind == "click", "passthrough").otherwise(kind)
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t"), F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"), F.get_json_object("props", "$.k").cast("long").alias("candidate_count"), kind.alias("event_type"))


def _is_file(spark, sf_dir) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def ended(spark, df, mode: str = "append"):
    """Run a stream to the end of its source into Parquet in the shared folder and read that."""
    out = shared(spark)
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


@query(f"WITH {EVENTS} SELECT session, seq, round(avg(candidate_count) OVER w, 6) AS mean_candidates, round(avg(CASE WHEN outcome = 'passthrough' THEN 1.0 ELSE 0.0 END) OVER w, 6)::DOUBLE AS bypass_rate FROM e WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def drift_stream(spark, sf_dir):
    out = ended(spark, S.drift_stream(stream(spark, sf_dir).select("session", "seq", "outcome", "candidate_count")))
    return out.select("session", "seq", F.round("mean_candidates", 6).alias("mean_candidates"), F.round("bypass_rate", 6).alias("bypass_rate"))


@query()
def token_bucket(spark, sf_dir):
    """Stateful, so tested against a plain loop."""
    return ended(spark, S.token_bucket(stream(spark, sf_dir).select("session", "seq", "t"), 3.0, 1 / 3_600_000))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return S.windowed(e, "at", "event_type", "1 day").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour', time_bucket(INTERVAL '1 hour', ts)]) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding_hours(spark, sf_dir):
    """Windows of two hours, one an hour."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return S.windowed(e, "at", "event_type", "2 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "user_id")
    return S.sessions(e, "at", "user_id", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {EVENTS}, n AS (SELECT session, t, seq, (row_number() OVER (PARTITION BY session ORDER BY t, seq) - 1) // 50 AS part FROM e) SELECT session, part::INT AS part, count(*) AS n, min(t) AS first_t FROM n GROUP BY session, part")
def envelope_batches(spark, sf_dir):
    rows = jsonl.envelopes(events(spark, sf_dir))
    return rows.select("session", "part", "n", F.get_json_object("body", "$[0].t").cast("long").alias("first_t"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def micro_batch_sink(spark, sf_dir):
    """A stream into two sinks, one of which fails on every batch: the other has all rows."""
    out, failures = shared(spark), []

    def broken(batch, number):
        raise OSError("sink is away")

    run = S.fan_out([("broken", broken), ("store", S.sink_for(f"parquet:{out}/data"))], failures)
    rows = stream(spark, sf_dir).select("seq", "event_type")
    rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("event_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_id"))


@query("WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM d WHERE day + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'")
def late_windows(spark, sf_dir):
    """Days of a stream with a watermark: the third file repeats rows of days that are closed by then, and they are dropped as late.

    What is late is judged by the watermark of the batch before, so a file with the last event alone stands between.
    """
    out = shared(spark)
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    last = e.agg(F.max("at")).first()[0]
    e.coalesce(1).write.parquet(f"{out}/in")
    e.where(F.col("at") == F.lit(last)).coalesce(1).write.mode("append").parquet(f"{out}/in")
    e.where(F.col("at") < F.date_trunc("day", F.lit(last) - F.expr("interval 2 days"))).coalesce(1).write.mode("append").parquet(f"{out}/in")
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    found = ended(spark, S.windowed(rows, "at", "event_type", "1 day"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


_LIVES = "l AS (SELECT p_partkey % 50 AS bounty, p_partkey AS claim, (p_size % 30) * 3600000 + 1700000000000 AS opens, opens + 7200000 AS closes, closes + 3600000 AS ends, opens + (p_partkey % 5) * 1900000 AS committed, CASE WHEN p_partkey % 4 <> 0 THEN closes + (p_partkey % 7) * 700000 - 600000 END AS revealed FROM part), t AS (SELECT *, committed <= closes AS c, coalesce(revealed BETWEEN closes AND ends, false) AS r FROM l)"


@query(f"WITH {_LIVES} SELECT bounty, claim, 'COMMITTED' AS status, committed AS at FROM t WHERE c UNION ALL SELECT bounty, claim, 'REVEALED', revealed FROM t WHERE c AND r UNION ALL SELECT bounty, claim, 'LAPSED', ends FROM t WHERE c AND NOT r AND ends < 1700000000000 + 91000000")
def claim_timers(spark, sf_dir):
    """The life of claims from a stream of commitments and reveals: lapses come from event-time timers, up to a little over 25 hours after the start."""
    out, late = shared(spark), 1000
    k = F.col("p_partkey")
    opens = (F.col("p_size") % 30) * 3_600_000 + F.lit(1_700_000_000_000)
    rows = table(spark, sf_dir, "part").select((k % 50).alias("bounty"), k.alias("claim"), opens.alias("opens"), (opens + 7_200_000).alias("closes"), (opens + 10_800_000).alias("ends"))
    commits = rows.withColumn("kind", F.lit("commit")).withColumn("at", F.col("opens") + (F.col("claim") % 5) * 1_900_000)
    reveals = rows.where("claim % 4 != 0").withColumn("kind", F.lit("reveal")).withColumn("at", F.col("closes") + (F.col("claim") % 7) * 700_000 - 600_000)
    columns = ["bounty", "claim", "kind", "at", "opens", "closes", "ends"]
    reveals.unionByName(commits).select(columns).write.parquet(f"{out}/in/0")
    for n in (1, 2, 3):  # later events move the watermark, one file a batch
        spark.range(1).select(F.lit(-1).cast("long").alias("bounty"), F.lit(-1).cast("long").alias("claim"), F.lit("tick").alias("kind"), (F.lit(1_700_000_000_000 + 91_000_000 + late * 3_600_000) + n - 1).alias("at"), *[F.lit(1 << 50).alias(c) for c in ("opens", "closes", "ends")]).coalesce(1).write.parquet(f"{out}/in/{n}")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/in/0").schema).option("recursiveFileLookup", True).parquet(f"{out}/in/0")
    ticks = spark.readStream.schema(spark.read.parquet(f"{out}/in/0").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in/[123]")
    events = stream.unionByName(ticks).withColumn("ts", F.timestamp_millis("at"))
    with BO.rocks(spark):
        found = ended(spark, BO.claim_transitions(events, f"{late} hours"))
    return found.where("bounty >= 0")
