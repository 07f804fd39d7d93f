"""Claims and bounties from streams whose files come in any order, against the states that the ledger gives for one time."""

import random

from pyspark.sql import functions as F

from strataloom.operators import ledger as L
from strataloom.streaming import bounties as B

HOUR = 3_600_000
START = 1_700_000_000_000 // HOUR  # hours


def run(spark, tmp_path, df, f, batches):
    """Each list of batches is a file, read one at a time; the last event moves the watermark."""
    schema = df.schema
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        last = sorted((tmp_path / "in").glob("part-*"), key=lambda p: p.stat().st_mtime)[-1]
        last.rename(tmp_path / "in" / f"{n:03d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = stream.withColumn("ts", F.timestamp_millis("at"))
    with B.rocks(spark):
        q = f(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect(), q


def test_claims(spark, tmp_path):
    rng = random.Random(4)
    rows, lives, now = [], [], (START + 40) * HOUR
    for claim in range(60):
        opens = (START + rng.randint(0, 10)) * HOUR
        closes, ends = opens + 3 * HOUR, opens + 5 * HOUR
        if claim % 9 == 0:  # still open at the end
            closes, ends = (START + 39) * HOUR, (START + 60) * HOUR
        committed = rng.choice([opens, opens + HOUR, closes, closes + 1, None])
        revealed = rng.choice([closes - 1, closes, closes + HOUR, ends, ends + 1, None])
        lives.append((claim % 5, claim, opens, closes, ends, committed, revealed))
        rows += [(claim % 5, claim, kind, at, opens, closes, ends) for kind, at in (("commit", committed), ("reveal", revealed)) if at is not None and at <= now]
    rng.shuffle(rows)
    schema = "bounty long, claim long, kind string, at long, opens long, closes long, ends long"
    df = spark.createDataFrame(rows, schema)
    tick = lambda at: [(-1, -1, "tick", at, 0, 0, at + 10**9)]
    late = 100 * HOUR
    got, q = run(spark, tmp_path, df, lambda r: B.claim_transitions(r, f"{late // HOUR} hours"), [rows[:20], rows[20:50], rows[50:], tick(now + late), tick(now + late + 1)])
    found = {}
    for r in got:
        found.setdefault((r["bounty"], r["claim"]), []).append((r["at"], r["status"]))
    state = L.claim_state(F.lit(now), F.col("opens"), F.col("closes") - F.col("opens"), F.col("ends") - F.col("closes"), F.col("committed"), F.col("revealed"))
    want = {(r["bounty"], r["claim"]): r["s"] for r in spark.createDataFrame(lives, "bounty long, claim long, opens long, closes long, ends long, committed long, revealed long").withColumn("s", state).collect()}
    assert {k: sorted(v)[-1][1] for k, v in found.items()} == {k: s for k, s in want.items() if s}
    assert all(sorted(v)[0][1] == "COMMITTED" and len(v) <= 2 for v in found.values())
    assert {"COMMITTED", "REVEALED", "LAPSED"} == set(want.values()) - {None}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[-1] < max(held)  # ended claims leave no state


def test_bounties(spark, tmp_path):
    rows = [(b, *[(START + b + h) * HOUR for h in (0, 0, 2, 5)]) for b in range(20)]
    schema = "bounty long, at long, opens long, closes long, ends long"
    tick = lambda at: [(-1, at, at, at + 10**9, at + 2 * 10**9)]
    now = (START + 15) * HOUR + 1
    got, _ = run(spark, tmp_path, spark.createDataFrame(rows, schema), lambda r: B.bounty_transitions(r, "50 hours"), [rows[:10], rows[10:], tick(now + 50 * HOUR), tick(now + 50 * HOUR + 1), tick(now + 50 * HOUR + 2)])
    found = {(r["bounty"], r["status"], r["at"]) for r in got if r["bounty"] >= 0}
    want = {(b, "COMMIT", o) for b, _, o, _, _ in rows} | {(b, "REVEAL", c) for b, _, _, c, _ in rows if c <= now} | {(b, "CHECK", e) for b, _, _, _, e in rows if e <= now}
    assert found == want


def test_claims_share_the_state_of_their_block(spark, tmp_path):
    """Many claims of a bounty take few rows of state and few timers; what comes in later batches still meets its claim."""
    opens, closes, ends = START * HOUR, (START + 2) * HOUR, (START + 4) * HOUR
    later = ends + 100 * HOUR
    numbers = [*range(3000), -1, -(1 << 62), (1 << 62) + 5, None]
    life = lambda c, kind, at: (7, c, kind, at, opens, closes, later if c and c % 2 else ends)
    commits = [life(c, "commit", opens + 1) for c in numbers]
    reveals = [life(c, "reveal", closes + 1) for c in numbers if c and c % 3 == 0]
    again = [life(c, kind, at) for c in numbers[:50] for kind, at in (("commit", opens + 2), ("reveal", closes + 2))]
    bounds = ends + 2
    tick = lambda at: [(-1, -1, "tick", at, 0, 0, at + 10**10)]
    df = spark.createDataFrame(commits, "bounty long, claim long, kind string, at long, opens long, closes long, ends long")
    files = [reveals[:500], commits, reveals[500:], again, tick(bounds + 90 * HOUR), tick(bounds + 90 * HOUR + 1)]
    got, q = run(spark, tmp_path, df, lambda r: B.claim_transitions(r, "90 hours"), files)
    found = sorted(((r["claim"], r["status"], r["at"]) for r in got if r["bounty"] == 7), key=str)
    revealed = {c: closes + 1 for c in numbers if c and c % 3 == 0} | {c: closes + 2 for c in numbers[:50] if c % 3}
    revealed[0] = closes + 2
    want = [(c, "COMMITTED", opens + 1) for c in numbers] + [(c, "REVEALED", at) for c, at in revealed.items()]
    want += [(c, "LAPSED", ends) for c in numbers if c not in revealed and not (c and c % 2)]
    assert found == sorted(want, key=str)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 100 and held[-1] < max(held)


def test_claim_timers_over_many_files(spark, sf, tmp_path):
    """All of the table comes before the ticks that move the watermark, however many files it makes."""
    from strataloom.plans import streams

    part = spark.read.parquet(f"{sf}/part.parquet")
    part.repartition(80).write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = streams.claim_timers(spark, sf).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = streams.claim_timers(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(want) and want
