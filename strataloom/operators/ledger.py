"""Bounties, claims, attestations, reputation and retractions as functions of rows and a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000
HALF_LIFE = 180 * DAY
GRANT = 100.0


def bounty_state(now: Column, created: Column, commit_ms: Column, reveal_ms: Column) -> Column:
    """COMMIT until the commit window closes, REVEAL until the reveal window does, then CHECK."""
    return F.when(now < created, "FUTURE").when(now < created + commit_ms, "COMMIT").when(now < created + commit_ms + reveal_ms, "REVEAL").otherwise("CHECK")


def valid_windows(commit_ms: Column, reveal_ms: Column) -> Column:
    hour = DAY // 24
    return commit_ms.between(hour, 72 * hour) & reveal_ms.between(hour // 2, 6 * hour)


def supermajority(valid: Column, total: Column) -> Column:
    return (total > 0) & (3 * valid >= 2 * total)


def tally(attestations: DataFrame, by: list[str], valid: Column) -> DataFrame:
    rows = attestations.groupBy(*by).agg(F.count_if(valid).alias("valid"), F.count("*").alias("total"))
    return rows.withColumn("accepted", supermajority(F.col("valid"), F.col("total")))


def reputation(events: DataFrame, account: str, at: str, delta: str, now: Column) -> DataFrame:
    """Score at ``now``: the grant on the first event and each delta, halved every HALF_LIFE since; a plain sum."""
    decay = lambda t: F.pow(F.lit(0.5), (now - t) / HALF_LIFE)
    out = events.groupBy(account).agg(F.sum(F.col(delta) * decay(F.col(at))).alias("earned"), F.min(at).alias("first"), F.max(at).alias("last_event"), F.count("*").alias("events"))
    return out.select(account, F.round(F.col("earned") + GRANT * decay(F.col("first")), 4).alias("score"), "last_event", "events")


def commitment(artifact: Column, nonce: Column, claimant: Column) -> Column:
    """sha256(sha256(artifact) bytes, nonce, claimant)."""
    return F.sha2(F.concat(F.unhex(F.sha2(artifact.cast("binary"), 256)), nonce.cast("binary"), claimant.cast("binary")), 256)


def slash(base: Column, age_ms: Column) -> Column:
    """Base halved every 30 days, rounded half up."""
    return F.floor(base * F.pow(F.lit(2.0), -age_ms / (30 * DAY)) + 0.5)


def resolved(retractions: DataFrame, accepted: Column, claim: str, order: list[str]) -> DataFrame:
    """ACCEPTED for the first accepted retraction of a claim; any after it REJECTED, and so are those without a majority."""
    rows = retractions.withColumn("_a", F.when(accepted, 1).otherwise(0))
    before = F.coalesce(F.sum("_a").over(Window.partitionBy(claim).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("status", F.when((F.col("_a") == 1) & (before == 0), "ACCEPTED").otherwise("REJECTED")).drop("_a")


def claim_state(now: Column, created: Column, commit_ms: Column, reveal_ms: Column, committed: Column, revealed: Column) -> Column:
    """State of a claim at ``now``. committed, revealed: when it was (null: never). A commitment counts within the commit window, a reveal
    within the reveal window; unrevealed claims lapse when that closes. Null before the commitment, and for one that came too late."""
    closes = created + commit_ms
    ends = closes + reveal_ms
    in_time = (committed >= created) & (committed <= closes) & (committed <= now)
    opened = F.coalesce((revealed >= closes) & (revealed <= ends) & (revealed <= now), F.lit(False))
    return F.when(F.coalesce(in_time, F.lit(False)), F.when(opened, "REVEALED").when(now >= ends, "LAPSED").otherwise("COMMITTED"))


def may_commit(now: Column, created: Column, commit_ms: Column, commit_hash: Column) -> Column:
    """Whether a commitment is taken: the bounty is in its commit window and the hash is 64 hex digits."""
    return (now >= created) & (now <= created + commit_ms) & F.coalesce(commit_hash.rlike("^[0-9a-f]{64}$"), F.lit(False))


def may_reveal(now: Column, created: Column, commit_ms: Column, reveal_ms: Column, commit_hash: Column, told: Column) -> Column:
    """Whether a reveal is taken: within the reveal window, and what is told gives the commitment."""
    closes = created + commit_ms
    return (now >= closes) & (now <= closes + reveal_ms) & F.coalesce(commit_hash == told, F.lit(False))


def may_retract(status: Column, stake: Column, claim_stake: Column, now: Column, revealed: Column) -> Column:
    """Whether a retraction may be filed: a valid claim, twice its stake, within 90 days of the reveal."""
    return F.coalesce((status == "VALID") & (stake >= 2 * claim_stake) & now.between(revealed, revealed + 90 * DAY), F.lit(False))


def listed(rows: DataFrame, by: str, order: list[str], name: str = "position") -> DataFrame:
    """Rows with their place (from 1) in the listing of their key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def attestation_json(fields: dict[str, Column]) -> Column:
    """The canonical text of an attestation that is signed: keys in order, null ones left out, no spaces."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
