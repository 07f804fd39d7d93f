"""The life of bounties and claims from a stream of events, with event-time timers and state that ends with them.

A bounty's claims are keyed by blocks of their numbers, so a bounty with a third of all claims is many keys and a key has a bound; calls from a key to its state
cost far more than the claims in it. Within a key, state is one row for all claims with the same end: when the reveal window is over, the row goes, and the
key's timer moves to the next end. Where numbers lie far apart, a key holds one claim. What counts is the time an event carries, not the batch
it comes in, so a stream gives what ``ledger.claim_state`` gives for the watermark's time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cluster import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time that hasn't come; state comes back from Arrow, where a null of a whole number would be NaN.
NEVER = -(1 << 62)
#: Claims of a bounty whose numbers lie in one block of 2**BLOCK_BITS share a key; that is as many as a key can hold.
BLOCK_BITS = 13
CLAIM_OUT = "bounty long, claim long, status string, at long"
CLAIM_ROW = Row("bounty", "claim", "status", "at")
BOUNTY_OUT = "bounty long, status string, at long"


def _within(low, at, high) -> bool:
    """Whether a time lies in a window; one that is unknown doesn't."""
    return None not in (low, at, high) and low <= at <= high


@contextmanager
def rocks(spark: SparkSession):
    """Within it streams start with the state store that timers need; a stream that has started keeps it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class ClaimLife(StatefulProcessor):
    """Rows (bounty, block, claim, kind commit or reveal, at, opens, closes, ends; milliseconds) -> COMMITTED, then REVEALED or LAPSED.

    A commitment counts from opens to closes, a reveal from closes to ends and only after a commitment; of several the first one counts. A reveal that comes
    in an earlier batch than its commitment waits for it. Rows without an end count for nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "ends long", "claims array<long>, committed array<long>, revealed array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lives, by_end, changed = {}, {}, set()
        for (ends,), known in self.held.iterator():
            by_end[ends] = list(known[0])
            for claim, committed, revealed in zip(*known, strict=True):
                lives[claim] = [committed, revealed, ends]
        first = min(by_end, default=None)
        for r in sorted((r for r in rows if r.ends is not None), key=lambda r: (r.at is None, r.at, r.kind)):
            if r.claim not in lives:
                lives[r.claim] = [NEVER, NEVER, r.ends]
                by_end.setdefault(r.ends, []).append(r.claim)
                changed.add(r.ends)
            life = lives[r.claim]
            if r.kind == "commit" and life[0] == NEVER and _within(r.opens, r.at, r.closes):
                life[0] = r.at
                yield CLAIM_ROW(key[0], r.claim, "COMMITTED", r.at)
            elif r.kind == "reveal" and life[1] == NEVER and _within(r.closes, r.at, r.ends):
                life[1] = r.at
            else:
                continue
            changed.add(life[2])
            if NEVER not in life[:2]:
                yield CLAIM_ROW(key[0], r.claim, "REVEALED", life[1])
        for ends in changed:
            claims = by_end[ends]
            self.held.updateValue((ends,), (claims, [lives[c][0] for c in claims], [lives[c][1] for c in claims]))
        if changed and (first is None or min(changed) < first):
            self.handle.registerTimer(min(changed) + 1)  # a reveal at the very end still counts

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        rest = []
        for (ends,), known in list(self.held.iterator()):
            if ends + 1 > over:
                rest.append(ends)
                continue
            for claim, committed, revealed in zip(*known, strict=True):
                if committed != NEVER and revealed == NEVER:
                    yield CLAIM_ROW(key[0], claim, "LAPSED", ends)
            self.held.removeKey((ends,))
        if rest:
            self.handle.registerTimer(min(rest) + 1)

    def close(self) -> None:
        pass


class BountyLife(StatefulProcessor):
    """Rows (bounty, opens, closes, ends) -> COMMIT at its opening, REVEAL when the commit window closes, CHECK when the reveal window does; then no state is left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "closes long, ends long, revealing boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        first = pd.concat(list(rows)).sort_values("opens").iloc[0]
        if not self.held.exists():
            self.held.update((int(first.closes), int(first.ends), False))
            self.handle.registerTimer(int(first.closes))
            out.append((*key, "COMMIT", int(first.opens)))
        yield pd.DataFrame(out, columns=["bounty", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            closes, ends, revealing = self.held.get()
            if not revealing:
                out.append((*key, "REVEAL", closes))
                self.held.update((closes, ends, True))
                self.handle.registerTimer(ends)
            else:
                out.append((*key, "CHECK", ends))
                self.held.clear()
        yield pd.DataFrame(out, columns=["bounty", "status", "at"])

    def close(self) -> None:
        pass


def claim_transitions(events: DataFrame, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(bounty, claim, status, at) of a stream with the columns of ``ClaimLife`` and its event time; LAPSED comes when the watermark passes the reveal window."""
    ship(events.sparkSession)
    blocks = events.withWatermark(time, late).withColumn("block", F.shiftright("claim", BLOCK_BITS))
    return blocks.groupBy("bounty", "block").transformWithState(ClaimLife(), CLAIM_OUT, "Append", "EventTime")


def bounty_transitions(events: DataFrame, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(bounty, status, at) of a stream with the columns of ``BountyLife`` and its event time."""
    ship(events.sparkSession)
    return events.withWatermark(time, late).groupBy("bounty").transformWithStateInPandas(BountyLife(), BOUNTY_OUT, "Append", "EventTime")
