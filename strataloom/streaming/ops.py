"""Streams: drift windows and token buckets with state, micro-batch sinks, windows with watermarks. Bounty timers are in bounties.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DRIFT_OUT = "session long, seq long, mean_candidates double, bypass_rate double"


def drift_stream(events: DataFrame, window: int = 20) -> DataFrame:
    """Per session the means over its last ``window`` events; the state holds no more than these.

    A session's events of a micro-batch are ordered by seq as a whole; those of a later micro-batch come after them.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            held = [*held, (float(r.candidate_count), 1.0 if r.outcome == "passthrough" else 0.0)][-window:]
            out.append((int(key[0]), int(r.seq), sum(h[0] for h in held) / len(held), sum(h[1] for h in held) / len(held)))
        state.update(tuple(list(x) for x in zip(*held, strict=True)))
        yield pd.DataFrame(out, columns=["session", "seq", "mean_candidates", "bypass_rate"])

    return events.groupBy("session").applyInPandasWithState(step, DRIFT_OUT, "candidates array<double>, bypass array<double>", "append", GroupStateTimeout.NoTimeout)


BUCKET_OUT = "session long, seq long, allowed boolean, left double"


def token_bucket(events: DataFrame, capacity: float, per_ms: float) -> DataFrame:
    """Per session a bucket filled at per_ms a millisecond up to the capacity; each event takes one token or is refused.

    A session's events of a micro-batch are ordered by (t, seq) as a whole; one that comes in a later micro-batch with an earlier
    time fills nothing up.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, at = state.get if state.exists else (capacity, -1)
        out = []
        for r in pd.concat(list(batches)).sort_values(["t", "seq"]).itertuples():
            level = min(capacity, level + (0 if at < 0 else max(0, r.t - at)) * per_ms)
            at = max(at, int(r.t))
            ok = level >= 1
            level -= 1 if ok else 0
            out.append((int(key[0]), int(r.seq), ok, level))
        state.update((level, at))
        yield pd.DataFrame(out, columns=["session", "seq", "allowed", "left"])

    return events.groupBy("session").applyInPandasWithState(step, BUCKET_OUT, "level double, at long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, at: str, by: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts with a watermark (an extension: the original has no event time)."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def fan_out(sinks: list[tuple[str, Callable[[DataFrame, int], None]]], failures: list | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that gives a batch to every sink; a sink's failure is noted and doesn't stop the others."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks:
                try:
                    sink(batch, number)
                except Exception as e:  # noqa: BLE001  one sink's failure is its own
                    if failures is not None:
                        failures.append((name, number, str(e)))
        finally:
            batch.unpersist()

    return run


def sink_for(url: str) -> Callable[[DataFrame, int], None]:
    """A writer by scheme: file:, parquet: or none."""
    kind, _, path = url.partition(":")
    if kind in ("", "none", "noop"):
        return lambda b, n: b.write.format("noop").mode("append").save()
    if kind in ("file", "json"):
        return lambda b, n: b.write.mode("append").json(path)
    if kind == "parquet":
        return lambda b, n: b.write.mode("append").parquet(path)
    raise ValueError(f"no sink for {url}")
