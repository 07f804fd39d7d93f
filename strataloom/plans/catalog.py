"""Names of all queries of the engine, with the SQL each is compared with."""

from __future__ import annotations

import importlib

SLICES = ("discovery", "store", "matching", "telemetry", "ledger", "metrics", "replicate", "similar", "graphs", "benchmarks", "gates", "scalars", "streams", "more", "records", "reports", "exports")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in SLICES:
        for k, v in getattr(importlib.import_module(f"strataloom.plans.{name}"), what).items():
            if k in out:
                raise ValueError(f"two queries are named {k}")
            out[k] = v
    return out


def flagship(spark, sf_dir: str):
    return queries()["discovery_pipeline"](spark, sf_dir)


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
