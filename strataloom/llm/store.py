"""The shared folder, and this package on the executors with Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..operators import cluster
from ..operators.cluster import cut, delete, new_path, release, shared_dir

__all__ = ["cut", "delete", "new_path", "release", "shared_dir", "ship"]

#: Bytes of an Arrow batch that goes to a Python worker, about; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python workers can import it anywhere; and let the session's Arrow
    batches hold BATCH_BYTES at most, as each is held by the JVM and by the worker."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        held = spark.conf.get(limit).rstrip("b")
    except PySparkException:  # a version without the setting
        held = ""
    if held.isdigit() and int(held) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    cluster.ship(spark)
