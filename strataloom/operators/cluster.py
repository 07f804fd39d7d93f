"""What a job needs of the cluster: the folder that all executors share, and this package on the executors.

Both use the classic session's context (a Spark Connect session has none).
"""

from __future__ import annotations

import atexit
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local, an error elsewhere."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="strataloom-"))
    return found or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder: lineage ends there, and a lost executor costs only tasks that still run."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that were cut and are read no more."""
    for t in tables:
        found = t._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if found.isDefined():
            delete(t.sparkSession, found.get())


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that their Python workers can import it wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_shipped", False):
        return
    top = pathlib.Path(__file__).resolve().parent.parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="strataloom-")) / "strataloom_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    sc.addPyFile(str(path))
    sc._strataloom_shipped = True
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)  # executors fetch it from the driver until then
