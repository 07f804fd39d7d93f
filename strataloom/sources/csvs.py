"""CSV with quoted fields, doubled quotes, any line end and line ends inside of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """Rows of ``schema``; an empty field is an empty string, as nothing in the format marks a null."""
    rows = spark.read.schema(schema).csv(path, header=header, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.na.fill("")
