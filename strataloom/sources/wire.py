"""The wire form of rows: one JSON object a row, binary columns as base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_wire(rows: DataFrame, binary: list[str] = ()) -> DataFrame:
    """One column, wire: JSON with the columns in name order."""
    cols = [F.base64(c).alias(c) if c in binary else F.col(c) for c in sorted(rows.columns)]
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("wire"))


def from_wire(rows: DataFrame, schema: str, binary: list[str] = (), column: str = "wire") -> DataFrame:
    """Rows of ``schema``; malformed JSON gives a row of nulls."""
    kinds = T._parse_datatype_string(schema)
    read = T.StructType([T.StructField(f.name, T.StringType() if f.name in binary else f.dataType) for f in kinds.fields])
    out = rows.select(F.from_json(column, read).alias("r"))
    return out.select(*[(F.unbase64(F.col("r").getField(f.name)) if f.name in binary else F.col("r").getField(f.name)).alias(f.name) for f in kinds.fields])


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])
