"""Screens, curves, runs and watchlists as CSV, JSON lines or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write(df: DataFrame, path: str, kind: str) -> None:
    """CSV with a header, JSON lines with nulls, or text of one column a line."""
    if kind == "text":
        if len(df.columns) != 1:
            raise ValueError("text takes one column")
        df.select(F.col(df.columns[0]).cast("string").alias("value")).write.text(path)
    elif kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "json":
        df.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no format {kind}")


def read(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """What :func:`write` has written, with its schema."""
    if kind == "text":
        field = schema.fields[0]
        return spark.read.text(path).select(F.col("value").cast(field.dataType).alias(field.name))
    return spark.read.schema(schema).option("header", True).format(kind).load(path)
