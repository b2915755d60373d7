"""Exports and imports: JSON and CSV files, and lines of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON objects, or of documents that hold many lines; bad rows are left out by the schema's nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Quoted cells, quotes doubled, a header per file."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", chr(34)).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def range_or_newest(df: DataFrame, at: str, key: str, start: str, end: str, newest: int = 500) -> DataFrame:
    """The rows of a time range (both ends in it), or the NEWEST rows if the range is empty; one plan, without a count on the driver."""
    inside = df.where(F.col(at).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    none = inside.limit(1).agg(F.count("*").alias("_n"))
    others = df.orderBy(F.desc(at), F.desc(key)).limit(newest).join(F.broadcast(none), F.lit(True)).where("_n = 0").drop("_n")
    return inside.unionByName(others)


def error_lines(spark: SparkSession, path: str, newest: int = 5) -> DataFrame:
    """(at, line) of the newest log lines with ERROR; at is the time in brackets at the start of a line."""
    lines = spark.read.text(path).where(F.col("value").contains("ERROR"))
    at = F.regexp_extract("value", r"^\[([^\]]+)\]", 1)
    return lines.select(at.alias("at"), F.col("value").alias("line")).orderBy(F.desc("at"), F.desc("line")).limit(newest)
