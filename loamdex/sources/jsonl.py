"""JSON lines and DataFrames as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(seq, data_json) of the lines that are not blank; seq follows the lines' order within files, and the files' names.

    Spark deals the parts of files to tasks by size, so where there are several files one pass counts the lines of each
    part, and a part's first number is the sum of those before it.
    """
    lines = spark.read.text(path)
    mid = F.monotonically_increasing_id().alias("_row")
    if len(lines.inputFiles()) <= 1:
        rows = lines.select(mid.alias("seq"), F.col("value").alias("data_json"))
    else:
        part = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
        rows = lines.select("value", *part, mid)
        parts = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        # one row for each part of a file
        before = F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n") - F.col("_first")
        rows = rows.join(parts.select("_file", "_start", before.alias("_shift")), ["_file", "_start"])
        rows = rows.select((F.col("_row") + F.col("_shift")).alias("seq"), F.col("value").alias("data_json"))
    return rows.filter(F.trim("data_json") != "")


def from_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    rows = [(i, line) for i, line in enumerate(lines) if line.strip()]
    return spark.createDataFrame(rows, "seq long, data_json string")


def from_dataframe(df: DataFrame, path: str | None = None) -> DataFrame:
    """(seq, data_json) of a DataFrame's rows, columns as keys; absent values are left out. path: the column that names a row."""
    columns = [F.col(f"`{c}`").alias("path" if c == path else c) for c in df.columns]
    return df.select(F.monotonically_increasing_id().alias("seq"), F.to_json(F.struct(*columns)).alias("data_json"))
