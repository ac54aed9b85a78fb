"""Log files as a source: lines '[ts] LEVEL: message'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import is_blank, log_fields


def log_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, modified, line_no, line) of all log files that match; lines are numbered within each file, which one task reads whole."""
    files = spark.read.text(pattern, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.split("value", r"\r?\n").alias("l"))
    return rows.select("file", "modified", F.posexplode("l").alias("line_no", "line")).where("line <> ''")


def newest(lines: DataFrame) -> DataFrame:
    """The lines of the file changed last."""
    last = lines.agg(F.max_by("file", F.struct("modified", "file")).alias("file"))  # one row
    return lines.join(F.broadcast(last), "file", "left_semi")


def tail(lines: DataFrame, count: int = 5) -> DataFrame:
    """The last lines in order, parsed: (line_no, timestamp, level, message); blank ones among them are dropped."""
    last = lines.orderBy(F.desc("line_no")).limit(count)
    return last.where(~is_blank(F.col("line"))).select("line_no", log_fields(F.col("line")).alias("f")).select("line_no", "f.*")


def parsed(lines: DataFrame) -> DataFrame:
    return lines.where(~is_blank(F.col("line"))).select(*[c for c in lines.columns if c != "line"], log_fields(F.col("line")).alias("f")).select(*[c for c in lines.columns if c != "line"], "f.*")
