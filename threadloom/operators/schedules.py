"""Schedules: which are due, when they run next, merging of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.dates import next_run, parse_iso
from threadloom.functions.text import split_numbers

SCHEMA = "struct<id: string, name: string, interval: string, time: string, days: string, enabled: boolean, last_run: string, next_run: string, config: map<string, string>>"


def from_json(df: DataFrame, column: str) -> DataFrame:
    """One row for each schedule of JSON texts that map ids to schedules; text that is no such JSON gives no rows."""
    entries = df.select(F.explode(F.from_json(column, f"map<string, {SCHEMA}>")).alias("key", "s"))
    rows = entries.select(F.coalesce("s.id", "key").alias("id"), "s.name", "s.interval", "s.time", "s.days", "s.enabled", "s.last_run", "s.next_run", "s.config")
    return rows.withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("last_run", parse_iso(F.col("last_run"))).withColumn("next_run", parse_iso(F.col("next_run")))


def to_json(schedules: DataFrame) -> DataFrame:
    """The same as one JSON text; schedules are a handful of settings."""
    entry = F.struct(*[F.col(c) if c not in ("last_run", "next_run") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in schedules.columns])
    entries = F.collect_list(F.struct(F.col("id").alias("key"), entry.alias("value")))
    by_id = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return schedules.agg(F.to_json(F.map_from_entries(by_id)).alias("json"))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules whose time has come or that never had one; weekly ones only on their days."""
    come = F.col("next_run").isNull() | (now >= F.col("next_run"))
    on_day = F.coalesce(F.array_contains(split_numbers(F.col("days")), F.weekday(now)), F.lit(False))
    fits = (F.col("interval") == "hourly") | (F.col("interval") == "daily") & F.col("time").isNotNull() | (F.col("interval") == "weekly") & F.col("time").isNotNull() & on_day
    return schedules.where(F.col("enabled") & come & fits)


def advanced(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules after a run now: last_run and next_run set."""
    following = next_run(now, F.col("interval"), F.col("time"), split_numbers(F.col("days")))
    return schedules.withColumn("next_run", following).withColumn("last_run", now)


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All keys of both; of a key in both, the new row stands whole."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def create(schedules: DataFrame, row: DataFrame, now: Column) -> DataFrame:
    """With a new schedule whose first run is computed."""
    first = row.withColumn("next_run", next_run(now, F.col("interval"), F.col("time"), split_numbers(F.col("days"))))
    return merged(schedules, first.select(*schedules.columns))


def toggled(schedules: DataFrame, key: str) -> DataFrame:
    return schedules.withColumn("enabled", F.when(F.col("id") == key, ~F.col("enabled")).otherwise(F.col("enabled")))


def removed(schedules: DataFrame, key: str) -> DataFrame:
    return schedules.where(F.col("id") != key)


def status(schedules: DataFrame) -> DataFrame:
    return schedules.agg(F.count("*").alias("total"), F.count_if("enabled").alias("active"), F.min(F.when(F.col("enabled"), F.col("next_run"))).alias("next_run"))
