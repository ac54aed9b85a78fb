"""Queries on schedules, logs and settings: small tables of the queries' own, crossed with the times of all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.dates import next_run as next_run_at
from threadloom.functions.dates import second_text
from threadloom.operators import schedules as sch
from threadloom.plans import sql
from threadloom.plans.records import tickets
from threadloom.session import table

#: (id, interval, time, days, enabled, next_run)
ROWS = [
    ("a", "hourly", None, None, True, None),
    ("b", "daily", "09:30", None, True, "2024-01-10T09:30:00"),
    ("c", "weekly", "23:59", "0,2,4", True, None),
    ("d", "weekly", "00:05", "6", True, "2024-01-20T00:05:00"),
    ("e", "daily", "12:00", None, False, None),
    ("f", "daily", "25:00", None, True, None),
]
_JSON = '{"x": {"name": "night", "interval": "daily", "time": "02:00", "next_run": "2024-01-05T02:00:00"}, "b": {"interval": "weekly", "time": "01:00", "days": "1, 3", "enabled": false}}'


def _schedules(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ROWS, "id string, interval string, time string, days string, enabled boolean, at string")
    return rows.withColumn("next_run", F.try_to_timestamp("at")).drop("at")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of all events, crossed with the six schedules."""
    times = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("now"))
    return times.crossJoin(F.broadcast(_schedules(spark)))  # six rows


def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = next_run_at(F.col("now"), F.col("interval"), F.col("time"), tx.split_numbers(F.col("days")))
    return _times(spark, sf_dir).select("event_id", "id", F.unix_micros(following).alias("next_us"))


def due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sch.due(_times(spark, sf_dir), F.col("now")).select("event_id", "id")


def schedule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules in use updated by a JSON text: equal ids are replaced whole."""
    read = sch.from_json(spark.createDataFrame([(_JSON,)], "j string"), "j").select("id", "interval", "time", "days", "enabled", "next_run")
    return sch.merged(_schedules(spark), read).select("id", "interval", "time", "days", "enabled", second_text(F.col("next_run")).alias("next_run"))


def schedule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sch.status(_schedules(spark)).select("total", "active", second_text(F.col("next_run")).alias("next_run"))


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made of all events, whole, without a level, and without marks, read again."""
    stamp = second_text(F.col("ts").cast("timestamp"))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), stamp, F.lit("] WARNING: "), "event_type", F.lit(": "), F.col("user_id").cast("string")))
    line = line.when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), stamp, F.lit("] "), F.col("event_type"))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", tx.log_fields(line).alias("f")).select("event_id", "f.*")


def url_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles as parts of an address, and put back."""
    title = F.col("title")
    quoted = F.replace(F.url_encode(title), F.lit("+"), F.lit("%20"))
    return tickets(spark, sf_dir).where("title IS NOT NULL").select("id", F.url_decode(quoted).alias("title"), F.contains(quoted, F.lit(" ")).alias("has_space"))


def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles stripped, lowered and shortened, with line ends escaped and the place of the first 'e'."""
    title = tx.strip(F.col("title"))
    return tickets(spark, sf_dir).where("title IS NOT NULL").select(
        "id", tx.shortened(title, 20).alias("short"), F.lower(title).alias("lowered"), (F.instr(title, F.lit("e")) - 1).alias("first_e"), tx.escape_newlines(F.concat(title, F.lit("\n"))).alias("escaped")
    )


def translated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by an exact table, else by patterns in order."""
    words = {"VPN bricht ab": "VPN drops", "Mailbox voll": "Mailbox full"}
    return tickets(spark, sf_dir).where("title IS NOT NULL").select("id", tx.translate(F.col("title"), words, [("^Fehler (\\d+)", "Error $1"), ("Passwort", "Password")]).alias("title"))


QUERIES = {f.__name__: f for f in (next_run, due_schedules, schedule_merge, schedule_status, log_parse, url_encoded, short_titles, translated_titles)}

_TARGET = "date_trunc('day', ts) + INTERVAL (hh) HOUR + INTERVAL (mi) MINUTE"
_S = """s AS (SELECT * FROM (VALUES ('a', 'hourly', NULL, NULL, true, NULL), ('b', 'daily', '09:30', NULL, true, TIMESTAMP '2024-01-10 09:30:00'), ('c', 'weekly', '23:59', '0,2,4', true, NULL),
  ('d', 'weekly', '00:05', '6', true, TIMESTAMP '2024-01-20 00:05:00'), ('e', 'daily', '12:00', NULL, false, NULL), ('f', 'daily', '25:00', NULL, true, NULL)) v(id, interval_, time_, days, enabled, next_run))"""
_PARTS = f"""{_S}, t AS (SELECT event_id, ts, s.*, (isodow(ts) - 1) AS today, CASE WHEN split_part(time_, ':', 1)::INT < 24 THEN split_part(time_, ':', 1)::INT END AS hh, split_part(time_, ':', 2)::INT AS mi,
  list_transform(string_split(days, ','), lambda d: d::INT) AS ds FROM events CROSS JOIN s), u AS (SELECT *, {_TARGET} AS target FROM t)"""
_TICKETS = f"WITH {sql.TICKETS}"

ORACLES = {
    "next_run": f"""WITH {_PARTS} SELECT event_id, id, epoch_us(CASE interval_ WHEN 'hourly' THEN ts + INTERVAL 1 HOUR WHEN 'daily' THEN CASE WHEN ts > target THEN target + INTERVAL 1 DAY ELSE target END
        ELSE CASE WHEN ts > target THEN target + INTERVAL (list_min(list_filter(range(1, 8), lambda a: list_contains(ds, ((today + a) % 7)::INT)))) DAY ELSE target END END) AS next_us FROM u""",
    "due_schedules": f"WITH {_PARTS} SELECT event_id, id FROM u WHERE enabled AND (next_run IS NULL OR ts >= next_run) AND (interval_ IN ('hourly', 'daily') OR list_contains(ds, today::INT))",
    "schedule_merge": f"""WITH {_S} SELECT id, interval_ AS "interval", time_ AS "time", days, enabled, strftime(next_run, '%Y-%m-%d %H:%M:%S') AS next_run FROM s WHERE id <> 'b'
        UNION ALL SELECT 'x', 'daily', '02:00', NULL, true, '2024-01-05 02:00:00' UNION ALL SELECT 'b', 'weekly', '01:00', '1, 3', false, NULL""",
    "schedule_status": f"WITH {_S} SELECT count(*) AS total, count(*) FILTER (enabled) AS active, strftime(min(next_run) FILTER (enabled), '%Y-%m-%d %H:%M:%S') AS next_run FROM s",
    "log_parse": """SELECT event_id, CASE WHEN event_id % 3 = 0 OR (event_id % 3 = 1 AND false) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "timestamp", CASE WHEN event_id % 3 = 0 THEN 'WARNING' ELSE 'INFO' END AS level,
        CASE WHEN event_id % 3 = 0 THEN event_type || ': ' || user_id WHEN event_id % 3 = 1 THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || event_type ELSE event_type END AS message FROM events""",
    "url_encoded": f"{_TICKETS} SELECT id, title, false AS has_space FROM tks WHERE title IS NOT NULL",
    "short_titles": f"""{_TICKETS}, c AS (SELECT id, {sql.strip('title')} AS t FROM tks WHERE title IS NOT NULL)
        SELECT id, CASE WHEN length(t) > 20 THEN left(t, 20) || '...' ELSE t END AS short, lower(t) AS lowered, (instr(t, 'e') - 1)::INT AS first_e, t || '\\n' AS escaped FROM c""",
    "translated_titles": f"""{_TICKETS} SELECT id, CASE title WHEN 'VPN bricht ab' THEN 'VPN drops' WHEN 'Mailbox voll' THEN 'Mailbox full'
        ELSE regexp_replace(regexp_replace(title, '^Fehler (\\d+)', 'Error \\1', 'g'), 'Passwort', 'Password', 'g') END AS title FROM tks WHERE title IS NOT NULL""",
}
