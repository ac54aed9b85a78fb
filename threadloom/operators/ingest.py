"""From records and their articles to the chunks that are stored: payloads, ids, what is new, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import Settings
from threadloom.functions.dates import second_text, seconds_between
from threadloom.functions.ids import point_id
from threadloom.functions.models import embed, hashing_embedder
from threadloom.functions.text import normalize_text
from threadloom.operators.chunking import chunk_rows
from threadloom.operators.records import ripe, sender_kind, skipped_title, without

POINT_COLUMNS = "point_id ticket_id ticket_url status closed_at created_at article_id sender_type content_type is_first_user_article article_position chunk_index text".split()


def base_payload(url: str) -> list[Column]:
    """What all chunks of a record share."""
    return [
        F.col("id").alias("ticket_id"),
        F.concat(F.lit(url.rstrip("/") + "/#ticket/zoom/"), F.col("id").cast("string")).alias("ticket_url"),
        F.lit("closed").alias("status"),
        F.col("close_at").alias("closed_at"),
        F.col("created_at"),
    ]


def title_rows(tickets: DataFrame, url: str, clean=normalize_text) -> DataFrame:
    """One chunk for each title that isn't empty once cleaned; titles are never cut."""
    literals = [F.lit(0).cast("long").alias("article_id"), F.lit("User").alias("sender_type"), F.lit("title").alias("content_type"), F.lit(False).alias("is_first_user_article"), F.lit(-1).alias("article_position"), F.lit(0).alias("chunk_index")]
    rows = tickets.select(*base_payload(url), *literals, clean(F.col("title")).alias("text"))
    return rows.where("text <> ''")


def article_rows(tickets: DataFrame, articles: DataFrame, url: str, clean=normalize_text, size: int = 450, overlap: int = 50, longest: int = 512) -> DataFrame:
    """The chunks of each article of the records; the first article counts as the user's first whoever sent it."""
    bodies = articles.select(
        F.col("ticket_id").alias("__t"),
        F.coalesce(F.col("id"), F.lit(0)).alias("article_id"),
        sender_kind(F.col("sender_type")).alias("sender_type"),
        F.lit("article").alias("content_type"),
        (F.col("article_position") == 0).alias("is_first_user_article"),
        "article_position",
        clean(F.col("body")).alias("text"),
    )
    joined = tickets.select(*base_payload(url)).join(bodies.where("text <> ''"), F.col("ticket_id") == F.col("__t")).drop("__t")
    return chunk_rows(joined, "text", size, overlap, longest)


def point_rows(titles: DataFrame, articles: DataFrame) -> DataFrame:
    """Both kinds of chunks in one table, with their ids."""
    both = titles.unionByName(articles)
    return both.withColumn("point_id", point_id(F.col("ticket_id"), F.col("article_id"), F.col("chunk_index"))).select(*POINT_COLUMNS)


def eligible(tickets: DataFrame, as_of: Column, settings: Settings) -> DataFrame:
    """Records old enough for the index, with a flag ``skipped`` for titles that keep them out."""
    old = tickets.where(ripe(as_of, settings.min_age_days, settings.start_date))
    return old.withColumn("skipped", skipped_title(F.col("title")))


@dataclass
class Ingest:
    """The frames of one ingest: all chunks, those not yet stored, and what became of each record."""

    chunks: DataFrame
    pending: DataFrame
    outcomes: DataFrame


def ingest(tickets: DataFrame, articles: DataFrame, stored: DataFrame, as_of: Column, settings: Settings = Settings(), clean=normalize_text) -> Ingest:
    """All lazily: records by date and title, their chunks, and the chunks whose id isn't stored yet.

    A chunk keeps its id when its text changes, so a changed article isn't stored again.
    """
    seen = eligible(tickets, as_of, settings)
    used = seen.where(~F.col("skipped")).drop("skipped")
    bodies = article_rows(used, articles, settings.ticket_url, clean, size=settings.chunk_size, overlap=settings.chunk_overlap, longest=settings.chunk_max)
    chunks = point_rows(title_rows(used, settings.ticket_url, clean), bodies)
    pending = without(chunks, stored, "point_id")
    return Ingest(chunks, pending, ticket_outcomes(seen, chunks, pending, articles))


def ticket_outcomes(seen: DataFrame, chunks: DataFrame, pending: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, outcome, n_chunks, n_new, n_articles): what became of each record that came through the date filter."""
    made = chunks.groupBy("ticket_id").agg(F.count("*").alias("n_chunks"))
    new = pending.groupBy("ticket_id").agg(F.count("*").alias("n_new"))
    fetched = articles.groupBy("ticket_id").agg(F.count("*").alias("n_articles"))
    rows = seen.select("id", "skipped")
    for counted in (made, new, fetched):
        rows = rows.join(counted.withColumnRenamed("ticket_id", "id"), "id", "left")
    rows = rows.fillna(0, ["n_chunks", "n_new", "n_articles"])
    outcome = F.when(F.col("skipped"), "skipped_title").when(F.col("n_chunks") == 0, "empty").when(F.col("n_new") == 0, "skipped_existing").otherwise("processed")
    return rows.select("id", outcome.alias("outcome"), "n_chunks", "n_new", F.when(F.col("skipped"), F.lit(0)).otherwise(F.col("n_articles")).alias("n_articles"))


def metrics(outcomes: DataFrame) -> DataFrame:
    """One row of counters."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.agg(
        F.count("*").alias("total_tickets_seen"),
        count("skipped_title").alias("tickets_skipped_title"),
        count("skipped_existing").alias("tickets_skipped_existing"),
        count("processed").alias("tickets_processed"),
        F.coalesce(F.sum("n_new"), F.lit(0)).alias("total_chunks_created"),
        F.coalesce(F.sum("n_articles"), F.lit(0)).alias("articles_processed"),
    )


def metrics_text(row: DataFrame, start: Column, end: Column) -> DataFrame:
    """The counters as a report, one text."""
    lines = [
        F.lit("=== Ingestion ==="),
        F.concat(F.lit("Start: "), F.coalesce(second_text(start), F.lit("N/A"))),
        F.concat(F.lit("End: "), F.coalesce(second_text(end), F.lit("N/A"))),
        F.concat(F.lit("Seconds: "), F.coalesce(seconds_between(start, end).cast("string"), F.lit("N/A"))),
        F.lit(""),
        F.lit("COUNTS:"),
        *[F.concat(F.lit(f"  {name}: "), F.col(name).cast("string")) for name in row.columns],
    ]
    return row.select(F.array_join(F.array(*lines), "\n").alias("report"))


def with_vectors(pending: DataFrame, embedder=hashing_embedder) -> DataFrame:
    return pending.withColumn("dense", embed(F.col("text"), embedder))
