"""The answer loop as a streaming query: each young record that waits for its first answer gets one, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.config import Settings
from threadloom.functions.models import embed, generate, hashing_embedder, overlap_score, template_generator
from threadloom.functions.text import fill, is_blank, without_thinking
from threadloom.operators.records import is_open, snippets, with_single_article, without, young
from threadloom.operators.search import search
from threadloom.session import cut, stored

#: How much of each result stands in a prompt.
SNIPPET = 200


def waiting(tickets: DataFrame, articles: DataFrame, as_of: Column, settings: Settings = Settings()) -> DataFrame:
    """Open, young records with a single article."""
    asked = tickets.where(is_open(F.col("state_id")) & young(F.col("created_at"), as_of, settings.max_age_days) & F.col("id").isNotNull())
    return with_single_article(asked, articles)


def once(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each key of a stream once. With a time column state is dropped after the delay, and keys count once within it."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def answered(contents: DataFrame, points: DataFrame, settings: Settings = Settings(), embedder=hashing_embedder, generator=template_generator, score=overlap_score) -> DataFrame:
    """(ticket_id, outcome, answer) for records (id, content): a search phrase, a search with it, an answer from what was found.

    outcome is ok, no_content, no_query, no_results or no_answer; only ok has an answer. Every record comes out, so that it
    can be marked as processed whatever became of it. Each distinct phrase is searched for once.
    """
    asked = contents.select(F.col("id").alias("query_id"), F.coalesce("content", F.lit("")).alias("content"))
    phrase = without_thinking(generate(fill(settings.search_prompt, ticket_content=F.col("content")), generator))
    asked = stored(asked.withColumn("query", F.when(is_blank(F.col("content")), F.lit("")).otherwise(phrase)))
    phrases = asked.where("query <> '' AND query_id IS NOT NULL").groupBy("query").agg(F.min("query_id").alias("query_id"))
    queries = stored(phrases.select("query_id", "query", embed(F.col("query"), embedder).alias("dense")))
    found = search(points, queries, settings.answer_top_k, settings.answer_top_tickets, settings.fusion_k, score, settings.k1, settings.b, SNIPPET)
    listed = snippets(found, ["query_id"], "ticket_rank", "text", length=SNIPPET)
    listed = queries.select("query_id", "query").join(listed, "query_id").select("query", "snippets")
    joined = asked.join(listed, "query", "left").withColumn("snippets", F.when(F.col("query_id").isNotNull(), F.col("snippets")))
    prompt = fill(settings.answer_prompt, ticket_content=F.col("content"), search_results=F.col("snippets"))
    answer = without_thinking(generate(F.when(F.col("snippets").isNotNull(), prompt), generator))
    outcome = F.when(is_blank(F.col("content")), "no_content").when(F.col("query") == "", "no_query").when(F.col("snippets").isNull(), "no_results").when(F.col("answer") == "", "no_answer").otherwise("ok")
    return joined.withColumn("answer", answer).select(F.col("query_id").alias("ticket_id"), outcome.alias("outcome"), F.when(outcome == "ok", F.col("answer")).alias("answer"))


def start(stream: DataFrame, store, contents_of: Callable[[DataFrame], DataFrame], checkpoint: str, settings: Settings = Settings(), once_only: bool = True, **models) -> StreamingQuery:
    """Runs the loop over a stream of records (id, ...): answers go to the store's notes, every record's outcome to ``processed``.

    A batch that is run again after a failure adds nothing, as both tables are written by id. ``once_only`` takes what
    is there and stops; otherwise a batch starts every ``settings.check_interval_s`` seconds.
    """

    def handle(batch: DataFrame, _: int) -> None:
        schema = "ticket_id long, outcome string, answer string"
        done = store.read("processed", schema).select(F.col("ticket_id").alias("id"))
        fresh = without(batch.where("id IS NOT NULL").dropDuplicates(["id"]), done, "id")
        rows = cut(answered(contents_of(fresh), store.points(), settings, **models))
        store.add_notes(rows.where("outcome = 'ok'"))
        rows.write.mode("append").parquet(store.path("processed"))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once_only else writer.trigger(processingTime=f"{settings.check_interval_s} seconds")
    return writer.start()


def status(query: StreamingQuery | None, processed: DataFrame) -> dict:
    """What the loop is doing: whether it runs, its last progress, how many records it has handled."""
    return {"running": query is not None and query.isActive, "progress": query.lastProgress if query else None, "processed": processed.count()}
