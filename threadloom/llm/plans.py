"""Queries of the problems, by number, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, newtext, packing, personal, residue, sentences, splitting, termcount
from threadloom.plans import sql
from threadloom.session import stored, table


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles").select(F.lit("article").alias("record_kind"), F.col("id").alias("record_id"), F.col("body").alias("text"))
    tickets = table(spark, sf_dir, "ticket_data").select(F.lit("ticket_data").alias("record_kind"), F.col("id").alias("record_id"), F.col("content").alias("text"))
    return articles.unionByName(tickets)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where personal data stand in article bodies and in the content of open tickets."""
    return personal.personal_data(_personal_texts(spark, sf_dir), ["record_kind", "record_id"], "text")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with a placeholder for each value."""
    return personal.redacted(_personal_texts(spark, sf_dir), ["record_kind", "record_id"], "text").select("record_kind", "record_id", F.col("redacted").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and tickets that are template residue, filler or error pages."""
    articles = table(spark, sf_dir, "articles").select(F.lit("article").alias("record_kind"), F.col("id").alias("record_id"), "body", "content_type")
    tickets = table(spark, sf_dir, "tickets").select(F.lit("ticket").alias("record_kind"), F.col("id").alias("record_id"), "title")
    keys = ["record_kind", "record_id"]
    seen = residue.with_signals(articles, "body", "content_type").select(*keys, "signals")
    titles = residue.with_signals(tickets, "title", title=True).select(*keys, "signals")
    return residue.residue(seen.unionByName(titles), keys)


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termcount.term_counts(table(spark, sf_dir, "points"), "point_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termcount.marked_terms(p3_counts(spark, sf_dir))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was newly written in every article and ticket content: (record_kind, record_id, text, md5, other).

    Repeated rows have the same body; a record whose rows should differ has a row for each text.
    """
    articles = table(spark, sf_dir, "articles").where("body IS NOT NULL").select("id", "ticket_id", "article_position", "body", "content_type")
    tickets = table(spark, sf_dir, "ticket_data").where("content IS NOT NULL").select("id", "content")
    found = stored(newtext.newly_written(articles, "body", "content_type").select("id", "ticket_id", "article_position", "new.*"))
    from_articles = newtext.without_inherited(found, "id", "ticket_id", "article_position").select(F.lit("article").alias("record_kind"), "id", "text", "md5", "other")
    from_tickets = newtext.newly_written(tickets, "content", assembled=True).select(F.lit("ticket_data").alias("record_kind"), "id", "new.text", "new.md5", "new.other")
    return from_articles.unionByName(from_tickets).withColumnRenamed("id", "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold text not newly written, with the MD5 of what was."""
    return p4_texts(spark, sf_dir).where("other").select("record_kind", "record_id", F.col("md5").alias("new_md5")).distinct()


def once_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least; rows without a key stay as they are."""
    others = [c for c in df.columns if c != key]
    once = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("p")).select(key, "p.*")
    return once.unionByName(df.where(F.col(key).isNull()))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, the oversized ones cut up, numbered anew within their article."""
    columns = ["point_id", "ticket_id", "article_id", "article_position", "chunk_index", "text"]
    points = table(spark, sf_dir, "points").select(*columns)
    pieces = splitting.split_oversized(once_each(points, "point_id"), "text")
    return splitting.renumber(pieces, columns[1:4], ["chunk_index", "point_id", "piece_no"], "chunk_index")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, sf_dir, "points").select("point_id", "text"), "text")
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("point_id").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of 2,048 tokens; documents that exceed it in several."""
    sized = bpe.token_count(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return packing.pack(sized, "doc_id", "n_tokens").withColumnRenamed("item", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sentence units of every document begin."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sentences.with_units(documents, "text", "source").select("doc_id", F.explode("starts").alias("start_pos"))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized chunk: whether all its pieces keep the limit, and how it begins and ends in pieces."""
    pieces = splitting.split_oversized(table(spark, sf_dir, "points").where("point_id IS NOT NULL").select("point_id", "text").distinct(), "text").where("n_pieces > 1")
    ends = pieces.groupBy("point_id").agg((F.max(F.length("text")) <= splitting.LIMIT).alias("kept"), F.min_by("text", "piece_no").alias("a"), F.max_by("text", "piece_no").alias("b"))
    return ends.select("point_id", "kept", F.substring("a", 1, 20).alias("begins"), F.right("b", F.lit(20)).alias("ends"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every text decoded from its token ids."""
    ids = bpe.token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")
    return bpe.token_text(ids, "ids").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are placed or empty, containers overfilled, and documents torn though they would fit."""
    placed = p7_containers(spark, sf_dir)
    loads = placed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_units").alias("load"))
    over = loads.agg(F.count_if(F.col("load") > packing.CAPACITY).alias("overfilled"))
    torn = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_units").alias("size"))
    totals = torn.agg(F.count("*").alias("documents"), F.count_if(F.col("size") == 0).alias("empty"), F.count_if((F.col("n") > 1) & (F.col("size") <= packing.CAPACITY)).alias("torn"))
    return totals.crossJoin(F.broadcast(over))  # one row each


def p8_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first unit of each document begins: at its first character that isn't white space."""
    return p8_found(spark, sf_dir).groupBy("doc_id").agg(F.min("start_pos").alias("first_pos"))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_texts": p4_texts,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p5_limits": p5_limits,
    "p6_texts": p6_texts,
    "p7_totals": p7_totals,
    "p8_firsts": p8_firsts,
}

_TERMS = f"list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda w: {sql.fold('w')})"
_COUNTS = f"""WITH {sql.POINTS}, held AS (SELECT point_id, {_TERMS} AS words FROM pts WHERE {sql.not_blank('text')}), n AS (SELECT count(*) AS n_records FROM held),
  each AS (SELECT point_id, unnest(words) AS term FROM held), counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT point_id) AS records FROM each GROUP BY term)"""
ORACLES = {
    "p3_counts": f"{_COUNTS} SELECT term, occurrences, records, n_records FROM counts CROSS JOIN n",
    "p3_found": f"{_COUNTS} SELECT term, 'rare' AS mark FROM counts WHERE records < 3 UNION ALL SELECT term, 'common' AS mark FROM counts CROSS JOIN n WHERE records > 0.15e0 * n_records",
    "p5_limits": "SELECT DISTINCT point_id, true AS kept, left(text, 20) AS begins, right(text, 20) AS ends FROM points WHERE length(text) > 1800",
    "p6_texts": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_totals": "SELECT count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS empty, 0::BIGINT AS torn, 0::BIGINT AS overfilled FROM documents",
    "p8_firsts": f"SELECT doc_id, (length(text) - length(regexp_replace(text, '^[{sql.WS}]+', '')))::INT AS first_pos FROM documents WHERE {sql.not_blank('text')}",
    "p5_found": "SELECT DISTINCT point_id FROM points WHERE length(text) > 1800",
}
