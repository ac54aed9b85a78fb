"""Queries on stored chunks: BM25, dense and sparse search, fusion, reranking, hybrid search.

The queries are the titles of the records whose id is divisible by 100, searched against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import is_blank
from threadloom.operators import bm25, search
from threadloom.operators.records import latest, ordered_concat
from threadloom.plans import sql
from threadloom.session import table
from threadloom.sources.store import console_lines, results_json

TOP_K, TOP_TICKETS = 100, 10
COLUMNS = ["point_id", "ticket_id", "content_type", "article_position", "chunk_index", "text", "dense", "loaded_at"]


def points(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return latest(table(spark, sf_dir, "points").select(*(columns or COLUMNS)), "point_id", "loaded_at")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir, ["point_id", "text", "loaded_at"])
    return bm25.tokenized(held.where(~is_blank(F.col("text"))), "point_id", "text")


def queries_of(held: DataFrame) -> DataFrame:
    asked = held.where("content_type = 'title' AND ticket_id % 100 = 0")
    return asked.select(F.col("ticket_id").alias("query_id"), F.col("text").alias("query"), "dense")


def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many search words each chunk has, and the distinct ones in order."""
    found = tokens(spark, sf_dir)
    return found.select("point_id", "dl", F.array_join(F.array_sort(F.array_distinct("words")), " ").alias("distinct_words"))


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_frequencies(tokens(spark, sf_dir), "point_id").select("point_id", "term", "tf")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequencies(tokens(spark, sf_dir))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.corpus_stats(tokens(spark, sf_dir))
    return found.select("n_docs", "total_length", F.round("avgdl", 6).alias("avgdl"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.vocabulary(bm25.document_frequencies(tokens(spark, sf_dir))).select("term", "term_id")


def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens(spark, sf_dir)
    return bm25.stats_record(*bm25.collection_stats(found)).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


def _weights(found: DataFrame) -> DataFrame:
    return bm25.weights(bm25.term_frequencies(found, "point_id"), *bm25.collection_stats(found), ["point_id"])


def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(tokens(spark, sf_dir)).select("point_id", "term", F.round("weight", 6).alias("weight"))


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's stored form: number of terms and their weights as text, in order of the term numbers."""
    found = tokens(spark, sf_dir)
    terms, stats = bm25.collection_stats(found)
    weighted = bm25.weights(bm25.term_frequencies(found, "point_id"), terms, stats, ["point_id"])
    vectors = bm25.sparse_vectors(weighted, bm25.vocabulary(terms), "point_id")
    entry = F.transform("sparse", lambda s: F.concat(s["idx"].cast("string"), F.lit(":"), F.round(s["val"] * 1000).cast("long").cast("string")))
    return vectors.select("point_id", F.size("sparse").alias("n_terms"), F.array_join(entry, " ").alias("entries"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir)
    return search.dense_topk(held, queries_of(held), TOP_K)


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings for each one whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.dense_topk(rows, asked, 10, "vec_id", "embedding", "embedding")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, asked = tokens(spark, sf_dir), queries_of(points(spark, sf_dir))
    terms, stats = bm25.collection_stats(found)
    return search.sparse_topk(found, search.query_weights(asked, "query", terms, stats), terms, stats, TOP_K)


def stored_sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with the sparse vectors as stored, whatever statistics they came from."""
    held = points(spark, sf_dir, ["point_id", "ticket_id", "content_type", "sparse", "loaded_at"])
    asked = held.where("content_type = 'title' AND ticket_id % 100 = 0").select(F.col("ticket_id").alias("query_id"), "sparse")
    return search.stored_sparse_topk(held, asked, 10)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(dense_topk(spark, sf_dir), bm25_search(spark, sf_dir), TOP_K)


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir)
    return search.hybrid_hits(held, queries_of(held), TOP_K).select("query_id", "point_id", "fused_pos", "rerank_score", "reranked_pos")


def ticket_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir)
    return search.ticket_scores(search.hybrid_hits(held, queries_of(held), TOP_K), TOP_TICKETS)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = points(spark, sf_dir)
    return search.search(held, queries_of(held), TOP_K, TOP_TICKETS)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: the best tickets of each query with their texts."""
    return _results(spark, sf_dir)


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's results as one JSON text, given by its digest and length of the list."""
    held = points(spark, sf_dir)
    found = search.search(held, queries_of(held), TOP_K, TOP_TICKETS)
    listed = results_json(found.join(queries_of(held).select("query_id", "query"), "query_id"))
    back = F.from_json("json", "results array<struct<ticket_id: long, score: double, text: string>>, query string")
    return listed.select("query_id", F.size(back["results"]).alias("n_results"), back["query"].alias("query"), back["results"][0]["ticket_id"].alias("best_ticket"))


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results as they are printed: score and beginning of the text."""
    return console_lines(_results(spark, sf_dir))


def point_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every ticket: all its stored chunks in order."""
    held = points(spark, sf_dir, ["point_id", "ticket_id", "article_position", "chunk_index", "text", "loaded_at"])
    return ordered_concat(held, ["ticket_id"], ["article_position", "chunk_index", "point_id"], "text")


def point_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored chunks that aren't blank: (point_id, n_chars)."""
    held = points(spark, sf_dir, ["point_id", "text", "loaded_at"])
    return held.where(~is_blank(F.col("text"))).select("point_id", F.length("text").alias("n_chars"))


def ticket_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of one ticket that have a place and text, by a filter that reaches the scan."""
    held = table(spark, sf_dir, "points").where("ticket_id = 1000").select("point_id", "article_position", "chunk_index", "text", "loaded_at")
    placed = latest(held, "point_id", "loaded_at").where("article_position IS NOT NULL AND chunk_index IS NOT NULL AND text <> ''")
    return placed.select("point_id", "article_position", "chunk_index")


def old_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored statistics say of themselves."""
    return table(spark, sf_dir, "bm25_stats").select("last_rebuild", F.size("term_df").alias("vocabulary_size"), F.col("n_docs").alias("documents"), F.round("avgdl", 6).alias("avg_doc_length"))


def old_stats_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored maps as rows: each term with its count and number; a term without a number has null."""
    rows = table(spark, sf_dir, "bm25_stats")
    return rows.select("last_rebuild", "vocab", F.explode("term_df").alias("term", "df")).select("last_rebuild", "term", "df", F.try_element_at("vocab", F.col("term")).alias("term_id"))


QUERIES = {
    f.__name__: f
    for f in (
        search_tokens, term_freq, doc_freq, corpus_stats, vocab, stats_summary, bm25_weights, sparse_vectors, dense_topk, embedding_topk, bm25_search, stored_sparse_search,
        rrf_fusion, reranked_hits, ticket_max_score, hybrid_search, search_json, search_lines, point_concat, point_scroll, ticket_scroll, old_stats, old_stats_terms,
    )
}

_BASE = f"WITH {sql.POINTS}, {sql.TOKENS}, {sql.STATS}"
_TEXTS = """texts AS (SELECT ticket_id, string_agg(text, chr(10) ORDER BY article_position NULLS LAST, chunk_index NULLS LAST, point_id) AS text FROM pts WHERE text <> '' GROUP BY ticket_id),
hit_texts AS (SELECT query_id, ticket_id, string_agg(text, chr(10) ORDER BY reranked_pos) AS hit_text FROM reranked WHERE text <> '' GROUP BY ALL),
results AS (SELECT query_id, ticket_rank, ticket_id, score, CASE WHEN t.text IS NULL OR NOT """ + sql.not_blank("t.text") + """ THEN coalesce(hit_text, '') ELSE t.text END AS text
  FROM tickets_found f LEFT JOIN texts t USING (ticket_id) LEFT JOIN hit_texts h USING (query_id, ticket_id))"""
_SEARCH = f"WITH {sql.ALL_LISTS}, {sql.FUSED}, {sql.RERANKED}, {_TEXTS}"
_NEAREST = "SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0e0 AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0"
_STORED = """held AS (SELECT point_id, unnest(sparse) AS s FROM pts), asks AS (SELECT ticket_id AS query_id, unnest(sparse) AS s FROM pts WHERE content_type = 'title' AND ticket_id % 100 = 0)"""
_STORED_SCORE = "SELECT query_id, point_id, round(sum(h.s.val * a.s.val), 6) AS score FROM held h JOIN asks a ON h.s.idx = a.s.idx GROUP BY ALL"

ORACLES = {
    "search_tokens": f"WITH {sql.POINTS}, {sql.TOKENS} SELECT point_id, len(words)::INT AS dl, array_to_string(list_sort(list_distinct(words)), ' ') AS distinct_words FROM toks",
    "term_freq": f"{_BASE} SELECT point_id, term, tf FROM tf",
    "doc_freq": f"{_BASE} SELECT term, df FROM dfs",
    "corpus_stats": f"{_BASE} SELECT n_docs, total_length, round(avgdl, 6) AS avgdl FROM stats",
    "vocab": f"{_BASE} SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS term_id FROM dfs",
    "stats_summary": f"{_BASE} SELECT (SELECT count(*) FROM dfs) AS vocabulary_size, n_docs AS documents, round(avgdl, 6) AS avg_doc_length FROM stats",
    "bm25_weights": f"{_BASE}, {sql.WEIGHTS} SELECT point_id, term, round(weight, 6) AS weight FROM weights",
    "sparse_vectors": f"""{_BASE}, {sql.WEIGHTS}, ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM dfs)
        SELECT point_id, count(*)::INT AS n_terms, string_agg(term_id || ':' || round(weight * 1000)::BIGINT, ' ' ORDER BY term_id) AS entries FROM weights JOIN ids USING (term) GROUP BY point_id""",
    "dense_topk": f"WITH {sql.POINTS}, {sql.TOKENS}, {sql.STATS}, {sql.QUERIES}, {sql.ranked('dense', sql.DENSE, 100)} SELECT query_id, point_id, score, rank::INT AS rank FROM dense",
    "embedding_topk": f"WITH {sql.ranked('near', _NEAREST, 10, 'vec_id')} SELECT query_id, vec_id, score, rank::INT AS rank FROM near",
    "bm25_search": f"{_BASE}, {sql.WEIGHTS}, {sql.QUERIES}, {sql.ranked('sparse', sql.SPARSE, 100)} SELECT query_id, point_id, score, rank::INT AS rank FROM sparse",
    "stored_sparse_search": f"WITH {sql.POINTS}, {_STORED}, {sql.ranked('found', _STORED_SCORE, 10)} SELECT query_id, point_id, score, rank::INT AS rank FROM found",
    "rrf_fusion": f"WITH {sql.ALL_LISTS}, {sql.FUSED} SELECT query_id, point_id, score, fused_pos::INT AS fused_pos FROM fused",
    "reranked_hits": f"WITH {sql.ALL_LISTS}, {sql.FUSED}, {sql.RERANKED} SELECT query_id, point_id, fused_pos::INT AS fused_pos, rerank_score, reranked_pos::INT AS reranked_pos FROM reranked",
    "ticket_max_score": f"WITH {sql.ALL_LISTS}, {sql.FUSED}, {sql.RERANKED} SELECT query_id, ticket_id, score, first_pos::INT AS first_pos, ticket_rank::INT AS ticket_rank FROM tickets_found",
    "hybrid_search": f"{_SEARCH} SELECT query_id, ticket_rank::INT AS ticket_rank, ticket_id, score, text FROM results",
    "search_json": f"{_SEARCH} SELECT query_id, count(*)::INT AS n_results, any_value(query) AS query, min_by(ticket_id, ticket_rank) AS best_ticket FROM results JOIN qs USING (query_id) GROUP BY query_id",
    "search_lines": f"{_SEARCH} SELECT query_id, ticket_rank::INT AS ticket_rank, '[' || format('{{:.4f}}', score) || '] ' || left(text, 4000) AS line FROM results",
    "point_concat": f"WITH {sql.POINTS} SELECT ticket_id, string_agg(text, chr(10) ORDER BY article_position NULLS LAST, chunk_index NULLS LAST, point_id) AS text FROM pts WHERE text <> '' GROUP BY ticket_id",
    "point_scroll": f"WITH {sql.POINTS} SELECT point_id, length(text)::INT AS n_chars FROM pts WHERE {sql.not_blank('text')}",
    "ticket_scroll": f"WITH {sql.POINTS} SELECT point_id, article_position, chunk_index FROM pts WHERE ticket_id = 1000 AND article_position IS NOT NULL AND chunk_index IS NOT NULL AND text <> ''",
    "old_stats": "SELECT last_rebuild, cardinality(term_df)::INT AS vocabulary_size, n_docs AS documents, round(avgdl, 6) AS avg_doc_length FROM bm25_stats",
    "old_stats_terms": "SELECT last_rebuild, e.key AS term, e.value AS df, vocab[e.key] AS term_id FROM (SELECT last_rebuild, vocab, unnest(map_entries(term_df)) AS e FROM bm25_stats)",
}
