"""BM25 statistics and weights as aggregations.

Terms stay text throughout; numbers for them are only made for export. Raw counts are what is stored, weights are
computed when they are read, so that they never go stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import counting, folded, has_rare, raw_words
from threadloom.session import cut

K1, B = 0.9, 0.4


def tokenized(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, dl): the search words of each text and their number.

    The same words as ``search_words`` gives, in steps, so that no text is scanned twice.
    """
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.withColumn("__rare", has_rare(F.col("__t")))
    rows = rows.select(key, "__rare", raw_words(F.col("__t"), F.col("__rare")).alias("__found"))
    found = rows.select(key, counting(folded(F.col("__found"), F.col("__rare"))).alias("words"))
    return found.withColumn("dl", F.size("words"))


def each_word(tokens: DataFrame, *columns: str) -> DataFrame:
    """(columns, term) for each word. An outer explode, as for a plain one the optimizer tokenizes twice to drop empty lists early."""
    return tokens.select(*columns, F.explode_outer("words").alias("term")).where("term IS NOT NULL")


def term_frequencies(tokens: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, dl). Without an exchange if the rows already lie by key."""
    return each_word(tokens, key, "dl").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df): counted from each text's distinct words, summed up before the shuffle."""
    return tokens.select(F.explode_outer(F.array_distinct("words")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (n_docs, total_length, avgdl); texts without words count, and no texts count as one."""
    n = F.greatest(F.lit(1).cast("long"), F.count("*"))
    total = F.coalesce(F.sum("dl"), F.lit(0).cast("long"))
    return tokens.agg(n.alias("n_docs"), total.alias("total_length"), (total / n).alias("avgdl"))


def collection_stats(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document frequencies and corpus statistics in one pass: a null term stands for each text and carries its length.

    What is kept has one row a term; it is written once, so that the texts aren't read again for each use.
    """
    terms = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("words"))
    rows = tokens.select("dl", F.explode_outer(terms).alias("term"))
    counted = cut(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total")))
    n = F.greatest(F.lit(1).cast("long"), F.coalesce(F.sum("df"), F.lit(0).cast("long")))
    total = F.coalesce(F.sum("total"), F.lit(0).cast("long"))
    stats = counted.where("term IS NULL").agg(n.alias("n_docs"), total.alias("total_length"), (total / n).alias("avgdl"))
    return counted.where("term IS NOT NULL").select("term", "df"), stats


def vocabulary(frequencies: DataFrame, ranges: int = 64) -> DataFrame:
    """(term, df, term_id): terms numbered from 0 in code point order.

    Terms are sorted by ranges; each range starts after the sizes of the ranges before it, so no task sees all terms.
    """
    ranged = cut(frequencies.repartitionByRange(ranges, "term").withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy("term")
    numbered = ranged.withColumn("__k", F.row_number().over(within)).join(F.broadcast(starts), "__range")
    return numbered.select("term", "df", (F.col("__start") + F.col("__k") - 1).cast("int").alias("term_id"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def weight(tf: Column, dl: Column, df: Column, n_docs: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    tiny = F.lit(1e-9)
    length = F.lit(1.0 - b) + F.lit(b) * dl / F.greatest(tiny, avgdl)
    return idf(n_docs, df) * (tf * F.lit(k1 + 1.0)) / F.greatest(tiny, tf + F.lit(k1) * length)


def weights(frequencies: DataFrame, terms: DataFrame, stats: DataFrame, key: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, term, weight) of counted terms; terms without a document frequency are left out.

    The one row of statistics is broadcast. The side of document frequencies has one row a term; where a term fills a
    third of the other side, adaptive execution splits it.
    """
    known = frequencies.join(terms.where("df > 0").select("term", "df"), "term").crossJoin(F.broadcast(stats.select("n_docs", "avgdl")))
    value = weight(F.col("tf"), F.greatest(F.lit(1), F.col("dl")), F.col("df"), F.col("n_docs"), F.col("avgdl"), k1, b)
    return known.select(*key, "term", value.alias("weight"))


def sparse_vectors(weighted: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, sparse): for storage, arrays of (idx, val) by term number. One text's terms are one array."""
    return weighted.join(vocab.select("term", "term_id"), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").alias("idx"), F.col("weight").alias("val")))).alias("sparse"))


def stats_record(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """The summary shown of statistics: (vocabulary_size, documents, avg_doc_length)."""
    size = frequencies.agg(F.count("*").alias("vocabulary_size"))
    return size.crossJoin(F.broadcast(stats)).select("vocabulary_size", F.col("n_docs").alias("documents"), F.col("avgdl").alias("avg_doc_length"))
