"""The stored tables: chunks, sparse vectors, statistics, notes, log. Each is a folder of Parquet files.

Dense vectors and texts lie in ``points``, sparse vectors in a table of their own, so that a rebuild overwrites only those.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import bm25
from threadloom.operators.records import latest, without
from threadloom.session import cut

POINTS_SCHEMA = "point_id string, ticket_id long, ticket_url string, status string, closed_at string, created_at string, article_id long, sender_type string, content_type string, is_first_user_article boolean, article_position int, chunk_index int, text string, dense array<float>"
SPARSE_SCHEMA = "point_id string, sparse array<struct<idx: int, val: double>>"
TERMS_SCHEMA = "term string, df long, term_id int"
META_SCHEMA = "n_docs long, total_length long, avgdl double, last_rebuild string, width int"


class Store:
    """A collection in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)))

    def drop(self, name: str) -> bool:
        """Removes a table; one that isn't there is no error."""
        return self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)

    def read(self, name: str, schema: str) -> DataFrame:
        """A table, or an empty one of that schema."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    # collection

    def create(self, width: int) -> None:
        """Creates the collection if it is missing."""
        if not self.exists("points"):
            self.spark.createDataFrame([], POINTS_SCHEMA).write.mode("ignore").parquet(self.path("points"))
            self.spark.createDataFrame([(width,)], "width int").write.mode("overwrite").parquet(self.path("shape"))

    def width(self) -> int | None:
        row = self.read("shape", "width int").first()
        return row and row["width"]

    def reset(self, width: int) -> None:
        """Drops everything stored and creates the collection anew."""
        for name in ("points", "sparse", "terms", "meta", "shape"):
            self.drop(name)
        self.create(width)

    def points(self) -> DataFrame:
        return self.read("points", POINTS_SCHEMA)

    def append(self, pending: DataFrame) -> DataFrame:
        """Adds the chunks whose id isn't stored yet; run twice it adds nothing. Returns what it added."""
        new = cut(without(pending, self.points(), "point_id").dropDuplicates(["point_id"]))
        new.select(*[c.split()[0] for c in POINTS_SCHEMA.split(", ")]).write.mode("append").parquet(self.path("points"))
        return new

    def upsert(self, rows: DataFrame) -> None:
        """Whole rows by id: an incoming row replaces the stored one."""
        columns = [c.split()[0] for c in POINTS_SCHEMA.split(", ")]
        versions = self.points().select(*columns, F.lit(0).alias("__v")).unionByName(rows.select(*columns, F.lit(1).alias("__v")))
        cut(latest(versions, "point_id", "__v").drop("__v")).write.mode("overwrite").parquet(self.path("points"))

    def scroll(self) -> DataFrame:
        """(point_id, text) of all chunks that aren't blank."""
        return self.points().select("point_id", "text").where(F.col("text").rlike(r"[^\s\p{Z}]"))

    # statistics

    def rebuild(self, now: str) -> None:
        """Counts terms over all chunks anew and rewrites the sparse vectors, nothing else. An empty collection has n_docs 1."""
        tokens = bm25.tokenized(self.scroll(), "point_id", "text")
        frequencies, stats = bm25.collection_stats(tokens)
        bm25.vocabulary(frequencies).write.mode("overwrite").parquet(self.path("terms"))
        stats.withColumn("last_rebuild", F.lit(now)).withColumn("width", F.lit(self.width())).write.mode("overwrite").parquet(self.path("meta"))
        self.write_sparse(self.weights())

    def weights(self, points: DataFrame | None = None, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        """Sparse vectors of chunks under the stored statistics; terms they don't know are left out."""
        if not self.exists("meta"):
            raise RuntimeError("there are no statistics; rebuild them first")
        tokens = bm25.tokenized(self.scroll() if points is None else points, "point_id", "text")
        terms = self.read("terms", TERMS_SCHEMA)
        weighted = bm25.weights(bm25.term_frequencies(tokens, "point_id"), terms, self.read("meta", META_SCHEMA), ["point_id"], k1, b)
        return bm25.sparse_vectors(weighted, terms, "point_id")

    def write_sparse(self, vectors: DataFrame) -> None:
        cut(vectors).write.mode("overwrite").parquet(self.path("sparse"))

    def append_sparse(self, points: DataFrame) -> None:
        """Vectors of new chunks under the cached statistics."""
        cut(self.weights(points)).write.mode("append").parquet(self.path("sparse"))

    def with_sparse(self) -> DataFrame:
        return self.points().join(self.read("sparse", SPARSE_SCHEMA), "point_id", "left")

    def clear_stats(self) -> bool:
        return any([self.drop("terms"), self.drop("meta")])

    def stats(self) -> DataFrame:
        """(vocabulary_size, documents, avg_doc_length, last_rebuild); no row without statistics."""
        size = self.read("terms", TERMS_SCHEMA).agg(F.count("*").alias("vocabulary_size"))
        return self.read("meta", META_SCHEMA).crossJoin(F.broadcast(size)).select("vocabulary_size", F.col("n_docs").alias("documents"), F.col("avgdl").alias("avg_doc_length"), "last_rebuild")

    def export_stats(self, path: str) -> None:
        """One JSON line a term and one of figures, for other programs; written in parallel, nothing comes to the driver."""
        self.read("terms", TERMS_SCHEMA).write.mode("overwrite").json(f"{path}/terms")
        self.read("meta", META_SCHEMA).write.mode("overwrite").json(f"{path}/meta")

    # notes, log, state of the collection

    def add_notes(self, answers: DataFrame) -> None:
        """Appends notes, each record's once: what is stored already isn't added."""
        notes = note_rows(answers)
        new = without(notes, self.read("notes", NOTES_SCHEMA), "ticket_id") if self.exists("notes") else notes
        cut(new).write.mode("append").parquet(self.path("notes"))

    def log(self, message: str, level: str, at: str) -> None:
        self.spark.createDataFrame([(f"[{at}] {level}: {message}",)], "value string").write.mode("append").text(self.path("log"))

    def health(self) -> DataFrame:
        """(part, available) of the stored tables."""
        return self.spark.createDataFrame([(n, self.exists(n)) for n in ("points", "sparse", "terms", "meta", "notes")], "part string, available boolean")


NOTES_SCHEMA = "ticket_id long, subject string, body string, type string, internal boolean, sender string, content_type string"


def note_rows(answers: DataFrame) -> DataFrame:
    """Answers as internal notes: (ticket_id, subject, body, type, internal, sender, content_type)."""
    fixed = {"type": "note", "internal": True, "sender": "Agent", "content_type": "text/html"}
    return answers.select("ticket_id", F.lit("AI Assistant").alias("subject"), F.col("answer").alias("body"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the collections in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


def results_json(results: DataFrame) -> DataFrame:
    """(query_id, json): each query's results as one JSON text, {"results": [...], "query": ...}; results are few by design."""
    entry = F.struct("ticket_rank", F.struct("ticket_id", "score", "text").alias("r"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["r"])
    return results.groupBy("query_id", "query").agg(F.to_json(F.struct(listed.alias("results"), F.col("query").alias("query"))).alias("json")).drop("query")


def console_lines(results: DataFrame, length: int = 4000) -> DataFrame:
    return results.select("query_id", "ticket_rank", F.concat(F.lit("["), F.format_string("%.4f", "score"), F.lit("] "), F.substring("text", 1, length)).alias("line"))


def read_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """Statistics kept as one JSON object with maps: (term_df, avgdl, vocab, n_docs, last_rebuild). A missing file is an error."""
    schema = "term_df map<string, int>, avgdl double, vocab map<string, int>, N_docs int, last_rebuild string"
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumnRenamed("N_docs", "n_docs")


def read_models_json(spark: SparkSession, text: str) -> DataFrame:
    """(name, size, modified_at) of a model list {"models": [...]}; missing fields have defaults."""
    models = json.loads(text).get("models", []) if text.strip() else []
    rows = [(m.get("name", ""), int(m.get("size", 0)), m.get("modified_at", "")) for m in models]
    return spark.createDataFrame(rows, "name string, size long, modified_at string")
