"""Places where models plug in: embedding, reranking, text generation. Each has a deterministic default.

A model is a function on lists; it is made once in each Python worker by its factory, which must be picklable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import search_words

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[list[str]], list[str]]


def hashing_embedder(width: int = 16) -> Embedder:
    """Signed hashing of lower-case words, at unit length: equal texts have equal vectors on every machine."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                row[int.from_bytes(digest[:4], "little") % width] += 1 if digest[4] % 2 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths == 0, 1, lengths)

    return embed


def embed(text: Column, factory: Callable[[], Embedder] = hashing_embedder, batch: int = 64) -> Column:
    """Vectors of a text column, ``batch`` texts at a time; null texts have none."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for texts in batches:
            rows = texts.to_pylist()
            known = [i for i, t in enumerate(rows) if t is not None]
            out: list = [None] * len(rows)
            for start in range(0, len(known), batch):
                part = known[start : start + batch]
                for i, vector in zip(part, np.asarray(model([rows[i] for i in part]), dtype=np.float32)):
                    out[i] = vector.tolist()
            yield pa.array(out, type=pa.list_(pa.float32()))

    return run(text)


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker, by built-in functions: the share of the query's distinct words that the text holds; null counts as empty."""
    asked = F.array_distinct(search_words(F.coalesce(query, F.lit(""))))
    held = F.size(F.array_intersect(asked, search_words(F.coalesce(text, F.lit("")))))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(held / F.size(asked))


def rerank_with(factory: Callable[[], Scorer], batch: int = 64) -> Callable[[Column, Column], Column]:
    """A reranker from a model that scores pairs of query and text; null texts count as empty."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = factory()
        for queries, texts in batches:
            asked, given = [q or "" for q in queries.to_pylist()], [t or "" for t in texts.to_pylist()]
            scores: list[float] = []
            for start in range(0, len(asked), batch):
                scores += [float(s) for s in model(asked[start : start + batch], given[start : start + batch])]
            yield pa.array(scores, type=pa.float64())

    return run


def template_generator() -> Generator:
    """The default text generator: the first line of the prompt that isn't blank."""
    return lambda prompts: [next((line.strip() for line in p.splitlines() if line.strip()), "") for p in prompts]


def generate(prompt: Column, factory: Callable[[], Generator] = template_generator, batch: int = 64) -> Column:
    """Answers of a text generator; a batch it fails on gives empty answers, as does a null prompt."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for prompts in batches:
            asked = [p or "" for p in prompts.to_pylist()]
            out: list[str] = []
            for start in range(0, len(asked), batch):
                part = asked[start : start + batch]
                try:
                    out += [a or "" for a in model(part)]
                except Exception:  # a model that fails must not stop the loop
                    out += [""] * len(part)
            yield pa.array(out, type=pa.string())

    return run(prompt)
