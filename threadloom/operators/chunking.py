"""Overlapping windows of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, MAX = 450, 50, 512


def space_tokens(text: Column) -> Column:
    """The default tokens: runs without white space."""
    return F.regexp_extract_all(text, F.lit(r"([^\s\p{Z}]+)"), F.lit(1))


def windows(tokens: Column, size: int, overlap: int = 0) -> Column:
    """All slices of ``size`` tokens whose starts are size - overlap apart, the last ones shorter; an empty list has none."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def chunk_tokens(tokens: Column, size: int = SIZE, overlap: int = OVERLAP, longest: int = MAX) -> Column:
    """Windows of tokens; a list no longer than ``size`` is one chunk, a window longer than ``longest`` is cut again without overlap."""
    cut = windows(tokens, size, overlap)
    if size > longest:
        cut = F.flatten(F.transform(cut, lambda w: F.when(F.size(w) > longest, windows(w, longest)).otherwise(F.array(w))))
    return F.when(F.size(tokens) == 0, F.array().cast("array<array<string>>")).when(F.size(tokens) <= size, F.array(tokens)).otherwise(cut)


def chunk_rows(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP, longest: int = MAX) -> DataFrame:
    """One row for each chunk of each text: the text replaced by the chunk, chunk_index (from 0) added.

    Null, empty and blank texts give no rows. Other columns pass through; one named chunk_index is replaced.
    """
    others = [c for c in df.columns if c not in (text, "chunk_index")]
    tokens = df.select(*others, space_tokens(F.col(text)).alias("__tokens")).where(F.size("__tokens") > 0)
    chunks = tokens.select(*others, F.posexplode(chunk_tokens(F.col("__tokens"), size, overlap, longest)).alias("chunk_index", "__chunk"))
    return chunks.select(*others, "chunk_index", F.array_join("__chunk", " ").alias(text))
