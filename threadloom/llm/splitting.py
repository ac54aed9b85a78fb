"""Cutting oversized texts at natural boundaries, with overlap.

A text is cut by a recursive hierarchy of separators: section, paragraph, line, sentence, word, character; a unit is
cut by the next separator only if it is too long. Units are then packed greedily. Nothing is lost: without their
overlaps the pieces joined are the text.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import stored

LIMIT = 1800
OVERLAP = 200
#: A cut is made after each match. From coarse to fine; below words, texts are cut between characters.
SEPARATORS = [
    re.compile(r"(?:\r\n|\n|\r(?!\n))(?:[ \t]*(?:\r\n|\n|\r(?!\n))){2,}|\f|\n(?=#{1,6} )|\n(?:={3,}|-{3,}|\*{3,}|_{3,})[ \t]*(?:\r?\n|$)"),
    re.compile(r"(?:\r\n|\n|\r(?!\n))[ \t\xa0]*(?:\r\n|\n|\r(?!\n))| "),
    re.compile(r"\r\n|[\n\r \x0b\x85]"),
    re.compile(r"[.!?…;։؟۔।॥][\"'“”’»)\]]*\s+|[。！？．][」』”）]*\s*"),
    re.compile(r"\s+"),
]


def _in_cluster(text: str, at: int) -> bool:
    """Whether a cut before this character would part it from what it is written with."""
    return unicodedata.combining(text[at]) != 0 or text[at] in "\u200d\ufe0e\ufe0f" or text[at - 1] == "\u200d"


def _units(text: str, start: int, end: int, size: int, level: int, out: list[int]) -> None:
    """Adds the ends of the units of text[start:end], each at most ``size`` long."""
    if end - start <= size:
        out.append(end)
    elif level < len(SEPARATORS):
        begin = start
        for match in SEPARATORS[level].finditer(text, start, end):
            if match.end() > begin:
                _units(text, begin, match.end(), size, level + 1, out)
                begin = match.end()
        if begin < end:
            _units(text, begin, end, size, level + 1, out)
    else:
        while end - start > size:
            at = start + size
            for back in range(min(32, size - 1)):
                if not _in_cluster(text, at - back):
                    at -= back
                    break
            out.append(at)
            start = at
        out.append(end)


def _overlap_start(text: str, begin: int, end: int, overlap: int) -> int:
    """Where a piece after text[begin:end] starts: a sentence, else a word, at most ``overlap`` before the end."""
    low = max(begin + 1, end - overlap)
    if low >= end:
        return end
    for separator in SEPARATORS[3:]:
        for match in separator.finditer(text, max(begin, low - 1), end):
            if low <= match.end() < end:
                return match.end()
    while low < end and _in_cluster(text, low):
        low += 1
    return low


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``limit`` characters; each but the first begins with up to ``overlap`` that end its predecessor."""
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is needed")
    if len(text) <= limit:
        return [text]
    ends: list[int] = []
    _units(text, 0, len(text), limit - overlap, 0, ends)
    pieces, begin, end = [], 0, 0
    for unit_end in ends:
        if unit_end - begin > limit:
            pieces.append(text[begin:end])
            begin = _overlap_start(text, begin, end, overlap)
        end = unit_end
    pieces.append(text[begin:end])
    return pieces


def split_oversized(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row for each piece of each row: its text replaced by the piece, and piece_no (from 0) and n_pieces added.

    Rows whose text is null or no longer than ``limit`` come out once, unchanged. Only longer texts go through Python.
    All other columns pass through; columns named piece_no or n_pieces are replaced.
    """

    @F.arrow_udf("array<string>")
    def cut_up(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split_text(t, limit, overlap) for t in texts.to_pylist()], type=pa.list_(pa.string()))

    kept = [c for c in df.columns if c not in (text, "piece_no", "n_pieces")]
    cols = [df[c] for c in kept]
    long_text = F.when(F.length(df[text]) > limit, df[text])
    pieces = df.select(*cols, df[text], cut_up(long_text).alias("__pieces"))
    pieces = pieces.select(*kept, F.coalesce("__pieces", F.array(text)).alias("__pieces"))
    pieces = pieces.select(*kept, F.size("__pieces").alias("n_pieces"), F.posexplode("__pieces").alias("piece_no", text))
    return pieces.select(*[c for c in df.columns if c in kept or c == text], "piece_no", "n_pieces")


def renumber(df: DataFrame, group: list[str], order: list[str], index: str, ranges: int | None = None) -> DataFrame:
    """Replaces ``index`` by the position of the row in its group, from 0, in the given order (nulls last).

    ``order`` must tell a group's rows apart, else their numbers among equals are arbitrary. Rows are sorted over ranges of
    group and order, so one group may fill many tasks; the counts of each group in each range give where the range goes
    on numbering. Only keys are sorted and counted before the rows are joined again. Null keys form a group of their own.
    """
    keys = [*group, *order]
    by = [F.col(c).asc_nulls_last() for c in keys]
    whole = stored(df.withColumn("__u", F.monotonically_increasing_id()))  # stored, as the ids aren't the same when made again
    narrow = whole.select("__u", *keys)
    ranged = (narrow.repartitionByRange(ranges, *by) if ranges else narrow.repartitionByRange(*by)).withColumn("__r", F.spark_partition_id())
    ranged = stored(ranged)
    per_range = ranged.groupBy(*group, "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range a group fills
    first = per_range.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(group)], F.col("__r").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(*group, "__r").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    numbered = ranged.withColumn("__k", F.row_number().over(within))
    numbered = numbered.join(first, [F.col("__r") == F.col("__q"), *[F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(group)]])
    return whole.drop(index).join(numbered.select("__u", (F.col("__first") + F.col("__k") - 1).cast("int").alias(index)), "__u").select(*df.columns)
