"""Occurrences and records of every distinct term, by an external sort.

Each task forms sorted runs: (term, record) pairs of a bounded number of characters are sorted and scanned as run
lengths, which gives a term's occurrences and distinct records within the run. The runs are written to the shared
folder, range-partitioned by term, sorted there and merged by a second run-length scan. A term that fills many runs
may lie in several ranges, so the last step adds up what is left of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

#: A longest run of letters and digits (categories L and N).
TERM = re.compile(r"[^\W_]+")
#: Characters of text sorted as one run.
RUN_CHARS = 8_000_000
RARE_BELOW = 3
COMMON_SHARE = 0.15
RUN_SCHEMA = "term string, occurrences long, records long, slot int"


def fold(term: str) -> str:
    return term.lower() if term.isascii() else unicodedata.normalize("NFKC", term).casefold()


def sorted_run(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The terms of the texts in order, with occurrences and the number of texts that hold them."""
    found = [TERM.findall(t) for t in texts]
    terms = [t for words in found for t in words]
    if not terms:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    records = np.repeat(np.arange(len(found), dtype=np.int64), [len(words) for words in found])
    raw = pa.array(terms, pa.large_string()).dictionary_encode()
    folded = [fold(t) for t in raw.dictionary.to_pylist()]
    order = {t: i for i, t in enumerate(sorted(set(folded)))}
    rank = np.array([order[t] for t in folded], dtype=np.int64)
    pairs = rank[raw.indices.to_numpy(zero_copy_only=False)] * len(found) + records
    pairs.sort()
    starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    term_of_pair = pairs[starts] // len(found)
    term_starts = np.flatnonzero(np.r_[True, term_of_pair[1:] != term_of_pair[:-1]])
    n_records = np.diff(np.r_[term_starts, len(term_of_pair)])
    occurrences = np.diff(np.r_[starts[term_starts], len(pairs)])
    return list(order), occurrences, n_records


def _form_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[str] = []
    size, slot = 0, 0

    def close() -> pa.RecordBatch:
        nonlocal held, size, slot
        terms, occurrences, records = sorted_run(held)
        columns = [pa.array([*terms, None], pa.string()), pa.array(np.r_[occurrences, 0]), pa.array(np.r_[records, len(held)]), pa.array(np.full(len(terms) + 1, slot, np.int32))]
        held, size, slot = [], 0, slot + 1
        return pa.RecordBatch.from_arrays(columns, ["term", "occurrences", "records", "slot"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None or not text.strip():
                continue
            held.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                yield close()
    if held:
        yield close()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted rows; the last term of a batch may go on in the next."""
    names = ["term", "occurrences", "records"]
    open_term, open_sums = None, np.zeros(2, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = batch.column(0).dictionary_encode()
        codes = ends.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sums = np.stack([np.add.reduceat(batch.column(i).to_numpy(), starts) for i in (1, 2)])
        terms = ends.dictionary.take(pa.array(codes[starts])).to_pylist()
        if open_term is not None and terms[0] == open_term:
            sums[:, 0] += open_sums
        elif open_term is not None:
            terms.insert(0, open_term)
            sums = np.c_[open_sums, sums]
        open_term, open_sums = terms[-1], sums[:, -1].copy()
        yield pa.RecordBatch.from_arrays([pa.array(terms[:-1], pa.string()), pa.array(sums[0, :-1]), pa.array(sums[1, :-1])], names)
    if open_term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_term], pa.string()), pa.array(open_sums[:1]), pa.array(open_sums[1:])], names)


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, occurrences, records, n_records): every distinct term of the texts of distinct keys.

    n_records is the number of distinct keys whose text isn't null, empty or blank. Rows that repeat a key count once;
    should their texts differ, the least one counts. Rows without a key are left out. An empty table gives no rows.
    Other columns are ignored.
    """
    distinct = df.where(df[key].isNotNull() & df[text].isNotNull()).groupBy(df[key].alias("k")).agg(F.min(df[text]).alias("t"))
    runs = cut(distinct.select("t").mapInArrow(_form_runs, RUN_SCHEMA))
    total = runs.where("term IS NULL").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n_records"))
    ranged = runs.where("term IS NOT NULL").repartitionByRange("term", "slot").sortWithinPartitions("term")
    merged = ranged.select("term", "occurrences", "records").mapInArrow(_merge_runs, "term string, occurrences long, records long")
    terms = merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return terms.crossJoin(F.broadcast(total))  # one row


def marked_terms(counts: DataFrame, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """(term, mark): terms in fewer than rare_below records or in more than common_share of them.

    In tiny collections a term can be both; it then has two rows.
    """
    rare = F.when(F.col("records") < rare_below, F.lit("rare"))
    common = F.when(F.col("records") > common_share * F.col("n_records"), F.lit("common"))
    return counts.select("term", F.explode(F.array_compact(F.array(rare, common))).alias("mark"))
