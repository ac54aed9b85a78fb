import re
import unicodedata
from collections import Counter

from threadloom.llm import termcount

TEXTS = [("a", "Der Host der HOST Straße"), ("b", "STRASSE ﬁne ½ x"), ("b", "STRASSE ﬁne ½ x"), ("c", None), ("d", "  \n"), ("e", "hosts_host-99 host"), (None, "nobody"), ("f", "...")]


def brute(rows):
    chunks = {}
    for key, text in rows:
        if key is not None and text is not None:
            chunks[key] = min(text, chunks.get(key, text))
    chunks = {k: t for k, t in chunks.items() if t.strip()}
    occurrences, records = Counter(), Counter()
    for text in chunks.values():
        terms = [unicodedata.normalize("NFKC", t).casefold() for t in re.findall(r"[^\W_]+", text)]
        occurrences.update(terms)
        records.update(set(terms))
    return {t: (occurrences[t], records[t], len(chunks)) for t in occurrences}


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in TEXTS], "k string, txt string, records int")
    got = {r["term"]: (r["occurrences"], r["records"], r["n_records"]) for r in termcount.term_counts(df, "k", "txt").collect()}
    assert got == brute(TEXTS)


def test_runs_merge_across_small_runs(spark, monkeypatch):
    monkeypatch.setattr(termcount, "RUN_CHARS", 40)
    rows = [(f"k{i}", f"common term{i % 7} word{i % 3} COMMON") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, txt string")
    # the functions are pickled by reference, so workers keep the real run size; the run formation is tested directly
    import pyarrow as pa

    runs = list(termcount._form_runs(iter([pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["t"])])))
    assert len(runs) > 10
    joined = pa.Table.from_batches(runs).to_pandas()
    assert joined[joined.term.isna()].records.sum() == 300
    assert joined[joined.term == "common"].occurrences.sum() == 600
    merged = [pa.RecordBatch.from_pandas(joined[joined.term.notna()].sort_values("term").iloc[i : i + 7], preserve_index=False) for i in range(0, int(joined.term.notna().sum()), 7)]
    terms = pa.Table.from_batches(list(termcount._merge_runs(iter(merged)))).to_pandas()
    assert terms.term.is_unique and dict(zip(terms.term, terms.occurrences))["common"] == 600
    got = {r["term"]: (r["occurrences"], r["records"], r["n_records"]) for r in termcount.term_counts(df, "k", "txt").collect()}
    assert got == brute(rows)


def test_marks_and_empty(spark):
    rows = [(f"k{i}", "all " + ("some " if i < 3 else "") + ("one" if i == 0 else "")) for i in range(30)]
    marks = {(r["term"], r["mark"]) for r in termcount.marked_terms(termcount.term_counts(spark.createDataFrame(rows, "k string, t string"), "k", "t")).collect()}
    assert marks == {("all", "common"), ("one", "rare")}
    assert termcount.term_counts(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0
