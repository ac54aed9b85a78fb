import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.config import Settings, parse_env, upsert_env
from threadloom.functions.dates import moment
from threadloom.operators import bm25, chunking, ingest, records, schedules, search
from threadloom.sources import logs, paged
from threadloom.sources.store import Store, collections, read_models_json, read_stats_json
from threadloom.streaming import answers


def windows_by_hand(tokens, size, overlap):
    step, out, i = max(1, size - overlap), [], 0
    while i < len(tokens):
        out.append(tokens[i : i + size])
        i += step
    return out


@pytest.mark.parametrize("size, overlap, longest", [(450, 50, 512), (5, 2, 3), (3, 3, 9), (4, 0, 4)])
def test_chunks(spark, size, overlap, longest):
    lengths = [0, 1, 3, 4, 5, 449, 450, 451, 800, 801, 850, 851, 1000]
    rows = spark.createDataFrame([(n, " ".join(str(i) for i in range(n))) for n in lengths] + [(-1, None), (-2, " \n ")], "n int, t string")
    found = {}
    for r in chunking.chunk_rows(rows, "t", size, overlap, longest).orderBy("n", "chunk_index").collect():
        found.setdefault(r["n"], []).append(r["t"].split())
    for n in lengths:
        tokens = [str(i) for i in range(n)]
        if n <= size:
            expected = [tokens] if n else []
        else:
            expected = [p for w in windows_by_hand(tokens, size, overlap) for p in (windows_by_hand(w, longest, 0) if len(w) > longest else [w])]
        assert found.get(n, []) == expected
    assert -1 not in found and -2 not in found


def test_latest(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 1, "d"), (None, 1, "d"), (2, None, "e")], "k int, v int, x string")
    assert sorted(r["x"] for r in records.latest(rows, "k", "v").collect()) == ["b", "d", "d", "e"]
    assert records.latest(rows.limit(0), "k", "v").count() == 0


def test_ripe_borders(spark):
    as_of = moment("2024-07-15T00:00:00Z")
    rows = [("a", "2024-07-01T00:00:00Z", None), ("b", "2024-07-01T00:00:01Z", None), ("c", None, None), ("d", "x", None), ("e", "2024-01-01", "2018-01-01"), ("f", "2024-01-01", "2017-12-31T23:59:59Z"), ("g", "2024-01-01", "bad")]
    found = spark.createDataFrame(rows, "id string, close_at string, created_at string").where(records.ripe(as_of, 14, "nonsense"))
    assert sorted(r["id"] for r in found.collect()) == ["a", "e", "g"]


def test_skipped_titles(spark):
    titles = ["", None, "  Undelivered Mail ", "[Suspected Spam] x", "SQL Server-Warnungssystem: x", "Angebot AG"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    found = rows.select(records.skipped_title(F.col("t")), records.skipped_title(F.col("t"), False)).collect()
    assert [tuple(r) for r in found] == [(False, False), (False, False), (True, True), (True, True), (False, True), (False, False)]


def test_young(spark):
    as_of = moment("2024-07-02T00:00:00Z")
    rows = spark.createDataFrame([("2024-07-01T00:00:00Z",), ("2024-06-30T23:59:59Z",), ("2024-06-30 23:59:59",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(records.young(F.col("c"), as_of, 1)).collect()] == [True, False, True, True, True]
    assert [r[0] for r in rows.select(records.young(F.col("c"), as_of, 0)).collect()] == [True] * 5


def test_ordered_concat_across_blocks(spark):
    rows = spark.createDataFrame([("g", i, 0, str(i)) for i in range(50)] + [("g", None, 0, "last"), ("g", 3, 1, ""), ("h", 1, 1, None)], "g string, a int, b int, t string")
    found = {r["g"]: r["text"] for r in records.ordered_concat(rows, ["g"], ["a", "b"], "t", block=7).collect()}
    assert found == {"g": "\n".join([str(i) for i in range(50)] + ["last"])}


def brute_bm25(texts, query, k1=0.9, b=0.4):
    docs = {i: t.lower().split() for i, t in texts.items()}
    n, avgdl = max(1, len(docs)), sum(map(len, docs.values())) / max(1, len(docs))
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}

    def weights(tokens):
        return {t: np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tokens.count(t) * (k1 + 1) / (tokens.count(t) + k1 * (1 - b + b * len(tokens) / avgdl)) for t in set(tokens) if t in df}

    asked = weights(query.lower().split())
    return {i: sum(asked[t] * w for t, w in weights(d).items() if t in asked) for i, d in docs.items() if set(d) & set(asked)}


def test_sparse_search(spark):
    texts = {"a": "vpn drucker drucker", "b": "vpn", "c": "monitor kabel", "d": "drucker kabel vpn vpn", "e": ""}
    points = spark.createDataFrame(list(texts.items()), "point_id string, text string")
    queries = spark.createDataFrame([(1, "vpn kabel kabel fehlt"), (2, "unbekannt"), (3, None)], "query_id long, query string")
    tokens = bm25.tokenized(points, "point_id", "text")
    terms, stats = bm25.document_frequencies(tokens), bm25.corpus_stats(tokens)
    asked = search.query_weights(queries, "query", terms, stats)
    found = {r["point_id"]: r["score"] for r in search.sparse_topk(tokens, asked, terms, stats, 10).collect()}
    assert found == pytest.approx(brute_bm25(texts, "vpn kabel kabel fehlt"), abs=1e-6)


def test_sparse_search_in_blocks_of_queries(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)] + ["oft"] * 20
    texts = {f"p{i:03}": " ".join(rng.choice(words, 12)) for i in range(120)} | {"empty": "", "copy": "oft w1", "twin": "oft w1"}
    points = spark.createDataFrame(list(texts.items()), "point_id string, text string").repartition(5)
    asked_for = {i: "oft " + " ".join(rng.choice(words, 3)) for i in range(30)}
    tokens = bm25.tokenized(points, "point_id", "text")
    terms, stats = bm25.document_frequencies(tokens), bm25.corpus_stats(tokens)
    asked = search.query_weights(spark.createDataFrame(list(asked_for.items()), "query_id long, query string"), "query", terms, stats)
    one, many = (sorted(map(tuple, search.sparse_topk(tokens, asked, terms, stats, 7, block=b).collect())) for b in (1000, 6))
    assert one == many and len(one) == 210
    for query in (0, 17):
        scores = brute_bm25(texts, asked_for[query])
        best = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:7]
        assert [r[1] for r in sorted((r for r in one if r[0] == query), key=lambda r: r[3])] == best


def test_beginnings_of_joined_texts(spark):
    rows = [("g", i, "x" * (i % 5) + "\n") for i in range(40)] + [("blank", i, " ") for i in range(3)] + [("late", 0, " " * 30), ("late", 1, "text")]
    df = spark.createDataFrame(rows, "g string, a int, t string")
    whole = {r["g"]: r["text"] for r in records.ordered_concat(df, ["g"], ["a"], "t", block=7).collect()}
    for length in (1, 9, 20, 500):
        found = {r["g"]: r["text"] for r in records.ordered_concat(df, ["g"], ["a"], "t", block=7, length=length, blank=False).collect()}
        assert found == {g: t[:length] for g, t in whole.items() if g != "blank"}


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = [(f"p{i:03}", rng.normal(size=8).tolist()) for i in range(300)]
    vectors += [("zero", [0.0] * 8), ("null", None), ("wide", [1.0] * 9), ("copy", vectors[0][1])]
    points = spark.createDataFrame(vectors, "point_id string, dense array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(vectors[:40])] + [(99, None)], "query_id long, dense array<float>")
    one, many = (sorted(map(tuple, search.dense_topk(points, queries, 7, block=b).collect())) for b in (1000, 6))
    assert one == many and len(one) == 280
    data = {k: np.array(v, dtype=np.float32).astype(float) for k, v in vectors if v and len(v) == 8 and any(v)}
    q = data["p000"]
    best = sorted(data, key=lambda k: (-round(float(q @ data[k] / np.linalg.norm(q) / np.linalg.norm(data[k])), 6), k))[:7]
    assert [r[1] for r in sorted((r for r in one if r[0] == 0), key=lambda r: r[3])] == best and best[:2] == ["copy", "p000"]


def test_empty_search(spark):
    points = spark.createDataFrame([], "point_id string, ticket_id long, article_position int, chunk_index int, text string, dense array<float>")
    queries = spark.createDataFrame([(1, "x", [1.0])], "query_id long, query string, dense array<float>")
    assert search.search(points, queries).count() == 0
    assert search.search(points, queries.limit(0)).count() == 0


def test_fusion_and_grouping(spark):
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "x", 0.5, 1)], "query_id long, point_id string, score double, rank int")
    sparse = spark.createDataFrame([(1, "b", 3.0, 1), (1, "c", 2.0, 2)], "query_id long, point_id string, score double, rank int")
    fused = search.fuse(dense, sparse, 3)
    assert [r["point_id"] for r in fused.where("query_id = 1").orderBy("fused_pos").collect()] == ["b", "a", "c"]
    rows = spark.createDataFrame([(1, 7, -2.0, 1), (1, None, 9.0, 2), (1, 8, -1.0, 3), (1, 9, 0.5, 4)], "query_id long, ticket_id long, rerank_score double, reranked_pos int")
    found = search.ticket_scores(rows, 2).orderBy("ticket_rank").collect()
    assert [(r["ticket_id"], r["score"]) for r in found] == [(9, 0.5), (7, 0.0)]


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.sampled_from("ABC"), st.text("xy =\n", max_size=5), max_size=3))
def test_env_round_trip(changes):
    text = upsert_env('# A="0"\nA="1"\nother\n', changes)
    read = parse_env(text)
    assert text.startswith('# A="0"\n') and "other" in text
    assert {k: v.replace("\\n", "\n") for k, v in read.items()} == {"A": "1"} | changes


def test_settings():
    made = Settings.from_mapping({"TOP_K": "7", "USE_CACHED_STATS": " True", "START_DATE": "bad", "TICKET_URL": "http://x//", "ANSWER_PROMPT": "a\\nb", "X": "1"})
    assert (made.top_k, made.use_cached_stats, made.start_date, made.ticket_url, made.answer_prompt) == (7, True, "2018-01-01T00:00:00Z", "http://x", "a\nb")


def test_schedule_json_round_trip(spark):
    text = '{"k": {"id": "k", "interval": "weekly", "time": "10:00", "days": "0,x", "enabled": true, "next_run": "2024-07-01T10:00:00", "config": {"a": "b"}}}'
    rows = schedules.from_json(spark.createDataFrame([(text,), ("broken",), ("",)], "j string"), "j")
    again = schedules.from_json(schedules.to_json(rows), "json")
    assert rows.collect() == again.collect()
    assert schedules.due(rows, moment("2024-07-01T10:00:00Z")).count() == 1
    assert schedules.due(rows, moment("2024-07-02T10:00:00Z")).count() == 0
    assert schedules.due(schedules.toggled(rows, "k"), moment("2024-07-01T10:00:00Z")).count() == 0
    assert schedules.removed(rows, "k").count() == 0
    after = schedules.advanced(rows, moment("2024-07-01T10:00:01Z")).first()
    assert str(after["next_run"]) == "2024-07-08 10:00:00"


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("[t] INFO: old\n")
    (tmp_path / "b.log").write_text("".join(f"[t] INFO: {i}\n" for i in range(9)) + "\nfree text\n")
    lines = logs.log_lines(spark, str(tmp_path / "*.log"))
    import os

    os.utime(tmp_path / "a.log", (1, 1))
    assert [r["message"] for r in logs.tail(logs.newest(logs.log_lines(spark, str(tmp_path / "*.log")))).orderBy("line_no").collect()] == ["5", "6", "7", "8", "free text"]
    assert logs.parsed(lines).count() == 11


def test_pages(spark, tmp_path):
    def fetch(page):
        return [{"id": page * 10 + i, "title": "ä", "extra": 1} for i in range(3)] if page <= 5 else []

    found = paged.read_pages(spark, fetch, "id long, title string, missing int", readers=3)
    assert sorted(r["id"] for r in found.collect()) == sorted(p * 10 + i for p in range(1, 6) for i in range(3))
    failed = {"n": 0}

    def flaky(page):
        failed["n"] += 1
        if failed["n"] < 3:
            raise OSError
        return [{"id": 1}] if page == 1 else []

    assert list(paged.pages_of(flaky, 1, 1, pause=0)) == [{"id": 1}]
    with pytest.raises(OSError):
        list(paged.pages_of(lambda page: (_ for _ in ()).throw(OSError()), 1, 1, pause=0))
    assert paged.articles_of({"articles": [1]}) == [1] and paged.articles_of("x") == [] and paged.articles_of([2]) == [2]


TICKETS = [(1, "Drucker defekt", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", 4, "closed", 5), (2, "Undelivered Mail", None, "2024-02-01", 4, "closed", 5), (3, "", "2024-01-01", "2024-02-01", 4, None, 5), (4, "zu neu", None, "2024-06-30", 4, "closed", 5)]
ARTICLES = [(1, 0, 11, "Customer", "<p>Der Drucker druckt nicht</p>"), (1, 1, 12, "Agent", "Bitte neu starten"), (2, 0, 21, "Customer", "weg"), (3, 0, 31, None, None)]


@pytest.fixture()
def desk(spark):
    tickets = spark.createDataFrame(TICKETS, "id long, title string, created_at string, close_at string, state_id int, state string, customer_id long")
    articles = spark.createDataFrame(ARTICLES, "ticket_id long, article_position int, id long, sender_type string, body string")
    return tickets, articles


def test_ingest_twice_adds_nothing(spark, desk, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    store.create(16)
    store.create(16)
    for expected in (3, 0):
        run = ingest.ingest(*desk, store.points(), moment("2024-07-01T00:00:00Z"))
        added = store.append(ingest.with_vectors(run.pending))
        assert added.count() == expected
    assert {r["id"]: r["outcome"] for r in run.outcomes.collect()} == {1: "skipped_existing", 2: "skipped_title", 3: "empty"}
    assert store.points().count() == 3 and store.width() == 16
    store.rebuild("2024-07-01")
    first = store.stats().first()
    assert (first["documents"], first["last_rebuild"]) == (3, "2024-07-01") and first["vocabulary_size"] > 3
    rebuilt = {r["point_id"]: r["sparse"] for r in store.with_sparse().collect()}
    cached = {r["point_id"]: r["sparse"] for r in store.weights().collect()}
    assert rebuilt == cached
    changed = store.points().withColumn("text", F.lit("neu")).limit(1)
    store.upsert(changed)
    assert store.points().count() == 3 and store.points().where("text = 'neu'").count() == 1
    assert collections(spark, str(tmp_path)).count() == 1
    assert {r["part"]: r["available"] for r in store.health().collect()}["meta"]
    assert store.clear_stats() and not store.clear_stats()
    with pytest.raises(RuntimeError):
        store.weights()
    store.reset(8)
    assert store.points().count() == 0 and store.width() == 8
    store.log("fertig", "INFO", "2024-07-01 00:00:00")
    assert spark.read.text(store.path("log")).first()[0] == "[2024-07-01 00:00:00] INFO: fertig"


def test_answer_loop_writes_each_note_once(spark, desk, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    store.create(16)
    store.append(ingest.with_vectors(ingest.ingest(*desk, store.points(), moment("2024-07-01T00:00:00Z")).pending))
    source, schema = str(tmp_path / "in"), "id long, content string"
    spark.createDataFrame([(7, "Drucker defekt"), (7, "Drucker defekt"), (8, " "), (None, "x")], schema).write.parquet(source)
    for _ in range(2):
        query = answers.start(spark.readStream.schema(schema).parquet(source), store, lambda batch: batch, str(tmp_path / "state"))
        query.awaitTermination()
        spark.createDataFrame([(7, "Drucker defekt"), (9, "Drucker")], schema).write.mode("append").parquet(source)
    outcomes = {r["ticket_id"]: r["outcome"] for r in spark.read.parquet(store.path("processed")).collect()}
    assert outcomes == {7: "ok", 8: "no_content", 9: "ok"}
    notes = spark.read.parquet(store.path("notes")).collect()
    assert sorted(r["ticket_id"] for r in notes) == [7, 9] and notes[0]["sender"] == "Agent" and notes[0]["internal"]
    assert answers.status(None, spark.read.parquet(store.path("processed"))) == {"running": False, "progress": None, "processed": 3}


def test_equal_phrases_are_searched_for_once(spark, tmp_path):
    folder = str(tmp_path)

    def counting():
        def embed(texts):
            for text in texts:
                with open(f"{folder}/asked", "a") as file:
                    file.write(text + "\n")
            return np.ones((len(texts), 4))

        return embed

    chunks = [(f"p{i}", 1 + i % 4, i % 4, i, ["Drucker defekt", "Netz fehlt", " "][i % 3], [1.0, 0.0, 0.0, 1.0]) for i in range(24)]
    points = spark.createDataFrame(chunks, "point_id string, ticket_id long, article_position int, chunk_index int, text string, dense array<float>")
    contents = spark.createDataFrame([(i, f"Drucker {i % 3} defekt\nMehr {i}") for i in range(30)] + [(99, " "), (None, "Drucker 0 defekt\n")], "id long, content string")
    rows = {r["ticket_id"]: r for r in answers.answered(contents, points, embedder=counting).collect()}
    assert len(rows) == 32 and all(rows[i]["outcome"] == "ok" for i in range(30))
    assert (rows[99]["outcome"], rows[None]["outcome"]) == ("no_content", "no_results")
    asked = open(f"{folder}/asked").read().splitlines()
    assert sorted(asked) == [f"Search phrase for this ticket: Drucker {i} defekt" for i in range(3)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"term_df": {"a": 2}, "avgdl": 1.5, "vocab": {"a": 0}, "N_docs": 2, "last_rebuild": "x"}')
    assert read_stats_json(spark, str(tmp_path / "s.json")).first()["n_docs"] == 2
    assert [tuple(r) for r in read_models_json(spark, '{"models": [{"name": "m"}]}').collect()] == [("m", 0, "")]


def test_clashing_names(spark, desk):
    tickets, articles = desk
    tickets = tickets.withColumn("ticket_id", F.lit(0)).withColumn("body", F.lit("x"))
    assert records.with_articles(tickets, articles).count() == 5
    assert records.ticket_content(tickets.drop("ticket_id"), articles).where("id = 1").first()["content"] == "Titel: Drucker defekt\n\n---\n<p>Der Drucker druckt nicht</p>\n---\nBitte neu starten"


def test_stored_rows_are_read_again(spark):
    from threadloom.session import cut, shared_folder, stored

    rows = spark.createDataFrame([(1, [1.0], None), (2, None, "ä")], "a long, b array<double>, c string")
    assert sorted(map(str, stored(rows).collect())) == sorted(map(str, cut(rows).collect())) == sorted(map(str, rows.collect()))
    assert shared_folder(spark)
