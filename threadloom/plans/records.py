"""Queries on records and articles: filters, joins, counts, payloads, ingest counters, the answer loop's inputs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import Settings
from threadloom.functions.dates import moment, parse_iso, start_cutoff
from threadloom.functions.ids import point_id
from threadloom.functions.text import fill, strip, without_thinking
from threadloom.operators import ingest as ing
from threadloom.operators import records as rec
from threadloom.plans import sql
from threadloom.plans.retrieval import points
from threadloom.session import shared_folder, stored, table
from threadloom.streaming import answers

AS_OF = "2024-07-01T00:00:00Z"
SETTINGS = Settings(min_age_days=14, start_date="2022-03-01", max_age_days=90, ticket_url="https://desk.nordwall.example")
_URL = SETTINGS.ticket_url + "/#ticket/zoom/"


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.latest(table(spark, sf_dir, "tickets"), "id", "loaded_at")


def articles(spark: SparkSession, sf_dir: str, columns: str = "ticket_id article_position id sender_type body loaded_at") -> DataFrame:
    return rec.latest(table(spark, sf_dir, "articles").select(*columns.split()), "id", "loaded_at")


def latest_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a ticket, the one loaded last."""
    return tickets(spark, sf_dir).select("id", "title", "state_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of all articles as microseconds; unreadable ones are null."""
    return articles(spark, sf_dir, "id created_at loaded_at").select("id", F.unix_micros(parse_iso(F.col("created_at"))).alias("created_us"))


def ticket_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tickets(spark, sf_dir).where(rec.ripe(moment(AS_OF), SETTINGS.min_age_days, SETTINGS.start_date))
    return kept.select("id", F.unix_micros(parse_iso(F.col("close_at"))).alias("closed_us"))


def start_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticket's creation date read as a start date: 2018-01-01 where it is none."""
    return tickets(spark, sf_dir).select("id", F.unix_micros(start_cutoff(F.col("created_at"))).alias("start_us"))


def title_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that keep tickets out, by the keywords as they stand and by lowered ones."""
    return tickets(spark, sf_dir).select("id", rec.skipped_title(F.col("title")).alias("strict"), rec.skipped_title(F.col("title"), strict=False).alias("lowered"))


def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select("id", rec.state_name(F.col("state_id")).alias("state_name"))


def sender_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = articles(spark, sf_dir, "id sender_type loaded_at").select(rec.sender_kind(F.col("sender_type")).alias("sender_kind"))
    return kinds.groupBy("sender_kind").agg(F.count("*").alias("n"))


def ticket_articles_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = rec.with_articles(tickets(spark, sf_dir).select("id", "customer_id"), articles(spark, sf_dir, "ticket_id id article_position loaded_at"))
    return joined.select("id", "customer_id", "a_id", "a_article_position")


def article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.article_counts(articles(spark, sf_dir, "ticket_id id loaded_at"))


def single_article_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.with_single_article(tickets(spark, sf_dir), articles(spark, sf_dir, "ticket_id id loaded_at")).select("id")


def young_ticket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).where(rec.young(F.col("created_at"), moment(AS_OF), SETTINGS.max_age_days)).select("id")


def waiting_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, young tickets with a single article."""
    return answers.waiting(tickets(spark, sf_dir), articles(spark, sf_dir, "ticket_id id loaded_at"), moment(AS_OF), SETTINGS).select("id")


def unanswered_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.unanswered(tickets(spark, sf_dir), articles(spark, sf_dir, "ticket_id id sender_type loaded_at")).select("id")


def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.generated_answers(articles(spark, sf_dir)).select("id")


def unprocessed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all tickets whose chunk isn't stored yet."""
    titles = tickets(spark, sf_dir).select("id", point_id(F.col("id"), F.lit(0), F.lit(0)).alias("point_id"))
    return rec.without(titles, table(spark, sf_dir, "points"), "point_id")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks found by the ids computed for all articles' first chunks."""
    wanted = articles(spark, sf_dir, "ticket_id id loaded_at").select("id", point_id(F.col("ticket_id"), F.col("id"), F.lit(0)).alias("point_id"))
    return wanted.join(points(spark, sf_dir, ["point_id", "text", "loaded_at"]), "point_id").select("id", "point_id", F.length("text").alias("n_chars"))


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir, "ticket_id id loaded_at").select("id", point_id(F.col("ticket_id"), F.col("id"), F.lit(0)).alias("point_id"))


def point_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and article chunks of all tickets in one table, texts only stripped and cut into windows."""
    found = tickets(spark, sf_dir)
    titles = ing.title_rows(found, SETTINGS.ticket_url, strip)
    bodies = ing.article_rows(found, articles(spark, sf_dir), SETTINGS.ticket_url, strip)
    return ing.point_rows(titles, bodies)


def _ingested(spark: SparkSession, sf_dir: str, **clean) -> ing.Ingest:
    return ing.ingest(tickets(spark, sf_dir), articles(spark, sf_dir), table(spark, sf_dir, "points"), moment(AS_OF), SETTINGS, **clean)


def ingest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of old enough tickets that aren't stored yet, cleaned."""
    return _ingested(spark, sf_dir).pending


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each ticket; texts only stripped, so that SQL can say the same."""
    return _ingested(spark, sf_dir, clean=strip).outcomes


def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.metrics(_ingested(spark, sf_dir, clean=strip).outcomes)


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.metrics_text(ing.metrics(_ingested(spark, sf_dir, clean=strip).outcomes), moment(AS_OF), moment("2024-07-01T00:02:30Z"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.ticket_content(tickets(spark, sf_dir), articles(spark, sf_dir))


def ticket_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir)


def result_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three articles of each ticket as numbered beginnings."""
    rows = articles(spark, sf_dir).where("body IS NOT NULL").withColumn("rank", F.col("article_position") + 1)
    return rec.snippets(rows, ["ticket_id"], "rank", "body")


def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt for an answer to each stored ticket content."""
    rows = table(spark, sf_dir, "ticket_data").select("id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("title", F.lit("")).alias("title")).distinct()
    return rows.select("id", fill(SETTINGS.answer_prompt, ticket_content=F.col("content"), search_results=F.col("title")).alias("prompt"))


def think_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents put behind a thinking part, with one within: only what stands outside is left."""
    text = F.concat(F.lit("<think>a\nb</think> "), F.coalesce("content", F.lit("")), F.lit("<think></think>\n"), F.coalesce("title", F.lit("")), F.lit("<think> open"))
    return table(spark, sf_dir, "ticket_data").select("id", without_thinking(text).alias("answer")).distinct()


def client_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks as the answer loop's results: defaults for what is missing."""
    held = points(spark, sf_dir, ["point_id", "ticket_id", "text", "loaded_at"])
    return held.select("point_id", F.lit(0.0).alias("score"), F.coalesce("text", F.lit("")).alias("text"), "ticket_id", F.lit(None).cast("long").alias("article_id"), F.lit("").alias("ticket_url"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and kind of event once, from a stream over the events."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder = f"{shared_folder(spark)}/stream-{tempfile.mktemp(dir='')[-8:]}"
    stream = spark.readStream.schema(schema).parquet(source + "*").select(F.concat_ws(":", "user_id", "event_type").alias("key"))
    running = answers.once(stream, "key").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answer loop makes of all stored ticket contents, with the default models."""
    contents = table(spark, sf_dir, "ticket_data").select("id", "content").dropDuplicates(["id"])
    return answers.answered(contents, stored(points(spark, sf_dir)), SETTINGS)


QUERIES = {
    f.__name__: f
    for f in (
        latest_tickets, iso_dates, ticket_date_filter, start_dates, title_skip, state_names, sender_map, ticket_articles_left_join, article_counts, single_article_tickets, young_ticket_filter,
        waiting_tickets, unanswered_tickets, generated_answers, unprocessed_anti, point_lookup, point_ids, point_union, ingest_points, ingest_outcomes, ingest_metrics, ingest_report,
        ticket_content, result_snippets, prompt_fill, think_filter, client_results, stream_dedup, answer_outcomes,
    )
}

_T, _A = f"WITH {sql.TICKETS}", f"WITH {sql.ARTICLES}"
_NOW = "epoch_us(TIMESTAMPTZ '2024-07-01 00:00:00+00')"
_DAY = 86_400_000_000
_RIPE = f"coalesce(({sql.parse('close_at')}) <= {_NOW} - 14 * {_DAY} AND (({sql.parse('created_at')}) IS NULL OR ({sql.parse('created_at')}) >= epoch_us(TIMESTAMPTZ '2022-03-01 00:00:00+00')), false)"
_ZONED = "regexp_matches(created_at, '(?:Z|[+-]\\d{2}:?\\d{2})$')"
_YOUNG = f"coalesce(CASE WHEN {_ZONED} THEN {sql.parse('created_at')} END >= {_NOW} - 90 * {_DAY}, true)"


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return (
        f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0','4','8','c') THEN '8' WHEN h[17] IN ('1','5','9','d') THEN '9'"
        f" WHEN h[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"
    )


def _skip(title: str, lowered: bool) -> str:
    clean = sql.strip(title)
    listed = ", ".join(f"'{t}'" for t in rec.SKIP_TITLES)
    words = [k.lower() if lowered else k for k in rec.SKIP_KEYWORDS]
    return f"coalesce({clean} IN ({listed}) OR " + " OR ".join(f"contains(lower({clean}), '{w}')" for w in words) + f", false) AND coalesce({title} <> '', false)"


_SENDER = "CASE WHEN lower(sender_type) IN ('customer', 'user') THEN 'User' ELSE 'Agent' END"
_BASE = f"id AS ticket_id, '{_URL}' || id AS ticket_url, 'closed' AS status, close_at AS closed_at, created_at"


def _chunks(source: str) -> str:
    """Rows of a relation with text, cut into windows of 450 words that overlap by 50."""
    return f"""SELECT * EXCLUDE (toks, i, text), i::INT AS chunk_index,
      array_to_string(CASE WHEN len(toks) <= 450 THEN toks ELSE toks[i * 400 + 1 : i * 400 + 450] END, ' ') AS text
      FROM (SELECT *, unnest(CASE WHEN len(toks) <= 450 THEN [0] ELSE range(0, ((len(toks) + 399) // 400)) END) AS i
        FROM (SELECT *, regexp_extract_all(text, '[^\\s\\p{{Z}}]+') AS toks FROM ({source})) WHERE len(toks) > 0)"""


def _points(seen: str) -> str:
    titles = f"SELECT {_BASE}, 0::BIGINT AS article_id, 'User' AS sender_type, 'title' AS content_type, false AS is_first_user_article, -1 AS article_position, 0 AS chunk_index, {sql.strip('title')} AS text FROM {seen} WHERE {sql.strip('title')} <> ''"
    bodies = f"""SELECT b.ticket_id, b.ticket_url, b.status, b.closed_at, b.created_at, a.id AS article_id, {_SENDER.replace('sender_type', 'a.sender_type')} AS sender_type, 'article' AS content_type,
      a.article_position = 0 AS is_first_user_article, a.article_position, {sql.strip('a.body')} AS text FROM (SELECT {_BASE} FROM {seen}) b JOIN arts a USING (ticket_id) WHERE {sql.strip('a.body')} <> ''"""
    columns = "ticket_id, ticket_url, status, closed_at, created_at, article_id, sender_type, content_type, is_first_user_article, article_position, chunk_index, text"
    return f"SELECT {_uuid('''ticket_id || '_' || article_id || '_' || chunk_index''')} AS point_id, {columns} FROM (SELECT {columns} FROM ({titles}) UNION ALL SELECT {columns} FROM ({_chunks(bodies)}))"


_OUTCOMES = f"""{_T}, {sql.ARTICLES}, seen AS (SELECT *, {_skip('title', False)} AS skipped FROM tks WHERE {_RIPE}), used AS (SELECT * FROM seen WHERE NOT skipped),
  chunks AS ({_points('used')}), pending AS (SELECT * FROM chunks WHERE point_id NOT IN (SELECT point_id FROM points WHERE point_id IS NOT NULL)),
  counted AS (SELECT id, skipped, (SELECT count(*) FROM chunks c WHERE c.ticket_id = s.id) AS n_chunks, (SELECT count(*) FROM pending c WHERE c.ticket_id = s.id) AS n_new,
    (SELECT count(*) FROM arts c WHERE c.ticket_id = s.id) AS n_articles FROM seen s),
  outcomes AS (SELECT id, CASE WHEN skipped THEN 'skipped_title' WHEN n_chunks = 0 THEN 'empty' WHEN n_new = 0 THEN 'skipped_existing' ELSE 'processed' END AS outcome,
    n_chunks, n_new, CASE WHEN skipped THEN 0 ELSE n_articles END AS n_articles FROM counted)"""
_METRICS = f"""{_OUTCOMES}, metrics AS (SELECT count(*) AS total_tickets_seen, count(*) FILTER (outcome = 'skipped_title') AS tickets_skipped_title, count(*) FILTER (outcome = 'skipped_existing') AS tickets_skipped_existing,
  count(*) FILTER (outcome = 'processed') AS tickets_processed, coalesce(sum(n_new), 0)::BIGINT AS total_chunks_created, coalesce(sum(n_articles), 0)::BIGINT AS articles_processed FROM outcomes)"""
_CONTENT = f"""{_T}, {sql.ARTICLES}, bodies AS (SELECT ticket_id, string_agg(chr(10) || '---' || chr(10) || body, '' ORDER BY article_position, id) AS bodies FROM arts WHERE {sql.not_blank('body')} GROUP BY ticket_id),
  contents AS (SELECT id, coalesce(title, '') AS title, {sql.strip("'Titel: ' || coalesce(title, '') || chr(10) || coalesce(bodies, '')")} AS content, coalesce(created_at, '') AS created_at, customer_id, coalesce(state, 'new') AS state
    FROM tks LEFT JOIN bodies ON id = ticket_id)"""

ORACLES = {
    "latest_tickets": f"{_T} SELECT id, title, state_id, epoch_us(loaded_at) AS loaded_us FROM tks",
    "iso_dates": f"{_A} SELECT id, {sql.parse('created_at')} AS created_us FROM arts",
    "ticket_date_filter": f"{_T} SELECT id, {sql.parse('close_at')} AS closed_us FROM tks WHERE {_RIPE}",
    "start_dates": f"{_T} SELECT id, coalesce({sql.parse('created_at')}, epoch_us(TIMESTAMPTZ '2018-01-01 00:00:00+00')) AS start_us FROM tks",
    "title_skip": f"{_T} SELECT id, {_skip('title', False)} AS strict, {_skip('title', True)} AS lowered FROM tks",
    "state_names": f"{_T} SELECT id, CASE coalesce(state_id, 0) WHEN 0 THEN 'unknown' WHEN 1 THEN 'new' WHEN 2 THEN 'open' WHEN 3 THEN 'pending reminder' WHEN 4 THEN 'closed' WHEN 5 THEN 'merged' WHEN 6 THEN 'pending close' ELSE 'unknown(' || state_id || ')' END AS state_name FROM tks",
    "sender_map": f"{_A} SELECT {_SENDER} AS sender_kind, count(*) AS n FROM arts GROUP BY ALL",
    "ticket_articles_left_join": f"{_T}, {sql.ARTICLES} SELECT t.id, t.customer_id, a.id AS a_id, a.article_position AS a_article_position FROM tks t LEFT JOIN arts a ON a.ticket_id = t.id",
    "article_counts": f"{_A} SELECT ticket_id, count(*) AS n_articles FROM arts WHERE ticket_id IS NOT NULL GROUP BY ticket_id",
    "single_article_tickets": f"{_T}, {sql.ARTICLES} SELECT id FROM tks WHERE (SELECT count(*) FROM arts WHERE ticket_id = tks.id) = 1",
    "young_ticket_filter": f"{_T} SELECT id FROM tks WHERE {_YOUNG}",
    "waiting_tickets": f"{_T}, {sql.ARTICLES} SELECT id FROM tks WHERE state_id IN (1, 2) AND {_YOUNG} AND (SELECT count(*) FROM arts WHERE ticket_id = tks.id) = 1",
    "unanswered_tickets": f"{_T}, {sql.ARTICLES} SELECT id FROM tks WHERE NOT EXISTS (SELECT 1 FROM arts WHERE ticket_id = tks.id AND lower(sender_type) = 'agent')",
    "generated_answers": f"{_A} SELECT id FROM arts WHERE lower(sender_type) = 'agent' AND contains(body, '{rec.ANSWER_MARK}')",
    "unprocessed_anti": f"{_T} SELECT * FROM (SELECT id, {_uuid('''id || '_0_0' ''')} AS point_id FROM tks) WHERE point_id NOT IN (SELECT point_id FROM points WHERE point_id IS NOT NULL)",
    "point_lookup": f"{_A}, {sql.POINTS} SELECT id, point_id, length(text)::INT AS n_chars FROM (SELECT id, {_uuid('''ticket_id || '_' || id || '_0' ''')} AS point_id FROM arts) JOIN (SELECT point_id, text FROM pts) USING (point_id)",
    "point_ids": f"{_A} SELECT id, {_uuid('''ticket_id || '_' || id || '_0' ''')} AS point_id FROM arts",
    "point_union": f"{_T}, {sql.ARTICLES} {_points('tks')}",
    "ingest_outcomes": f"{_OUTCOMES} SELECT * FROM outcomes",
    "ingest_metrics": f"{_METRICS} SELECT * FROM metrics",
    "ingest_report": f"""{_METRICS} SELECT concat_ws(chr(10), '=== Ingestion ===', 'Start: 2024-07-01 00:00:00', 'End: 2024-07-01 00:02:30', 'Seconds: 150.0', '', 'COUNTS:', '  total_tickets_seen: ' || total_tickets_seen,
      '  tickets_skipped_title: ' || tickets_skipped_title, '  tickets_skipped_existing: ' || tickets_skipped_existing, '  tickets_processed: ' || tickets_processed, '  total_chunks_created: ' || total_chunks_created,
      '  articles_processed: ' || articles_processed) AS report FROM metrics""",
    "ticket_content": f"{_CONTENT} SELECT * FROM contents",
    "result_snippets": f"{_A} SELECT ticket_id, string_agg((article_position + 1) || '. ' || left(body, 200) || '...' || chr(10), '' ORDER BY article_position, (article_position + 1) || '. ' || left(body, 200)) AS snippets FROM arts WHERE body IS NOT NULL AND article_position < 3 GROUP BY ticket_id",
    "prompt_fill": "SELECT DISTINCT id, 'Answer this ticket: ' || coalesce(content, '') || chr(10) || chr(10) || 'Findings:' || chr(10) || coalesce(title, '') AS prompt FROM ticket_data",
    "think_filter": "SELECT DISTINCT id, " + sql.strip("coalesce(content, '') || chr(10) || coalesce(title, '') || '<think> open'") + " AS answer FROM ticket_data",
    "client_results": f"WITH {sql.POINTS} SELECT point_id, 0e0 AS score, coalesce(text, '') AS text, ticket_id, NULL::BIGINT AS article_id, '' AS ticket_url FROM pts",
    "stream_dedup": "SELECT DISTINCT user_id || ':' || event_type AS key FROM events",
}
