"""Pieces of SQL that the checks of several queries share."""

from __future__ import annotations

from threadloom.functions.text import STOP_WORDS, WS

WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def fold(x: str) -> str:
    """Lower case with the compatibility letters that occur in the tables made plain."""
    return f"replace(lower(translate({x}, 'ºª{WIDE}', 'oa{NARROW}')), 'ß', 'ss')"


def words(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    return f"list_filter(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda w: {fold('w')}), lambda w: NOT list_contains([{stops}], w))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def not_blank(x: str) -> str:
    return f"regexp_matches({x}, '[^{WS}]')"


def parse(x: str) -> str:
    """Microseconds since the epoch of an ISO date, else null."""
    zoned = f"CASE WHEN length({x}) = 10 THEN {x} || ' 00:00:00+00' WHEN regexp_matches({x}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {x} ELSE {x} || '+00' END"
    return f"CASE WHEN regexp_matches({x}, '{ISO}') THEN epoch_us(try_cast({zoned} AS TIMESTAMPTZ)) END"


def lines(x: str) -> str:
    """The lines of a text without the empty one after a last line end."""
    cut = f"regexp_split_to_array({x}, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\x{{2028}}\\x{{2029}}]')"
    return f"list_filter({cut}, lambda l, i: l <> '' OR i < len({cut}))"


POINTS = "pts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM points) WHERE rn = 1)"
TOKENS = f"toks AS (SELECT point_id, {words('text')} AS words FROM pts WHERE {not_blank('text')})"
STATS = """tf AS (SELECT point_id, dl, term, count(*) AS tf FROM (SELECT point_id, len(words) AS dl, unnest(words) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stats AS (SELECT greatest(1, count(*)) AS n_docs, coalesce(sum(len(words)), 0)::BIGINT AS total_length, coalesce(sum(len(words)), 0)::DOUBLE / greatest(1, count(*)) AS avgdl FROM toks)"""


def weight(tf: str, dl: str, k1: float = 0.9, b: float = 0.4) -> str:
    return f"ln((n_docs - df + 0.5e0) / (df + 0.5e0) + 1e0) * ({tf} * {k1 + 1.0}e0) / greatest(1e-9, {tf} + {k1}e0 * ({1.0 - b}e0 + {b}e0 * greatest(1, {dl}) / greatest(1e-9, avgdl)))"


WEIGHTS = f"weights AS (SELECT point_id, term, {weight('tf', 'dl')} AS weight FROM tf JOIN dfs USING (term) CROSS JOIN stats)"
QUERIES = f"""qs AS (SELECT ticket_id AS query_id, text AS query, dense FROM pts WHERE content_type = 'title' AND ticket_id % 100 = 0),
qtok AS (SELECT query_id, {words("coalesce(query, '')")} AS words FROM qs),
qtf AS (SELECT query_id, dl, term, count(*) AS tf FROM (SELECT query_id, len(words) AS dl, unnest(words) AS term FROM qtok) GROUP BY ALL),
asked AS (SELECT query_id, term, {weight('tf', 'dl')} AS weight FROM qtf JOIN dfs USING (term) CROSS JOIN stats)"""


def ranked(name: str, scored: str, k: int, key: str = "point_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM ({scored})) WHERE rank <= {k})"


SPARSE = "SELECT query_id, point_id, round(sum(w.weight * a.weight), 6) AS score FROM weights w JOIN asked a USING (term) GROUP BY ALL"
DENSE = "SELECT query_id, point_id, round(list_cosine_similarity(p.dense::DOUBLE[], q.dense::DOUBLE[]), 6) + 0e0 AS score FROM qs q CROSS JOIN pts p WHERE p.dense IS NOT NULL AND q.dense IS NOT NULL"
FUSED = """fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) AS fused_pos FROM (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.point_id, s.point_id) AS point_id,
    round(coalesce(1e0 / (60 + d.rank), 0e0) + coalesce(1e0 / (60 + s.rank), 0e0), 12) AS score, coalesce(d.rank, s.rank + 100) AS tie
  FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.point_id = s.point_id)) WHERE fused_pos <= 100)"""
RERANKED = f"""hits AS (SELECT f.query_id, f.point_id, f.fused_pos, p.ticket_id, p.text, list_distinct({words("coalesce(q.query, '')")}) AS qw, {words("coalesce(p.text, '')")} AS tw FROM fused f JOIN pts p USING (point_id) JOIN qs q USING (query_id)),
scored AS (SELECT *, round(CASE WHEN len(qw) = 0 THEN 0e0 ELSE len(list_intersect(qw, tw))::DOUBLE / len(qw) END, 6) AS rerank_score FROM hits),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_pos) AS reranked_pos FROM scored),
tickets_found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_pos) AS ticket_rank FROM (
  SELECT query_id, ticket_id, greatest(0e0, max(rerank_score)) AS score, min(reranked_pos) AS first_pos FROM reranked WHERE ticket_id IS NOT NULL GROUP BY ALL)) WHERE ticket_rank <= 10)"""
ALL_LISTS = f"{POINTS}, {TOKENS}, {STATS}, {WEIGHTS}, {QUERIES}, {ranked('dense', DENSE, 100)}, {ranked('sparse', SPARSE, 100)}"
TICKETS = "tks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM tickets) WHERE rn = 1)"
ARTICLES = "arts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM articles) WHERE rn = 1)"
