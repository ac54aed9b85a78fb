"""Queries on texts: clean-up steps, HTML, windows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.html import html_to_text
from threadloom.functions.models import embed
from threadloom.operators.chunking import chunk_rows
from threadloom.plans import sql
from threadloom.plans.records import articles
from threadloom.session import table


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir, "id body loaded_at").select("id", F.coalesce("body", F.lit("")).alias("body"))


def _cleaned(function):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _bodies(spark, sf_dir).select("id", function(F.col("body")).alias("text"))

    return query


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in windows of 450 words that overlap by 50."""
    return chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def resplit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows longer than the greatest length are cut again: 200 words, overlap 20, at most 128."""
    return chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 200, 20, 128).select("doc_id", "chunk_index", F.length("text").alias("n_chars"))


def html_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles whose text nodes hold no word of their markup: those without any, which the parser leaves as they are."""
    bodies = _bodies(spark, sf_dir).where(~F.contains("body", F.lit("<")) & ~F.contains("body", F.lit("&")) & (F.col("body") != ""))
    return bodies.where(~tx.is_blank(F.col("body"))).select("id", html_to_text(F.col("body")).alias("text"))


def normalize_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clean-up steps over all bodies taken as plain text."""
    return _bodies(spark, sf_dir).select("id", tx.normalize_text(F.col("body"), html=lambda c: c).alias("text"))


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all article bodies by the default embedder: their width and whether they have unit length."""
    vectors = _bodies(spark, sf_dir).select("id", embed(F.col("body")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select("id", F.size("v").alias("width"), F.round(length, 3).alias("squared_length"))


QUERIES = {
    "strip_quotes": _cleaned(tx.strip_quotes),
    "strip_headers": _cleaned(tx.strip_headers),
    "strip_signature": _cleaned(tx.strip_signature),
    "collapse_ws": _cleaned(tx.collapse_ws),
    "dedupe_lines": _cleaned(tx.dedupe_lines),
    "html_text": _cleaned(html_to_text),
    "normalize_text": _cleaned(tx.normalize_text),
    "html_parts": html_parts,
    "normalize_plain": normalize_plain,
    "chunk_windows": chunk_windows,
    "resplit_windows": resplit_windows,
    "embed_texts": embed_texts,
}

_IN = r"\p{L}\p{N}_"


def _joined(list_of_lines: str) -> str:
    return f"array_to_string({list_of_lines}, chr(10))"


def _no_quotes(x: str) -> str:
    test = " OR ".join(f"regexp_matches(l, '(?i){p}')" for p in tx.QUOTE_LINES)
    return _joined(f"list_filter({sql.lines(x)}, lambda l: NOT ({test}))")


def _no_headers(x: str) -> str:
    return sql.strip(f"regexp_replace({x}, '(?im)^(?:{'|'.join(tx.HEADER_NAMES)}):.*$', '', 'g')")


def _no_signature(x: str) -> str:
    rstrip = lambda c: f"regexp_replace({c}, '[{sql.WS}]+$', '')"
    kept = f"list_filter(list_transform({sql.lines(x)}, lambda l: {sql.strip('l')}), lambda l: l <> '')"
    kept = f"list_transform({kept}, lambda l: {sql.strip(f'''regexp_replace(l, '(?s)[{sql.WS}]--+.*$', '')''')})"
    folded = "replace(lower(l), 'ß', 'ss')"
    cases = " ".join(f"WHEN instr({folded}, '{t.replace('ß', 'ss')}') > 0 THEN {rstrip(f'''left(l, (instr({folded}, '{t.replace('ß', 'ss')}') - 1)::INT)''')}" for t in tx.SIGNATURE_TRIGGERS)
    kept = f"list_transform({kept}, lambda l: CASE {cases} ELSE l END)"
    for pattern in (
        rf"(?is)(?:(?:https?://|www\.)[^{sql.WS}].*|(^|[^{_IN}])[a-z0-9][{_IN}.-]*\.(?:{tx.TOP_DOMAINS})(?:[^{_IN}].*)?)$",
        rf"(?is)(^|[^{_IN}])(?:{tx.CONTACT_WORDS})(?:[^{_IN}].*)?$",
        rf"(?is)(^|[^{_IN}])(?:D-\p{{Nd}}{{5}}|\p{{Nd}}{{5}})(?:[^{_IN}].*)?$",
    ):
        kept = f"list_transform({kept}, lambda l: {rstrip(f'''regexp_replace(l, '{pattern}', '\\1')''')})"
    kept = f"list_filter({kept}, lambda l: l <> '' AND NOT regexp_matches(l, '(?i)(^|[^{_IN}])(?:{tx.COMPANY})([^{_IN}]|$)'))"
    return sql.strip(_joined(kept))


def _collapsed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


_B = f"WITH {sql.ARTICLES}, bodies AS (SELECT id, coalesce(body, '') AS body FROM arts)"
_WORDS = "regexp_extract_all(text, '[^\\s\\p{Z}]+')"

ORACLES = {
    "strip_quotes": f"{_B} SELECT id, {_no_quotes('body')} AS text FROM bodies",
    "strip_headers": f"{_B} SELECT id, {_no_headers('body')} AS text FROM bodies",
    "strip_signature": f"{_B} SELECT id, {_no_signature('body')} AS text FROM bodies",
    "collapse_ws": f"{_B} SELECT id, {_collapsed('body')} AS text FROM bodies",
    "dedupe_lines": f"""{_B}, cut AS (SELECT id, {sql.lines('body')} AS ls FROM bodies), keyed AS (SELECT id, ls, list_transform(ls, lambda l: {sql.strip('l')}) AS ks FROM cut)
        SELECT id, array_to_string(list_transform(list_filter(list_zip(ls, ks), lambda x, i: x[2] = '' OR list_position(ks, x[2]) = i), lambda x: CASE WHEN x[2] = '' THEN '' ELSE x[1] END), chr(10)) AS text FROM keyed""",
    "html_parts": f"{_B} SELECT id, body AS text FROM bodies WHERE NOT contains(body, '<') AND NOT contains(body, '&') AND {sql.not_blank('body')}",
    "normalize_plain": f"""{_B}, a AS (SELECT id, {_no_quotes('body')} AS t FROM bodies), b AS (SELECT id, {_no_headers('t')} AS t FROM a), c AS (SELECT id, {_no_signature('t')} AS t FROM b),
        d AS (SELECT id, string_split({_collapsed('t')}, chr(10)) AS ls FROM c) SELECT id, {sql.strip("array_to_string(list_filter(ls, lambda l, i: list_position(ls, l) = i), chr(10))")} AS text FROM d""",
    "chunk_windows": f"""SELECT doc_id, i::INT AS chunk_index, array_to_string(CASE WHEN len(toks) <= 450 THEN toks ELSE toks[i * 400 + 1 : i * 400 + 450] END, ' ') AS text
        FROM (SELECT doc_id, toks, unnest(CASE WHEN len(toks) <= 450 THEN [0] ELSE range(0, (len(toks) + 399) // 400) END) AS i FROM (SELECT doc_id, {_WORDS} AS toks FROM documents) WHERE len(toks) > 0)""",
    "resplit_windows": f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_index, length(array_to_string(w[j * 128 + 1 : j * 128 + 128], ' '))::INT AS n_chars
        FROM (SELECT doc_id, n, i, w, unnest(range(0, (len(w) + 127) // 128)) AS j FROM (SELECT doc_id, len(toks) AS n, i, CASE WHEN len(toks) <= 200 THEN toks ELSE toks[i * 180 + 1 : i * 180 + 200] END AS w
          FROM (SELECT doc_id, toks, unnest(CASE WHEN len(toks) <= 200 THEN [0] ELSE range(0, (len(toks) + 179) // 180) END) AS i FROM (SELECT doc_id, {_WORDS} AS toks FROM documents) WHERE len(toks) > 0))) WHERE n > 200
        UNION ALL SELECT doc_id, 0 AS chunk_index, length(array_to_string(toks, ' '))::INT AS n_chars FROM (SELECT doc_id, {_WORDS} AS toks FROM documents) WHERE len(toks) BETWEEN 1 AND 200""",
    "embed_texts": f"{_B} SELECT id, 16::INT AS width, CASE WHEN {sql.not_blank('body')} THEN 1e0 ELSE 0e0 END AS squared_length FROM bodies",
}
