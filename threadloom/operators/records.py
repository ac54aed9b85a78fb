"""Operators on records and their articles: latest versions, filters, counts, ordered texts, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.dates import days_before, parse_iso, start_cutoff
from threadloom.functions.text import is_blank, strip

# Names of the states by number, titles and parts of titles that keep a record out of the index.
STATES = {1: "new", 2: "open", 3: "pending reminder", 4: "closed", 5: "merged", 6: "pending close"}
SKIP_TITLES = ["Returned mail: see transcript for details", "Undelivered Mail", "Alarm Notice!", "Mercury Managed Print Services Fehler"]
SKIP_KEYWORDS = [
    "[suspected phishing]",
    "[suspected spam]",
    "SQL Server-Warnungssystem:",
    "[Fehler] SQL Server-Auftragssystem:",
    "Undelivered Mail",
    "Alarm Notice!",
    "USV-SR1-01 - Periodic report",
    "Periodic report - Eaton 9PX 5000i",
    "Mercury Managed Print Services Fehler",
]
ANSWER_MARK = "🤖 KI-Assistent Antwort"


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, that of the latest version; of equal versions any one. Rows without a key stay as they are.

    Rows that share a key are thinned out before the shuffle, so a key repeated in a third of all rows makes no hot task.
    Columns named like the two arguments keep their place; no others are touched.
    """
    others = [c for c in df.columns if c != key]
    newest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(version).isNotNull(), F.col(version))).alias("__row"))
    kept = newest.select(*[F.col(key) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns])
    return kept.unionByName(df.where(F.col(key).isNull()))


def ripe(as_of: Column, min_age_days: int, start_date: str, created: str = "created_at", closed: str = "close_at") -> Column:
    """Closed at least so many days ago and not created before the start; an unreadable creation date doesn't matter."""
    closed_at, created_at = parse_iso(F.col(closed)), parse_iso(F.col(created))
    start = start_cutoff(F.lit(start_date))
    return F.coalesce((closed_at <= days_before(as_of, min_age_days)) & (created_at.isNull() | (created_at >= start)), F.lit(False))


def skipped_title(title: Column, strict: bool = True) -> Column:
    """Titles that keep a record out: equal to a listed one when stripped, or, in lower case, holding a keyword.

    The keywords are compared as they stand, so that one with capitals matches nothing; ``strict=False`` lowers them too.
    A null or empty title is kept.
    """
    clean = strip(title)
    lower = F.lower(clean)
    found = [F.contains(lower, F.lit(k if strict else k.lower())) for k in SKIP_KEYWORDS if not strict or k == k.lower()]
    hit = clean.isin(SKIP_TITLES)
    for one in found:
        hit = hit | one
    return F.coalesce(hit, F.lit(False)) & F.coalesce(title != "", F.lit(False))


def state_name(state_id: Column) -> Column:
    name = F.when(state_id.isNull() | (state_id == 0), F.lit("unknown"))
    for number, text in STATES.items():
        name = name.when(state_id == number, F.lit(text))
    return name.otherwise(F.concat(F.lit("unknown("), state_id.cast("string"), F.lit(")")))


def sender_kind(sender: Column) -> Column:
    return F.when(F.lower(sender).isin("customer", "user"), F.lit("User")).otherwise(F.lit("Agent"))


def young(created: Column, as_of: Column, max_age_days: int) -> Column:
    """Created at most so many days ago; also true without a readable date with a time zone, or without an age limit."""
    if max_age_days <= 0:
        return F.lit(True)
    zoned = F.when(created.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), parse_iso(created))
    return F.coalesce(zoned >= days_before(as_of, max_age_days), F.lit(True))


def is_open(state_id: Column) -> Column:
    return F.coalesce(state_id.isin(1, 2), F.lit(False))


def with_articles(tickets: DataFrame, articles: DataFrame, key: str = "id") -> DataFrame:
    """Every record with each of its articles; without any, once with null article columns (named a_...).

    Articles of one record may be a third of all rows: only the narrow record side repeats, and adaptive execution splits
    the wide one.
    """
    renamed = articles.select(F.col("ticket_id").alias("__t"), *[F.col(c).alias(f"a_{c}") for c in articles.columns if c != "ticket_id"])
    return tickets.join(renamed, F.col(key) == F.col("__t"), "left").drop("__t")


def article_counts(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("ticket_id").isNotNull()).groupBy("ticket_id").agg(F.count("*").alias("n_articles"))


def with_single_article(tickets: DataFrame, articles: DataFrame, key: str = "id") -> DataFrame:
    once = article_counts(articles).where("n_articles = 1").select(F.col("ticket_id").alias(key))
    return tickets.join(once, key, "left_semi")


def unanswered(tickets: DataFrame, articles: DataFrame, key: str = "id") -> DataFrame:
    """Records without an article of an agent, hence also without an earlier generated answer."""
    answered = articles.where(F.lower("sender_type") == "agent").select(F.col("ticket_id").alias(key)).distinct()
    return tickets.join(answered, key, "left_anti")


def generated_answers(articles: DataFrame) -> DataFrame:
    return articles.where((F.lower("sender_type") == "agent") & F.contains("body", F.lit(ANSWER_MARK)))


def without(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among the known ones; rows without a key are new."""
    return new.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def ordered_concat(rows: DataFrame, group: list[str], order: list[str], text: str, out: str = "text", separator: str = "\n", block: int = 512, length: int | None = None, blank: bool = True) -> DataFrame:
    """The non-empty texts of each group in order (nulls last), joined: (group, out).

    A group is joined in blocks by its first order column, and the blocks then by group, so no task holds a group's rows;
    the result is one value, which can't exceed what a string can hold (2 GB). With a ``length`` it is the first characters
    of that value; texts and blocks are cut as well, as none gives more. ``blank=False`` leaves out groups of blank texts.
    """
    first = F.col(order[0])
    slot = F.when(first.isNull(), F.lit(None)).otherwise(F.floor(first / block)).cast("long")
    keys = [F.col(o) for o in order]
    head = (lambda c: c) if length is None else (lambda c: F.substring(c, 1, length))
    sortable = F.struct(*[x for i, k in enumerate(keys) for x in (k.isNull().alias(f"n{i}"), k.alias(f"k{i}"))], head(F.col(text)).alias("t"))
    seen = F.lit(True) if blank else ~is_blank(F.col(text))
    kept = rows.where(F.col(text).isNotNull() & (F.col(text) != ""))
    parts = kept.groupBy(*group, slot.alias("__slot")).agg(head(_joined(sortable, separator)).alias("__part"), F.max(seen).alias("__seen"))
    whole = F.struct(F.col("__slot").isNull().alias("n"), F.col("__slot").alias("k"), F.col("__part").alias("t"))
    joined = parts.groupBy(*group).agg(head(_joined(whole, separator)).alias(out), F.max("__seen").alias("__seen"))
    return joined.where("__seen").select(*group, out)


def _joined(sortable: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(sortable)), lambda x: x["t"]), separator)


def ticket_content(tickets: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, title, content, created_at, customer_id, state) of each record: title line, then each article that isn't blank."""
    bodies = articles.where(~is_blank(F.col("body"))).withColumn("__b", F.concat(F.lit("\n---\n"), F.col("body")))
    bodies = ordered_concat(bodies, ["ticket_id"], ["article_position", "id"], "__b", "__bodies", "")
    joined = tickets.join(bodies, F.col("id") == F.col("ticket_id"), "left")
    title = F.coalesce(F.col("title"), F.lit(""))
    content = strip(F.concat(F.lit("Titel: "), title, F.lit("\n"), F.coalesce("__bodies", F.lit(""))))
    return joined.select("id", title.alias("title"), content.alias("content"), F.coalesce("created_at", F.lit("")).alias("created_at"), "customer_id", F.coalesce("state", F.lit("new")).alias("state"))


def snippets(results: DataFrame, group: list[str], rank: str, text: str, count: int = 3, length: int = 200, out: str = "snippets") -> DataFrame:
    """The first results of each group as numbered lines of at most ``length`` characters and three dots."""
    line = F.concat(F.col(rank).cast("string"), F.lit(". "), F.substring(text, 1, length), F.lit("...\n"))
    top = results.where(F.col(rank) <= count).select(*group, F.struct(F.col(rank).alias("k"), line.alias("t")).alias("__s"))
    return top.groupBy(*group).agg(_joined(F.col("__s"), "").alias(out))
