"""Text functions on columns: line handling, clean-up of mail text, words for retrieval, templates.

White space means the same in every function here and in Python's str.strip: the class ``WS`` below.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Members of a character class for white space, readable by Java's and RE2's patterns alike.
WS = r"\s\p{Z}\x0B\x1C-\x1F\x85"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}]+"
_INSIDE = r"\p{L}\p{N}_"
#: Word borders as Unicode letters, digits and the underscore make them.
_B, _E = rf"(?<![{_INSIDE}])", rf"(?![{_INSIDE}])"

# Which lines are quotes, mail headers or signatures.
QUOTE_LINES = [rf"(?s)^-{{2,}}[{WS}]*Ursprüngliche Nachricht[{WS}]*-{{2,}}$", r"(?s)^Von: .+ schrieb:$", r"(?s)^Am .+ schrieb:$"]
HEADER_NAMES = ["Von", "An", "Datum", "Betreff"]
SIGNATURE_TRIGGERS = [
    "mit freundlichen grüßen",
    "viele grüße",
    "best regards",
    "kind regards",
    "i.v.",
    "i.a.",
    "tel.:",
    "telefon:",
    "fax:",
    "sitz der gesellschaft",
    "geschäftsführer",
    "amtsgericht",
    "www.",
    "besuchen sie uns",
    "im internet",
    "-- it service",
    "it service",
]
COMPANY = "gmbh|ag|kg|gesmbh|inc|ltd"
TOP_DOMAINS = "local|lan|de|com|net|org"
CONTACT_WORDS = r"tel\.?|telefon|fax|e-?mail|email|kontakt"
THINKING = "(?s)<think>.*?</think>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{WS}]")


def simple_fold(c: Column) -> Column:
    """Case folding by built-in functions; equal to full case folding for texts without rare letters."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def lines(c: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line. An empty text has none."""
    cut = F.split(c, LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


def is_quote_line(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(f"(?iu){p}") for p in QUOTE_LINES])


def strip_quotes(c: Column) -> Column:
    """Without lines that announce or frame a quoted message."""
    return unlines(F.filter(lines(c), lambda line: ~is_quote_line(line)))


def strip_headers(c: Column) -> Column:
    """Mail header lines blanked out, ends stripped."""
    return strip(F.regexp_replace(c, rf"(?imud)^(?:{'|'.join(HEADER_NAMES)}):.*$", ""))


def _cut_at_trigger(line: Column) -> Column:
    """A line up to the first trigger, in order of the list, that it holds; cut by its position in the folded line."""
    both = F.struct(line.alias("raw"), simple_fold(line).alias("folded"))

    def one(pair: Column) -> Column:
        found = F.coalesce(*[F.nullif(F.instr(pair["folded"], trigger.replace("ß", "ss")), F.lit(0)) for trigger in SIGNATURE_TRIGGERS])
        return F.when(found.isNull(), pair["raw"]).otherwise(rstrip(F.substring(pair["raw"], F.lit(1), found - 1)))

    return F.transform(F.array(both), one)[0]


def _cut_at(pattern: str) -> Callable[[Column], Column]:
    return lambda line: rstrip(F.regexp_replace(line, pattern, ""))


def strip_signature(c: Column) -> Column:
    """Signature parts cut out of each line, firm lines and blank lines dropped.

    In each line: stripped; what follows white space and two dashes goes; then what follows the first trigger, a link or
    domain, a contact word, a postcode; then the line itself if it names a legal form.
    """
    domain = rf"(?ius)(?:(?:https?://|www\.)[^{WS}]|{_B}[a-z0-9][{_INSIDE}.-]*\.(?:{TOP_DOMAINS}){_E}).*$"
    contact = rf"(?ius){_B}(?:{CONTACT_WORDS}){_E}.*$"
    postcode = rf"(?ius){_B}(?:D-\p{{Nd}}{{5}}|\p{{Nd}}{{5}}){_E}.*$"
    kept = F.filter(F.transform(lines(c), strip), lambda line: line != "")
    kept = F.transform(kept, lambda line: strip(F.regexp_replace(line, rf"(?s)[{WS}]--+.*$", "")))
    kept = F.transform(kept, _cut_at_trigger)
    for pattern in (domain, contact, postcode):
        kept = F.transform(kept, _cut_at(pattern))
    kept = F.filter(kept, lambda line: (line != "") & ~line.rlike(rf"(?iu){_B}(?:{COMPANY}){_E}"))
    return strip(unlines(kept))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def dedupe_lines(c: Column) -> Column:
    """The first of equal lines (compared without white space at the ends) with its spacing; every blank line as an empty one."""

    def kept(row: Column, keys: Column) -> Column:
        return F.filter(row, lambda line, i: (keys[i] == "") | (F.array_position(keys, keys[i]) == i + 1))

    all_lines = lines(c)
    keys = F.transform(all_lines, strip)
    bound = F.transform(F.array(F.struct(all_lines.alias("l"), keys.alias("k"))), lambda x: kept(x["l"], x["k"]))[0]
    return unlines(F.transform(bound, lambda line: F.when(is_blank(line), F.lit("")).otherwise(line)))


def normalize_text(c: Column, html: Callable[[Column], Column] | None = None) -> Column:
    """All clean-up steps in order: visible text, quotes, headers, signatures, white space, repeated lines. Null gives ''."""
    from threadloom.functions.html import html_to_text

    text = (html or html_to_text)(F.coalesce(c, F.lit("")))
    text = collapse_ws(strip_signature(strip_headers(strip_quotes(text))))
    return strip(unlines(F.array_distinct(F.split(text, "\n", -1))))  # no blank lines are left, so distinct keeps the first of each


# German stop words, those that are inflected alike by their stems.
_INFLECTED = "all ander dies einig jed manch solch welch kein mein dein sein ihr ein"
_ENDINGS = "e em en er es"
_PLAIN = (
    "aber als also am an ander anderm andern anderr auch auf aus bei bin bis bist da dadurch dafür dagegen daher damit dann das dasselbe dass dazu "
    "dein dem den denn der dessen deshalb die dies doch dort du durch ein einig einmal er es etwas euer eure eurem euren eurer eures für gegen gewesen "
    "hab habe haben hat hatte hatten hattest hattet hier hin hinter ich ihm ihn ihnen ihr im in ist ja je jetzt kann kein können könnte machen man "
    "mein mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein selbst sich sie sind so soll sollte sondern sonst um und "
    "uns unse unser unsrem unsren unsrer unsres unter vom von vor wann war waren warst was weg weil weiter wenn wer wird wirst wo wollen wollte "
    "würde würden zu zum zur zwar zwischen"
)


def stop_words() -> frozenset[str]:
    inflected = {stem + ending for stem in _INFLECTED.split() for ending in _ENDINGS.split()}
    return frozenset(inflected | set(_PLAIN.split()))


STOP_WORDS = stop_words()

#: A letter for which built-in lower case may differ from compatibility normalization and full case folding; ASCII is asked first.
_RARE = r"[^\x00-\x7F](?<![\x80-\xA9\xAB-\xB1\xB4\xB6-\xB8\xBB\xBF-\x{12F}\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{2010}-\x{205E}\x{20A0}-\x{20BF}\x{2190}-\x{2BFF}])"


@F.arrow_udf(ArrayType(StringType()))
def _fold_words(lists: pa.Array) -> pa.Array:
    folded = [None if words is None else [unicodedata.normalize("NFKC", w).casefold() for w in words] for words in lists.to_pylist()]
    return pa.array(folded, type=pa.list_(pa.string()))


def has_rare(c: Column) -> Column:
    return c.rlike(_RARE)


def raw_words(c: Column, rare: Column) -> Column:
    """Runs of letters and digits; folded already where the text has common letters only."""
    return F.regexp_extract_all(F.when(rare, c).otherwise(simple_fold(c)), F.lit(f"({WORD})"), F.lit(1))


def folded(found: Column, rare: Column) -> Column:
    return F.coalesce(_fold_words(F.when(rare, found)), found)


def counting(found: Column, stops: frozenset[str] = STOP_WORDS) -> Column:
    """Without stop words and empty words."""
    left_out = sorted(stops | {""})
    return F.filter(found, lambda w: ~w.isin(left_out))


def words(c: Column) -> Column:
    """Runs of letters and digits, normalized (NFKC) and case-folded. Null gives null.

    Texts of common letters are folded whole by built-in functions; only the words of others go through Python.
    """
    return folded(raw_words(c, has_rare(c)), has_rare(c))


def search_words(c: Column, stops: frozenset[str] = STOP_WORDS) -> Column:
    """The words of a text that count in retrieval: without stop words and empty words."""
    return counting(words(c), stops)


def without_thinking(c: Column) -> Column:
    """A model's answer without its <think> parts; an unclosed one stays."""
    return strip(F.regexp_replace(c, THINKING, ""))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns, in the order given."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def escape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def short_id() -> Column:
    """Eight random characters."""
    return F.substring(F.uuid(), 1, 8)


def shortened(c: Column, length: int) -> Column:
    """At most ``length`` characters, with dots where something was cut off."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def translate(c: Column, exact: dict[str, str], patterns: list[tuple[str, str]]) -> Column:
    """A text found in ``exact`` is exchanged whole, any other is rewritten by the patterns in order."""
    rewritten = reduce(lambda text, p: F.regexp_replace(text, p[0], p[1]), patterns, c)
    if not exact:
        return rewritten
    known = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), rewritten)


def split_numbers(c: Column) -> Column:
    """The whole numbers of a list with commas; what is no number is left out."""
    return F.array_compact(F.transform(F.split(c, ","), lambda x: strip(x).try_cast("int")))


def log_fields(line: Column) -> Column:
    """(timestamp, level, message) of a line '[ts] LEVEL: message'; without these marks the level is INFO and the time null."""
    stamp, rest = F.regexp_extract(line, r"^(.*?)\] (.*)$", 1), F.regexp_extract(line, r"^(.*?)\] (.*)$", 2)
    has_level = F.contains(rest, F.lit(": "))
    level, message = F.regexp_extract(rest, r"^(.*?): (.*)$", 1), F.regexp_extract(rest, r"^(.*?): (.*)$", 2)
    marked = F.contains(line, F.lit("] ")) & F.contains(line, F.lit(": "))
    return F.struct(
        F.when(marked, F.regexp_replace(stamp, r"^\[+|\[+$", "")).alias("timestamp"),
        F.when(marked & has_level, strip(level)).otherwise(F.lit("INFO")).alias("level"),
        strip(F.when(marked & has_level, message).when(marked, rest).otherwise(line)).alias("message"),
    )
