"""Template residue, filler and error pages.

What has the marks of a placeholder is an unfilled slot unless its own sentence speaks of templates or scripts or asks
about it; other records have no say in that. What has no marks, a bare variable name or a gap where a value fell out, is
decided by aligning records: their sentences are keyed by the words around each place, and a place that other records
fill with differing values is a slot. Whole texts are matched, line by line, with the vocabulary of error pages,
notices and filler; pages with only weak words, or with just the headline of an error page, count if they are repeated.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.newtext import new_lines, own_lines
from threadloom.session import stored

_IN = r"[^\W\d_][\w.\- ]{0,38}?"
PLACEHOLDER = re.compile(
    rf"\{{\{{.{{1,40}}?\}}\}}|[$#]\{{.{{1,40}}?\}}|<%=?.{{1,40}}?%>|\{{%.{{1,40}}?%\}}|\[\[.{{1,40}}?\]\]|\*\|.{{1,40}}?\|\*|\(\( ?{_IN} ?\)\)|@@{_IN}@@|(?<!_)__(?=[^\W_]){_IN}__(?!_)"
    rf"|%(?=[^\W\d_]){_IN}%|\$(?=[^\W\d_]){_IN}\$|\{{{_IN}\}}|(?P<weak>«{_IN}»|<{_IN}>|\[{_IN}\])"
)
#: A text without any of these holds no placeholder.
MARKS = re.compile(r"\{[{%\w]|[$#]\{|<%|\[(?!at\]|dot\])[\[\w]|\*\||\(\(|@@|__\w|%[^\W\d_]|\$[^\W\d_]|«[^\W\d_]|<[^\W\d_][\w.\- ]{0,38}>", re.I)
MARK_SIGNS = re.compile(r"[{\[<«%$#@_*(]")
DEFAULT = re.compile(r"insert\b.*\bhere|hier (?:einfügen|eingeben|eintragen)|goes here|(?:vor|first ?)name,? (?:nach|last ?)name|your (?:name|text)|enter .* here", re.I)
IDENTIFIER = re.compile(r"[^\W\d_]+(?:[._-][^\W_]+)+$|[^\W\d_]{2,}$|[^\W\d_]+[A-ZÄÖÜ][^\W_]*$")
NOT_SLOTS = frozenset("at dot ät punkt sic info warn warning error debug fatal trace notice".split())
MENTION = re.compile(r"vorlage|template|variable|skript|script|platzhalter|placeholder|\bprints?\b|druckbild|agentur|carta tipo|plantilla|modèle|lettre type|statt des|instead of|fehlt im|serienbrief|steht immer noch|entwurf|\bdraft\b|betreff steht|field shows|feld zeigt|le champ|el campo|brouillon|borrador", re.I)
#: Questions about a placeholder, rather than ones that hold it.
ASKS = re.compile(r"\b(?:wieso|weshalb|warum|was (?:ist|bedeutet|soll|heißt)|wofür steht|why|what (?:is|does|do)|pourquoi|que signifie|por qué|qué (?:es|significa))\b.*\?\s*$", re.I)
TITLE_PREFIX = re.compile(r"(?:(?:AW|WG|RE|FW|FWD|SV|ANTW|TR|RV)\s*:\s*|\[Ticket#\d+\]\s*|\[Suspected \w+\]\s*|Automatische Antwort:\s*)+", re.I)

STATUS = r"(?:Bad Gateway|Not Found|Forbidden|(?:Internal )?Server Error|Service (?:Temporarily )?Unavailable|Gateway Time-?out|Bad Request|Unauthorized|Too Many Requests|Request Time-?out)"
SCRIPTS = r"(?:java-?scripts?|scripting|scripts?|skripte?n?|cookies|aktive inhalte|active content)"
#: Sentences that only error pages, notices and filler have; matched over the whole sentence.
STRONG = re.compile(
    rf"(?:(?:HTTP(?:/[\d.]+)?|Status|Error|Fehler)\s*)?[45]\d\d\b[\s:–-]*{STATUS}|{STATUS}|(?:Error|Fehler|HTTP|Status) [45]\d\d"
    r"|(?:Zugriff verweigert|Access denied)(?: - .*)?|access to this (?:page|site|resource) (?:has been|is|was) denied"
    rf"|{SCRIPTS} (?:ist |sind |is |are |wird |werden |wurden? )?(?:required|needed|erforderlich|benötigt|nötig|notwendig|blockiert|gesperrt|blocked|disabled|deaktiviert|abgeschaltet|nicht verfügbar|unavailable|not available|off|aus)\b.{{0,80}}"
    rf"|(?:this|the|diese|die|unsere?) (?:page|site|website|app|application|seite|anwendung|ansicht) (?:needs|requires|uses|benötigt|braucht|erfordert) {SCRIPTS}"
    rf"|(?:please |bitte )?(?:enable|turn on|allow|activate|aktivieren sie|erlauben sie|schalten sie|switch on) (?:{SCRIPTS})\b.{{0,90}}|bitte {SCRIPTS} (?:aktivieren|einschalten|erlauben|zulassen)"
    rf"|(?:um fortzufahren|to continue),? (?:erlauben|aktivieren|allow|enable)\b.{{0,20}}{SCRIPTS}.{{0,50}}|nous avons besoin de {SCRIPTS}.{{0,50}}|{SCRIPTS} (?:est|doit|deben?|está).{{0,60}}"
    rf"|(?:ihr browser wird geprüft|checking your browser).{{0,90}}|{SCRIPTS}(?: und {SCRIPTS})? müssen .{{0,30}}|.{{0,60}}nur mit (?:aktivierten |eingeschalteten ){SCRIPTS}.{{0,30}}"
    rf"|if nothing happens, enable {SCRIPTS}|die anwendung kann ohne {SCRIPTS} nicht.{{0,40}}|please enable {SCRIPTS}.{{0,40}}"
    r"|(?:ihre |your |the |die )?(?:sitzung|session|anmeldung) (?:ist |has |is )?(?:abgelaufen|expired|timed out)|unexpected error|(?:oops!? ?)?something (?:went wrong|broke)\b.{0,30}|(?:leider )?ist ein (?:unerwarteter )?fehler aufgetreten"
    r"|ein (?:unerwarteter )?fehler ist aufgetreten|wartungsarbeiten|(?:maintenance|wartung) in progress|(?:der |dieser |the )?(?:service|dienst) (?:ist |is )?(?:derzeit|zurzeit|momentan|currently|temporarily) (?:nicht verfügbar|unavailable).{0,30}"
    r"|zu viele anfragen.{0,40}|too many requests.{0,40}|die angeforderte seite .{0,50}|the requested (?:page|url) .{0,50}|the server (?:cannot|could not|is unable|can't) .{0,80}|seite nicht gefunden|page not found"
    r"|traceback \(most recent call last\)|\w*template\w*error.{0,60}|loading(?:…|\.\.\.)|une erreur est survenue|ha ocurrido un error"
    r"|(?:dies ist ein |das ist ein |this is )?(?:(?:blind|muster|beispiel|platzhalter|dummy|füll|lorem-ipsum-)[ -]?te(?:xt|st)[\s.,!]*)+(?:,? bitte .{0,40})?|(?:sample|dummy|placeholder|example) (?:content|text|copy)\b.{0,50}"
    r"|hier (?:steht|kommt|folgt) (?:später|noch|dann|bald) .{0,60}|.{0,40}\bgoes here|<?[\w ]{0,30}\bhier (?:eingeben|einfügen|eintragen)>?|(?:todo|tbd|fixme)\b.{0,50}|.{0,30}\((?:platzhalter|placeholder)\)"
    r"|\[?(?:absatz|paragraph|abschnitt|text|textbaustein) \d+\]?|\[(?:grußformel|anrede|text|inhalt|betreff|titel|name|signatur|unterschrift)\]|(?:(?:asdf|qwertz?|jklö?|test|foo|bar|xxx+|abc)\b[\s.,]*)+|(?:x{3,}\s*)+|[-–—.·*_=~\s]{12,}|(?:überschrift|heading|untertitel|headline)",
    re.I,
)
#: Sentences that go with them but say nothing alone.
WEAK = re.compile(
    r"(?:bitte )?(?:versuchen|probieren) sie es .{0,60}|(?:please )?try again.{0,40}|(?:bitte )?(?:laden sie|danach|reload|refresh).{0,40}|(?:turn it on|enable it|allow them|ohne sie|without them|otherwise)\b.{0,60}|the page stays blank otherwise|.{0,20}bleibt diese seite leer"
    r"|(?:bitte )?(?:einstellungen|browser-?einstellungen) .{0,40}|change your browser settings.{0,30}|wir arbeiten .{0,50}|we are working .{0,40}|(?:go )?(?:back )?(?:to|zur) (?:the )?(?:start ?page|home ?page|startseite)\b.{0,40}|bitte melden sie sich erneut an|please (?:sign|log) in again.{0,20}"
    r"|(?:reference|referenz|anfrage-?id|request-?id|vorgangskennung|ray id|incident|kennung|support-id)\b[\s#:]*[\w.#-]+|(?:edge|nginx|apache|proxy|cache|iis|varnish)[-/ ][\w./-]+|(?:zur startseite|hilfe|impressum|kontakt|home|help|imprint)(?: \| [\w ]+)*|[\w.]+, line \d+|oops|sorry|entschuldigung|hinweis|fehler|error",
    re.I,
)
#: A line of few words that holds a status code or names scripts or cookies, in whatever language; counts only on repeated pages.
HEADLINE = re.compile(r"(?:\S+\s+){0,3}(?:[45]\d\d|HTTP(?:/[\d.]+)?\s[45]\d\d|java-?scripts?|cookies?|captcha)(?:\s+\S+){0,3}", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\s*\|\|\s*")
FUNCTION_WORDS = frozenset(
    "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden hat haben mit auf für von zu zum zur im in an am bei nach aus über unter vor seit ich wir sie er es ihr uns mich mir kann können bitte noch nur auch wie was wenn als dass so schon sehr "
    "the a an and or but not is are was were be has have had with on for from to of in at by after out over under since i we you he she it they us me can could please still only also how what when as that so very this there no yes "
    "le la les un une des et ou mais pas est sont avec sur pour de du au aux dans par il elle nous vous je ce cette que qui ne "
    "el los las una unos y o pero no es son con por para del en al se lo su que hay ya moin danke thanks hola bonjour hallo hi gruß ping test ok".split()
)
LATIN_STEMS = frozenset("lorem ipsum dolor sit amet consectetur".split())
VOWELS = re.compile(r"[aeiouyäöüéèàáíóú]", re.I)
CLUMP = re.compile(r"[^aeiouyäöüéèàáíóú\W\d_]{4,}|q(?!u)|[^\W\d_]*[jqxz][jqxzwvk]", re.I)


def _filler(text: str) -> bool:
    """Running words of no language: pseudo-Latin, or letters struck at random.

    Pseudo-Latin is told by what it has, not only by what it lacks, so that sentences of languages without a list of
    function words aren't taken for it: plain letters, no function word, and known stems or words that come again.
    """
    words = text.replace(".", " ").replace(",", " ").split()
    if not words or not all(w.isalpha() for w in words):
        return False
    lower = [w.lower() for w in words]
    stems = not LATIN_STEMS.isdisjoint(lower)
    functional = FUNCTION_WORDS.intersection(lower)
    if functional:
        return stems and len(words) >= 8 and len(functional) <= 1
    small = sum(w[0].islower() for w in words)
    if len(words) >= 6 and small >= 0.7 * len(words) and text.isascii() and (stems or len(set(lower)) < len(lower)) and not any(len(w) < 3 for w in lower):
        return True
    if len(words) >= 2 and lower[0] == "lorem" and "ipsum" in lower[1:2]:
        return True
    struck = sum(bool(CLUMP.search(w)) or not VOWELS.search(w) for w in words)
    return len(words) >= 2 and small == len(words) and (3 if len(words) >= 5 else 2) * struck >= len(words)


def page_verdict(lines: list[str]) -> str:
    """"strong": nothing but filler, error page or notice; "weak": only words that go with those; else ""."""
    strong = weak = 0
    for line in lines:
        if not line:
            continue
        if line[-1] == "?":
            return ""
        bare = line.strip(" .!:;*#=>-")
        if STRONG.fullmatch(bare) or STRONG.fullmatch(line):
            strong += 1
            continue
        for sentence in _SENTENCE.split(line):
            bare = sentence.strip(" .!:;*#=>-")
            if not bare:
                strong += len(sentence) > 11
            elif STRONG.fullmatch(bare):
                strong += 1
            elif WEAK.fullmatch(bare):
                weak += 1
            elif not (PLACEHOLDER.fullmatch(bare) or bare.isdigit()):
                return "strong" if _maybe_filler(line) and _filler(" ".join(x for x in lines if x and not STRONG.fullmatch(x))) else ""
    return "strong" if strong else "weak" if weak else ""


def headline_page(lines: list[str]) -> bool:
    """Several lines, the first a headline of an error page, none a question, a greeting or an announcement of something quoted."""
    kept = [line for line in lines if line]
    return len(kept) >= 2 and not any(line[-1] in "?,:" for line in kept) and HEADLINE.fullmatch(kept[0].strip(" .!:;*#=>-")) is not None


#: What may be a variable name without any marks around it.
BARE = re.compile(r"(?<![\w/\\.:@%$#{\[<«-])(?:[A-ZÄÖÜ]{2,}(?:[_.][A-ZÄÖÜ]+)+|[A-ZÄÖÜ]{6,}|[a-zäöü]+(?:_[a-zäöü]+)+)(?![\w/\\:@%$#}\]>»-]|\.\w)")
CAPITALS = re.compile(r"[A-ZÄÖÜ]{6}")
VARIABLE = re.compile(r"(?:name|datum|date|nummer|number|betreff|subject|anrede|salutation|placeholder|platzhalter)$|(?:^|[_.])(?:id|nr|no|link|url|titel|title|firma|company|kunde|customer|user|ticket|order|stadt|city|strasse|street)(?:[_.]|$)", re.I)
#: Where a value fell out of a sentence: white space doubled within it or left before a comma or full stop.
GAP = re.compile(r"(?<=[^\s.!?:;,|>*-])(?: {2,3}(?=[^\W\d_])| (?=[,.](?:\s|$)))")
TOKEN = re.compile(r"[^\W_]+(?:[-.@'/_][^\W_]+)*|[^\w\s]")
CONTEXT = 3
LONGEST_FILLER = 3
#: Size of the table of contexts that is sent to all tasks; it doesn't grow with the data.
CONTEXT_BITS = 1 << 20
#: Up to so many words before places are looked up first, only to pass over lines sooner.
ANCHORS = 20_000


def _tokens(text: str) -> list[str]:
    return ["0" if t[0].isdigit() else t for t in TOKEN.findall(text.lower())]


def _hash(tokens: list[str], seed: int = 0) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(tokens).encode("utf-8", "surrogatepass"), seed) >> 1


def open_places(sentence: str) -> list[tuple[int, int, str, str]]:
    """(left, context, last word before it, filler) of what may be an unfilled slot but only other records can tell: bare variable names and gaps.

    The context is a hash of three words on either side, left one of those before it.
    """
    found = []
    if "  " in sentence or " ," in sentence or " ." in sentence:
        found += [(m.start(), m.end(), "") for m in GAP.finditer(sentence)]
    if "_" in sentence or CAPITALS.search(sentence):
        found += [(m.start(), m.end(), m[0]) for m in BARE.finditer(sentence) if VARIABLE.search(m[0])]
    out = []
    for start, end, filler in found:
        left, right = ["^", *_tokens(sentence[:start])][-CONTEXT:], [*_tokens(sentence[end:]), "$"][:CONTEXT]
        if len(left) + len(right) >= 4:
            before = _hash(left)
            out.append((before, _hash(right, before), left[-1], filler))
    return out


def fillers(sentence: str, lefts: np.ndarray, contexts: np.ndarray) -> list[tuple[int, int]]:
    """(context, hash of the filler) of the sentence's words, one to three at a time, that stand in a known context."""
    tokens = ["^", *_tokens(sentence), "$"]
    out = []
    for i in range(1, len(tokens) - 1):
        left = tokens[max(0, i - CONTEXT) : i]
        before = _hash(left)
        if not lefts[before % CONTEXT_BITS]:
            continue
        for n in range(1, LONGEST_FILLER + 1):
            right = tokens[i + n : i + n + CONTEXT]
            if not right or len(left) + len(right) < 4:
                break
            context = _hash(right, before)
            if contexts[context % CONTEXT_BITS]:
                filler = sentence_filler(tokens[i : i + n])
                if filler is not None:
                    out.append((context, filler))
    return out


def sentence_filler(tokens: list[str]) -> int | None:
    text = " ".join(tokens)
    if not any(c.isalnum() for c in text) or VARIABLE.search(text) and "_" in text:
        return None
    return xxhash.xxh64_intdigest(text) >> 1


def slots(text: str) -> list[tuple[str, str, bool]]:
    """(skeleton, filler, mention) of everything in a line that looks like a placeholder."""
    found: list[tuple[str, str, bool]] = []
    if MARKS.search(text) is None:
        return found
    for sentence in _SENTENCE.split(text):
        if not MARKS.search(sentence):
            continue
        matches = [m for m in PLACEHOLDER.finditer(sentence) if _is_slot(m, sentence)]
        if not matches:
            continue
        rest = PLACEHOLDER.sub(" ", sentence)
        mention = MENTION.search(rest) is not None or ASKS.search(rest) is not None
        for m in matches:
            left = PLACEHOLDER.sub("⟨⟩", sentence[: m.start()]).lower().split()[-3:]
            right = PLACEHOLDER.sub("⟨⟩", sentence[m.end() :]).lower().split()[:3]
            found.append((re.sub(r"\d+", "0", f"{' '.join(left)}⟨⟩{' '.join(right)}"), m[0], mention))
    return found


def _is_slot(match: re.Match, sentence: str) -> bool:
    inner = match[0].strip("{}[]<>$#%*|@_«»()= ").strip()
    if not inner or inner.lower() in NOT_SLOTS:
        return False
    if DEFAULT.search(inner):
        return True
    if match["weak"] or match[0][0] in "$%{(_@" and match[0][1:2] not in "{%(":
        if match[0][0] in "[<" and re.match(r"[^\W\d_]*\s*\w*@|\S*(?:at|dot)\]", sentence[match.start() + 1 :], re.I):
            return False
        return IDENTIFIER.fullmatch(inner) is not None
    return True


SIGNALS = "struct<page: string, shape: string, unfilled: boolean, places: array<struct<before: long, context: long, anchor: string, filler: string>>, lines: array<string>>"
_ARROW = pa.struct([("page", pa.string()), ("shape", pa.string()), ("unfilled", pa.bool_()), ("places", pa.list_(pa.struct([("before", pa.int64()), ("context", pa.int64()), ("anchor", pa.string()), ("filler", pa.string())]))), ("lines", pa.list_(pa.string()))])


def _maybe_filler(line: str) -> bool:
    """Whether a line may be part of filler: all its words are letters, and at most one is a function word."""
    words = line.replace(".", " ").replace(",", " ").split()
    return all(w.isalpha() for w in words) and len(FUNCTION_WORDS.intersection(w.lower() for w in words)) <= 1


SALUTATIONS = ("Sehr geehrte/r,", "Sehr geehrte/r ,", "Dear ,", "Hallo ,", "Guten Tag ,", "Hello !", "Hello ,")


def _mentions(sentence: str) -> bool:
    rest = PLACEHOLDER.sub(" ", sentence)
    return MENTION.search(rest) is not None or ASKS.search(rest) is not None


def signals(text: str, content_type: str | None, title: bool) -> dict | None:
    if title:
        lines = [TITLE_PREFIX.sub("", text.strip(), count=1).strip()]
    else:
        lines = [line for line in new_lines(text, content_type)[0] if line]
        if not lines:  # a page may read like a notice
            lines = own_lines(text, content_type)
    if not any(lines):
        return None
    page = page_verdict(lines)
    if not page and not title and headline_page(lines):
        page = "weak"
    unfilled = any(not mention for line in lines if MARK_SIGNS.search(line) for _, _, mention in slots(line)) or not title and lines[0].rstrip() in SALUTATIONS
    shape = str(xxhash.xxh64_intdigest(re.sub(r"\d+", "0", " ".join(lines)).lower().encode("utf-8", "surrogatepass"))) if page == "weak" else None
    places = []
    if not unfilled and page != "strong":
        bare = "_" in text or CAPITALS.search(text) is not None
        for line in lines:
            if "  " in line or " ," in line or " ." in line or bare and ("_" in line or CAPITALS.search(line)):
                for sentence in _SENTENCE.split(line):
                    open_here = open_places(sentence)
                    if open_here and not _mentions(sentence):
                        places += open_here
    return {"page": page, "shape": shape, "unfilled": unfilled, "places": [{"before": b, "context": k, "anchor": a, "filler": f} for b, k, a, f in places], "lines": lines}


def with_signals(df: DataFrame, text: str, kind: str | None = None, title: bool = False, out: str = "signals") -> DataFrame:
    """Adds what a text shows by itself, and its own lines; null for null and blank texts. Other columns pass through."""

    @F.arrow_udf(SIGNALS)
    def look(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([None if not t or t.isspace() else signals(t, k, title) for t, k in zip(texts.to_pylist(), kinds.to_pylist())], type=_ARROW)

    return df.withColumn(out, look(df[text], df[kind] if kind else F.lit(None).cast("string")))


def induced(seen: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of records with an open place that other records fill: the same words around it, and at least two values in it.

    What goes to all tasks are two tables of ``CONTEXT_BITS`` bits that say which contexts may be asked for; the exact
    contexts are then joined. Values are told apart by the least and the greatest of their hashes, so no list of them is kept,
    and repeating records changes nothing.
    """
    asked = seen.select(*keys, F.explode("places").alias("p")).select(*keys, "p.*")
    tables = []
    for column in ("before", "context"):
        bits = [r[0] for r in asked.select(F.pmod(column, F.lit(CONTEXT_BITS)).cast("int")).distinct().collect()]  # at most CONTEXT_BITS
        if not bits:
            return seen.select(*keys).limit(0)
        table = np.zeros(CONTEXT_BITS, dtype=bool)
        table[bits] = True
        tables.append(np.packbits(table))
    anchors = [r[0] for r in asked.select("anchor").distinct().limit(ANCHORS + 1).collect()]
    anchored = len(anchors) <= ANCHORS and not {"0", "^"}.intersection(anchors)  # digits and beginnings of lines are no words to look up
    known = seen.sparkSession.sparkContext.broadcast((tables, anchors if anchored else None))

    @F.arrow_udf("array<struct<context: long, value: long>>")
    def fill(lists: pa.Array) -> pa.Array:
        lefts, contexts = (np.unpackbits(t).astype(bool) for t in known.value[0])
        words = None
        if known.value[1] is not None:
            words = ahocorasick.Automaton()
            for anchor in known.value[1]:
                words.add_word(anchor, True)
            words.make_automaton()
        rows = []
        for lines in lists.to_pylist():
            found: list[dict] = []
            for line in lines or ():
                if words is not None and next(words.iter(line.lower()), None) is None:
                    continue
                found += [{"context": k, "value": v} for sentence in _SENTENCE.split(line) for k, v in fillers(sentence, lefts, contexts)]
            rows.append(found)
        return pa.array(rows, type=pa.list_(pa.struct([("context", pa.int64()), ("value", pa.int64())])))

    values = seen.select(F.explode(fill(F.col("lines"))).alias("v")).groupBy("v.context").agg(F.min("v.value").alias("a"), F.max("v.value").alias("b"))
    return asked.join(values.where("a <> b"), "context", "left_semi").select(*keys)


def residue(records: DataFrame, keys: list[str], column: str = "signals", least_repeats: int = 3) -> DataFrame:
    """The distinct keys of records that are template residue, filler or error pages.

    ``records`` has the signals of every record. A placeholder in marks is an unfilled slot, however often it occurs,
    unless its own sentence speaks of templates or asks about it. A bare variable name or a gap is one if the
    records align: if others have at least two values between the same words. Pages with only weak words count if their
    whole shape is repeated. Records without signals never come out; an empty table gives no rows.
    """
    seen = stored(records.where(F.col(column).isNotNull()).select(*keys, f"{column}.*"))
    sure = seen.where("page = 'strong' OR unfilled").select(*keys)
    weak = seen.where("page = 'weak'")
    repeated = weak.select(*keys, "shape").distinct().groupBy("shape").agg(F.count("*").alias("n")).where(F.col("n") >= least_repeats).select("shape")
    pages = weak.join(repeated, "shape", "left_semi").select(*keys)
    return sure.unionByName(pages).unionByName(induced(seen, keys)).distinct()
