"""The text of a mail that its sender newly wrote, without history, signature and notices.

A message's own reference headers (introductions such as "On ..., X wrote:" and blocks of From/Sent/To/Subject lines)
give ancestors that are nested in it; prefixes and markup give their extent. What follows the last own words is
recognised as signature, device note or legal notice. What is left is compared with the earlier messages of the same
thread: rolling-hash shingles of lines find common spans, aligned line by line with one ancestor, and long ones go.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.visible import LOOKS_HTML, NOTICE, QUOTE, SIGNATURE, html_lines, plain_lines

PREFIX = re.compile(r"\s*[>|]")
CONSOLE = re.compile(r"\s*>\s*(?:(?:ping|tracert|traceroute|nslookup|ipconfig|ifconfig|curl|wget|ssh|telnet|net use|dir|route)\b.*|Zeitüberschreitung .*|Request timed out.*|\d+ hops\b.*|Antwort von .*|Reply from .*|)$", re.I)
INTRO_START = re.compile(r"(?:Am|On|Le|El|Dnia|Dne|Il|W dniu|Op|Den|Em|Пн|Вт|Ср|Чт|Пт|Сб|Вс|В)\s.{0,60}\d|.{2,140}(?:schrieb am|wrote on|a écrit le|escribió el)\b|.{2,90}<$|.{2,140}(?:schrieb|wrote|a écrit|escribió)(?: am| on| le| el)?$", re.I)
INTRO = re.compile(
    r"(?:Am|On|Le|El)\s.{4,200}?(?:schrieb|geschrieben|wrote|a écrit|escribió).{0,140}?:$"
    r"|(?:Dnia|W dniu|Dne|Il|Op|Den|Em|Пн|Вт|Ср|Чт|Пт|Сб|Вс|В)\s.{4,200}?(?:napisał|pisze|napsal|ha scritto|schreef|skrev|escreveu|написал|пишет).{0,140}?:$"
    r"|.{2,160}?(?:schrieb am|wrote on|a écrit le|escribió el)\s.{4,40}?:$",
    re.I,
)
BANNER = re.compile(r"-{3,}\s*(?:Ursprüngliche Nachricht|Original[ -]Message|Original[ -]?Nachricht|Weitergeleitete Nachricht|Forwarded [Mm]essage|Message d'origine|Message transféré|Mensaje (?:original|reenviado))\s*-{3,}$", re.I)
HEADER = re.compile(r"(Von|From|De|Gesendet|Sent|Enviado(?: el)?|Envoyé|An|To|Para|À|Cc|Kopie|Datum|Date|Fecha|Betreff|Subject|Asunto|Objet)\s?:(?:\s|$)", re.I)
SEPARATOR = re.compile(r"(?:[-–—_*=~#]{2,}|—|–)\s*$")
POSTSCRIPT = re.compile(r"P\.? ?(?:P\.? ?)?S\b\.?:?\s|P\.? ?S\.?:|Nachtrag\s?:|NB\s?[:.]\s", re.I)
NAME_WORD = r"(?:[A-ZÀ-ÖØ-ÞĀ-Ž][\w'’.-]*|(?:van|von|vom|zu|zum|de|der|den|del|la|le|al|el|ten|ter|y)\b|al-\w+|O'\w+)"
TITLE = r"(?:(?:Dr|Prof|Dipl\.-\w+|Mag|Ing|Hr|Fr|Mr|Mrs|Ms)\.?\s|i\. ?[AV]\.\s?|ppa\.\s?|p\. ?p\.\s?)"
NAME = re.compile(rf"{TITLE}*{NAME_WORD}(?:,? {NAME_WORD}){{0,4}}$")
WORDS = (
    r"m(?:it|ti) (?:den )?(?:freundlich|best|lieb|herzlich|kolleg|schön|viel|sonnig)\w* Gr(?:u|ü|ue)(?:ß|ss)\w*"
    r"|(?:viele|beste|liebe|schöne|herzliche|freundliche|sonnige|kollegiale|winterliche) Gr(?:ü|ue)(?:ß|ss)e"
    r"|(?:vielen )?Dank(?:e)?(?: und|,| &)? (?:viele |beste |liebe |schöne )?Gr(?:u|ü|ue)(?:ß|ss)e?|Gr(?:u|ü|ue)(?:ß|ss)e?|MfG|LG|VG|BG|\bBR\b|\bThx\b|mit Dank"
    r"|hochachtungsvoll|(?:best|kind|warm|many|kindest|warmest) regards|regards|best wishes|all the best|many thanks and best wishes|best"
    r"|cheers|sincerely(?: yours)?|yours (?:sincerely|faithfully|truly)|thanks and regards|many thanks"
    r"|(?:bien )?cordialement|salutations(?: distinguées)?|bien à (?:vous|toi)|meilleures salutations|sincères salutations"
    r"|(?:un )?(?:cordial )?saludos?(?: cordiales)?|atentamente|un abrazo"
)
CLOSING = re.compile(rf"(?:{WORDS})(?:\s+aus\s+(?:dem |der )?[\w.\- ]{{2,30}}?)?\s*(?:[,.!–-]?\s*$|[,.!–-]?\s+(?={TITLE}*{NAME_WORD}(?:,? {NAME_WORD}){{0,4}}$))", re.I)
INLINE_CLOSING = re.compile(rf"(?<=[\w.!?)\]…\"”“\U0001F300-\U0001FAFF️\U0001F3FB-\U0001F3FF])\s+(?:(?:Danke|Thanks|Merci|Gracias),? )?(?:LG|VG|MfG|BG|BR|Thx|Gruß|Grüße|Viele Grüße|Cheers|Regards|Best regards|Best,|Cordialement,?|Saludos,?),? (?-i:{TITLE}*{NAME_WORD}(?: {NAME_WORD}){{0,3}})\s*$", re.I)
DEVICE = re.compile(
    r"(?:gesendet (?:mit|von|über)\b|von (?:meinem|unterwegs)\b.{0,40}(?:gesendet|getippt)|kurz gehalten\b|sent (?:from|with|via|using)\b|typed on\b|envoyé (?:depuis|de mon|avec)\b|enviado (?:desde|con)\b"
    r"|diese (?:nachricht|e-mail) wurde (?:von|mit|unterwegs)\b|get (?:\w+ )for (?:ios|android))",
    re.I,
)
LEGAL = re.compile(
    r"vertraulich\s?:|\bconfidential\b|confidentiality (?:notice|note|statement|clause)|confidentiel|hinweise? zum datenschutz|datenschutzhinweis|nur für den (?:genannten )?empfänger|irrtümlich|e-mails? binden uns|schriftlicher bestätigung"
    r"|sitz der (?:firma|gesellschaft)|registergericht|amtsgericht|\bHRB \d|\bUSt-|geschäftsführer|registered (?:in|office)|company no\b|not binding until|accept no liability|no liability for"
    r"|(?:diese|dieser) (?:nachricht|e-?mail) (?:ist|kann|enthält (?!inhalte,? die nur mit)|und ihre anhänge)|meant for the addressee|got it by mistake|(?:content and any )?enclosures may not"
    r"|denken sie an die umwelt|bevor sie diese (?:seite|e-?mail|nachricht) drucken|think (?:twice )?before (?:you )?print|before printing this|avant d'imprimer|antes de imprimir"
    r"|(?:e-?mail|nachricht|message) kam von (?:außerhalb|extern)|came from outside|öffnen sie anhänge nur|external (?:sender|e-?mail)|ce message est destiné|en cas d'erreur|este mensaje (?:es|va|está)|aviso legal|haftung\b|im auftrag unserer geschäftsleitung",
    re.I,
)
CONTACT = re.compile(r"(?:\d[\d\s()/.\-–+]{4,}\d|@|\(at\)|\[at\]|\bAT\b|www\.|https?://|✉|☎|\b(?:Tel|Fax|Fon|Mobil|Telefon|Phone|Mail|E-Mail|Tél|Direct|Durchwahl)\b|\b(?:GmbH|AG|KG|eG|Ltd|Inc|SE|SA|SARL|OHG)\b|^\| \|$)", re.I)
SENTENCE = re.compile(r".*[.!?…:;,]$|.{70,}|[-*•]\s|\[?\d|.*[=<>{}\\]|\s*at \w+\.")
#: Lines of a signature that begin with a number: house number and street, "2nd level".
NUMBERED = re.compile(r"\d{1,4}(?:\s?(?:bis|ter|[a-z]))?,?\s(?:[^\W\d_][\w.'’-]*,?(?:\s|$)){1,6}(?:\d{4,5}\s[\w. -]+|\d{0,3}[A-Z]?)$|\d(?:st|nd|rd|th)[- ][\w -]+$", re.I)
#: Lines of a signature that end in an abbreviation of a firm or street.
ABBREVIATED = re.compile(r"[^.!?]{2,60}(?:\.[^.!?]{1,20}){0,2}(?<=\b)(?:S\.L\.|S\.A\.|izq\.|dcha\.|St\.|Rd\.|Ave\.|Blvd\.|Str\.|Inc\.|Ltd\.|Co\.)$")
#: How a line ends after which a name may stand without a blank line between.
ENDED = re.compile(r"[.!?…)\U0001F300-\U0001FAFF\u2600-\u27BF\uFE0F]$")
ALNUM = re.compile(r"[\W_]+")

OWN, OTHER = True, False

#: Words without which the patterns above can't match, found in one pass over a text: 1 introductions, 2 header blocks, 4 notices.
CUES = {
    1: ["schrieb", "wrote", "écrit", "escribió", "napisał", "pisze", "napsal", "scritto", "schreef", "skrev", "escreveu", "написал", "пишет"],
    2: ["von:", "from:", "de:", "de :", "gesendet:", "sent:", "betreff:", "subject:", "asunto:", "objet:", "objet :", "nachricht-", "message-", "message -", "nachricht -", "d'origine", "transféré", "original -", "reenviado -"],
    4: [
        "vertraulich", "confiden", "zum datenschutz", "datenschutzhinweis", "empfänger", "irrtümlich", "binden uns", "schriftlicher bestätigung", "sitz der", "registergericht", "amtsgericht", "hrb ",
        "ust-", "geschäftsführ", "registered", "company no", "not binding", "liability", "diese nachricht", "dieser nachricht", "diese e-mail", "diese email", "dieser e-mail", "addressee",
        "by mistake", "enclosures", "umwelt", "seite drucken", "mail drucken", "nachricht drucken", "before print", "before you print", "printing this", "d'imprimer", "de imprimir", "außerhalb", "von extern",
        "external", "from outside", "öffnen sie anhänge", "est destiné", "cas d'erreur", "este mensaje", "aviso legal", "haftung", "im auftrag unserer",
    ],
}


def _cues() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for bit, words in CUES.items():
        for word in words:
            built.add_word(word, bit)
    built.make_automaton()
    return built


_CUES = _cues()


def cues(text: str) -> int:
    found = 0
    for _, bit in _CUES.iter(text.lower()):
        found |= bit
        if found == 7:
            break
    return found


def _header_block(lines: list[tuple[str, str]], at: int) -> int:
    """The line after a block of mail header lines that starts here, or ``at`` if none does."""
    keys, i, last, blanks = set(), at, at, 0
    while i < len(lines) and i - last < 3:
        line = lines[i][0]
        match = HEADER.match(line)
        if match:
            keys.add(match[1].lower())
            last = i + 1
            blanks = 0
        elif not line:
            blanks += 1
            if blanks > 1 and keys:
                break
        elif i == at or blanks:
            break
        i += 1
    return last if len(keys) >= 2 else at


def _intro_end(lines: list[tuple[str, str]], at: int) -> int:
    """The line after an introduction that starts here and may be wrapped, or ``at``."""
    text = lines[at][0]
    if len(text) > 220 or not INTRO_START.match(text):
        return at
    joined, i = "", at
    for _ in range(3):
        while i < len(lines) and not lines[i][0]:
            if i > at + 3:
                return at
            i += 1
        if i >= len(lines):
            return at
        joined = f"{joined} {lines[i][0]}".strip()
        i += 1
        if joined.endswith(":"):
            return i if len(joined) <= 320 and INTRO.match(joined) and any(c.isdigit() for c in joined) else at
    return at


def _next_text(lines: list[tuple[str, str]], at: int) -> int:
    while at < len(lines) and not lines[at][0]:
        at += 1
    return at


def _mark_history(lines: list[tuple[str, str]], found: int) -> list[bool]:
    """For each line, whether it is the sender's own (else earlier or forwarded messages and what introduces them)."""
    n = len(lines)
    own = [role != QUOTE for _, role in lines]
    i = 0
    while i < n:
        line, role = lines[i]
        if role == QUOTE or not line:
            i += 1
            continue
        first = line[0]
        if first in ">|" and line != "| |":
            end = i
            while end < n and lines[end][1] != QUOTE and lines[end][0] and PREFIX.match(lines[end][0]):
                end += 1
            if not all(CONSOLE.match(lines[k][0]) for k in range(i, end)):
                for k in range(i, end):
                    own[k] = OTHER
            i = end
            continue
        end = i
        if first in "-_" and (BANNER.match(line) or SEPARATOR.match(line)):
            start = _next_text(lines, i + 1)
            if start < n and lines[start][1] != QUOTE:
                block = _header_block(lines, start)
                if block > start:
                    end = block
                elif BANNER.match(line):
                    end = i + 1
            elif BANNER.match(line):
                end = i + 1
        elif found & 2 and HEADER.match(line):
            end = _header_block(lines, i)
        if end == i and found & 1:
            end = _intro_end(lines, i)
        if end > i:
            for k in range(i, end):
                own[k] = OTHER
            start = _next_text(lines, end)
            if start < n and lines[start][1] != QUOTE and not PREFIX.match(lines[start][0]):
                for k in range(start, n):  # an unmarked message goes on to the end
                    own[k] = OTHER
                return own
            i = end
            continue
        i += 1
    return own


def _is_name(line: str) -> bool:
    return len(line) <= 45 and NAME.match(line) is not None


def _tail_follows(rest: list[str]) -> bool:
    """Whether only contact lines, short lines, notices and separators follow."""
    for line in rest:
        if line and not (CONTACT.search(line) or DEVICE.match(line) or LEGAL.search(line) or SEPARATOR.match(line) or POSTSCRIPT.match(line) or not SENTENCE.match(line) or NUMBERED.match(line) or ABBREVIATED.match(line)):
            return False
    return True


def _strip_own(block: list[str], first_block: bool, out: list[str], found: int) -> bool:
    """Adds the newly written lines of one stretch of own lines; tells whether any line was left out."""
    left_out = False
    signature = False
    notice = False
    postscript = False
    seen_text = not first_block
    for i, line in enumerate(block):
        if not line:
            notice = postscript = False
            continue
        if line[0] in "PpNn" and POSTSCRIPT.match(line):
            signature, postscript = False, True
            out.append(line)
            continue
        if postscript and not LEGAL.search(line) and not SEPARATOR.match(line):
            out.append(line)
            continue
        if signature or notice:
            left_out = True
            continue
        if found & 4 and line[:2] not in ("- ", "* ") and cues(line) & 4 and LEGAL.search(line):
            notice = left_out = True
            continue
        if len(line) <= 90 and (CLOSING.match(line) or DEVICE.match(line)):
            signature = left_out = True
            continue
        if SEPARATOR.match(line):
            after = next((x for x in block[i + 1 :] if x), "")
            if after and (_is_name(after) or CLOSING.match(after) or DEVICE.match(after) or CONTACT.search(after) and len(after) < 60):
                signature = True
            continue
        alone = i == 0 or not block[i - 1] or line[-1] != "." and ENDED.search(block[i - 1]) is not None and not any(block[i + 1 :])
        if seen_text and alone and _is_name(line) and _tail_follows(block[i + 1 :]):
            signature = left_out = True
            continue
        inline = INLINE_CLOSING.search(line, max(0, len(line) - 70)) if line[-1].isalpha() else None
        if inline:
            out.append(line[: inline.start()])
            signature = left_out = True
            continue
        seen_text = True
        out.append(line)
    return left_out


def new_lines(text: str, content_type: str | None = None) -> tuple[list[str], bool]:
    """The newly written lines of one message, and whether it holds any other text."""
    html = content_type == "text/html" or content_type != "text/plain" and LOOKS_HTML.search(text) is not None
    lines = html_lines(text) if html else plain_lines(text)
    found = cues("\n".join([line for line, _ in lines])) if html else cues(text)
    own = _mark_history(lines, found)
    out: list[str] = []
    other = False
    block: list[str] = []
    first = True
    for (line, role), mine in zip(lines, own):
        if mine and role not in (SIGNATURE, NOTICE):
            block.append(line)
            continue
        if not line:
            block.append("")
            continue
        if any(block):
            other |= _strip_own(block, first, out, found)
            first = False
        block = []
        if role in (SIGNATURE, NOTICE) and mine and POSTSCRIPT.match(line):
            out.append(line)
        elif ALNUM.sub("", line):
            other = True
            first = False
    if any(block):
        other |= _strip_own(block, first, out, found)
    return out, other


def own_lines(text: str, content_type: str | None = None) -> list[str]:
    """The lines of one message that aren't history, signature and notices included."""
    html = content_type == "text/html" or content_type != "text/plain" and LOOKS_HTML.search(text) is not None
    lines = html_lines(text) if html else plain_lines(text)
    return [line for (line, _), mine in zip(lines, _mark_history(lines, cues("\n".join([line for line, _ in lines])))) if mine and line]


BODY_BREAK = re.compile(r"(?:\r\n|\n)---(?:\r\n|\n)")


def new_lines_of_ticket(content: str) -> tuple[list[str], bool]:
    """The same for the content of a ticket: its title line and its articles, set apart by lines of three dashes.

    The articles are a thread of their own: each is compared with those before it as stored articles are.
    """
    title, *bodies = BODY_BREAK.split(content)
    found = [new_lines(body) for body in bodies]
    gone = inherited_within([lines for lines, _ in found]) if len(found) > 1 else [[] for _ in found]
    out, other = [title.strip()], False
    for (lines, more), numbers in zip(found, gone):
        dropped = set(numbers)
        out += [line for n, line in enumerate(lines) if n not in dropped] if dropped else lines
        other |= more or bool(dropped)
    return out, other


def letters_md5(lines: list[str]) -> str:
    return hashlib.md5(ALNUM.sub("", "".join(lines)).encode("utf-8", "surrogatepass")).hexdigest()


#: An inherited span has at least so many letters and digits, on at least two lines; single sentences come again by chance.
INHERITED_LETTERS = 200
_BASE = 1_000_003
_MASK = (1 << 63) - 1


def shingles(lines: list[str]) -> list[dict]:
    """Every two neighbouring lines with text as one rolling hash: (n, h, letters), n the index of the first."""
    hashed = []
    for n, line in enumerate(lines):
        if line:
            bare = ALNUM.sub("", line).lower()
            if bare:
                hashed.append((n, xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")), len(bare)))
    return [{"n": a[0], "next": b[0], "h": (a[1] * _BASE + b[1]) & _MASK, "letters": a[2], "last": b[2]} for a, b in zip(hashed, hashed[1:])]


def inherited(matches: list[dict], least: int = INHERITED_LETTERS) -> list[int]:
    """The indexes of lines in spans that run, line by line, along one ancestor and are long enough.

    ``matches`` are shingles with the ancestor and the index there at which each stands.
    """
    out: list[int] = []
    span: list[dict] = []

    def close() -> None:
        if span and sum(m["letters"] for m in span) + span[-1]["last"] >= least:
            out.extend([m["n"] for m in span] + [span[-1]["next"]])
        span.clear()

    for m in sorted(matches, key=lambda m: m["n"]):
        if span and not (m["n"] == span[-1]["next"] and m["ancestor"] == span[-1]["ancestor"] and m["at"] == span[-1]["at_next"]):
            close()
        span.append(m)
    close()
    return sorted(set(out))


def inherited_within(messages: list[list[str]]) -> list[list[int]]:
    """For each message of a thread, in order, the indexes of its lines that run along an earlier one.

    As in ``without_inherited``, a shingle stands for its first place in the thread.
    """
    first: dict[int, dict] = {}
    out: list[list[int]] = []
    for place, lines in enumerate(messages):
        own = shingles(lines)
        out.append(inherited([s | first[s["h"]] for s in own if s["h"] in first]))
        for s in own:
            first.setdefault(s["h"], {"ancestor": place, "at": s["n"], "at_next": s["next"]})
    return out


_SHINGLE = pa.struct([("n", pa.int32()), ("next", pa.int32()), ("h", pa.int64()), ("letters", pa.int32()), ("last", pa.int32())])
RESULT = pa.struct([("text", pa.string()), ("md5", pa.string()), ("other", pa.bool_()), ("shingles", pa.list_(_SHINGLE))])
RESULT_DDL = "struct<text: string, md5: string, other: boolean, shingles: array<struct<n: int, next: int, h: long, letters: int, last: int>>>"


def newly_written(df: DataFrame, text: str, kind: str | None = None, assembled: bool = False, out: str = "new") -> DataFrame:
    """Adds a struct (text, md5, other, shingles): the newly written lines, the MD5 of their letters and digits, whether
    other text was left out, and what the lines are compared by.

    ``kind`` names a column with the content type; where that is null or there is none, markup decides. ``assembled``
    reads the text as a ticket's content (title line, then articles). A null text gives a null struct, a blank one
    empty text. Other columns pass through; one named ``out`` is replaced. Texts are read whole.
    """

    @F.arrow_udf(RESULT_DDL)
    def strip(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        rows = []
        for value, content_type in zip(texts.to_pylist(), kinds.to_pylist()):
            if value is None:
                rows.append(None)
                continue
            lines, other = new_lines_of_ticket(value) if assembled else new_lines(value, content_type)
            rows.append({"text": "\n".join(lines), "md5": letters_md5(lines), "other": other, "shingles": [] if assembled else shingles(lines)})
        return pa.array(rows, type=RESULT)

    return df.withColumn(out, strip(df[text], df[kind] if kind else F.lit(None).cast("string")))


def without_inherited(found: DataFrame, key: str, thread: str, position: str) -> DataFrame:
    """(key, text, md5, other) of rows (key, thread, position, text, md5, other, shingles), without spans of earlier messages.

    Of each shingle of a thread only its first place is kept, counted before the shuffle, so a line that a third of all
    messages share makes no pairs. Rows without thread or position have no ancestors. A message's matches are one group.
    """
    each = found.where(F.col(thread).isNotNull() & F.col(position).isNotNull() & (F.size("shingles") > 0))
    each = each.select(key, thread, position, F.explode("shingles").alias("s")).select(key, thread, position, "s.*")
    first = each.groupBy(thread, "h").agg(F.min(F.struct(position, F.col(key).alias("ancestor"), F.col("n").alias("at"), F.col("next").alias("at_next"))).alias("f"))
    common = each.join(first, [thread, "h"]).where(F.col(f"f.{position}") < F.col(position)).distinct()
    match = F.struct("n", "next", "letters", "last", F.col("f.ancestor").cast("string").alias("ancestor"), "f.at", "f.at_next")

    @F.arrow_udf("array<int>")
    def align(lists: pa.Array) -> pa.Array:
        return pa.array([inherited(m or []) for m in lists.to_pylist()], type=pa.list_(pa.int32()))

    spans = common.groupBy(key).agg(F.collect_list(match).alias("m")).select(key, align(F.col("m")).alias("gone")).where(F.size("gone") > 0)

    @F.arrow_udf("struct<text: string, md5: string>")
    def drop(texts: pa.Array, gone: pa.Array) -> pa.Array:
        rows = []
        for text, numbers in zip(texts.to_pylist(), gone.to_pylist()):
            lines = [line for n, line in enumerate(text.split("\n")) if n not in set(numbers)] if numbers else []
            rows.append({"text": "\n".join(lines), "md5": letters_md5(lines)} if numbers else None)
        return pa.array(rows, type=pa.struct([("text", pa.string()), ("md5", pa.string())]))

    changed = found.join(spans, key).select(key, drop(F.col("text"), F.col("gone")).alias("d")).select(key, "d.text", "d.md5", F.lit(True).alias("other"))
    return found.join(spans, key, "left_anti").select(key, "text", "md5", "other").unionByName(changed)
