"""Sentence units by character-property break rules, with abbreviations suppressed.

Lines are grouped first: list items, log and table lines, chat messages and short lines stand alone, wrapped prose is
read on over its line ends. In prose a terminator ends a sentence by what follows it (white space, case, script), as in
Unicode's sentence-break rules, unless it closes an abbreviation, an ordinal or an initial or lies in a quotation or
bracket. Thai has no terminators: white space between two Thai letters ends a phrase there.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"[^\r\n\x0b\x0c\x85\u2028\u2029]+")
ITEM = re.compile(r"\s*(?:[-*•–—‣◦·▪]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+\S")
LOG = re.compile(
    r"\s*(?:\x1b\[|\[?\d{4}-\d\d-\d\d[T ]\d\d:|\[\d\d:\d\d|(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b|Reply from |Antwort von |at [\w.$<>]+\(|File \"|Traceback |\S+\.exe\[|(?:SELECT|INSERT|UPDATE|DELETE)\s.*;|[$#>] ?\w+ |<\||\S+=\S+(?: \S+=\S+)+$)"
    r"|[^|]*\|[^|]*\||[^\t]*\S\t+\S",
)
#: Quotations and brackets, each within one sentence.
INSIDE = re.compile(r"„[^„“”]{1,300}[“”]|«[^«»]{1,300}»|»[^«»]{1,300}«|“[^“”]{1,300}”|\"[^\"]{1,300}\"|「[^」]{1,300}」|『[^』]{1,300}』|\([^()]{1,300}\)|（[^）]{1,300}）|\[[^\[\]]{1,300}\]")
END = re.compile(r"[.!?…。！？｡．؟।॥።։;\u037e]+(?:\s(?=[!?])[!?]+)?")
CLOSERS = "”“\"'»«›‹’‘』」）)]}】》"
OPENERS = "„“\"'»«›‹‚‘「『（([{¿¡【《"
ALWAYS = frozenset("。！？｡؟।॥።։")
#: Abbreviations that need something after them; compared in lower case, without the last full stop.
BOUND = frozenset(
    "dr prof dipl dipl.-ing ing mag hr fr frl nr nrn no num núm abt abb abschn abs art anl bd kap ref rev bldg dept sec fig figs pp vol ch vgl s z d u i v m evtl ggf bzw ca zzgl inkl exkl einschl ausschl insb sog bes bspw vorauss mind max lt lfd allg gem str tel fa hs st sta sto ste mt ft vs e.g i.e eg ie viz esp approx incl excl cf resp "
    "env c.-à-d p.ex p tél mme mlle aprox ee pág ud uds sr sra srta dra np tzw tzn ok zob komp ul im inż mgr poč např č tj περ π.χ κ κα βλ د أ डॉ श्री mr mrs ms messrs gen capt hon z.b d.h u.u m.e i.d i.a v.a bl wg "
    "jan feb mär apr jun jul aug sep sept okt oct nov dez dec".split()
)
#: Words before which a number with a full stop is an ordinal.
ORDINAL = frozenset("im am der die das den dem des vom zum zur beim ab bis seit jeden jedem jeder und oder vor nach in ins ve v na do od dne dnia w z ke".split())
MONTH = re.compile(r"(?:januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jan|feb|mär|apr|jun|jul|aug|sep|okt|nov|dez)\b", re.I)
#: Words whose following letter is a designation, which may end a sentence.
DESIGNATED = frozenset("rev raum halle typ laufwerk drive room hall type gate bldg gebäude block zone level klasse".split())
THAI_GAP = re.compile(r"(?<=[\u0e01-\u0e4e])\s+(?=[\u0e01-\u0e4e])")
WORD = re.compile(r"\S+$")


def _symbol(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk", "Cf", "Mn") and c not in "#" or "\U0001f3fb" <= c <= "\U0001f3ff" or c == "\ufe0f"


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _abbreviated(text: str, at: int, start: int, after: str) -> bool:
    """Whether the full stop at ``at`` belongs to an abbreviation, ordinal or initial that goes on with ``after``."""
    word = WORD.search(text, max(start, at - 40), at)
    if word is None:
        return False
    token = word[0].lstrip(OPENERS + "-–")
    if not token:
        return False
    lower = token.lower()
    before = WORD.search(text[max(start, word.start() - 24) : word.start()].rstrip())
    last = before[0].lower().strip(".,;:(") if before else ""
    if token.isdigit():
        return len(token) <= 2 and (last in ORDINAL or MONTH.match(after) is not None)
    if lower in BOUND or lower.rsplit("/", 1)[-1] in BOUND:
        return True
    if len(token) == 1 and token.isalpha() and token.isupper():
        return last not in DESIGNATED and unicodedata.name(token, "").startswith(("LATIN", "GREEK", "CYRILLIC"))
    return False


def _breaks(text: str, start: int, end: int) -> list[int]:
    """Where sentences after the first begin in running prose."""
    inside = [m.span() for m in INSIDE.finditer(text, start, end)]
    found: list[int] = []
    k = 0
    for match in END.finditer(text, start, end):
        run, at, i = match[0], match.start(), match.end()
        while k < len(inside) and inside[k][1] <= at:
            k += 1
        quoted = k < len(inside) and inside[k][0] < at
        if quoted:
            if i < inside[k][1] - 1:
                continue
            i = inside[k][1]
        if ";" in run or "\u037e" in run:
            if run.strip(";\u037e") == "" and not (at > start and "\u0370" <= text[at - 1] <= "\u03ff" or at > start and "\u1f00" <= text[at - 1] <= "\u1fff"):
                continue
        while i < end and text[i] in CLOSERS and not (text[i] in OPENERS and i + 1 < end and text[i + 1].isalnum() and text[i] != "“" and not quoted and text[i - 1] not in ".!?…"):
            i += 1
        j = i
        while j < end and (text[j].isspace() or _symbol(text[j]) and text[j] not in OPENERS):
            j += 1
        if j >= end:
            continue
        gap = j > i
        first = j
        while first < end and text[first] in OPENERS:
            first += 1
        c = text[first] if first < end else ""
        opened = text[j] in "¿¡"
        if not c or not c.isalnum() and not opened:
            if not (gap and c and run[0] != "." and not c in ",;:.!?)"):
                continue
        starts = opened or c.isupper() or c.isalpha() and not _cased(c) or c.islower() and first + 1 < end and text[first + 1].isupper() or not c.isalnum()
        always = run[0] in ALWAYS or run[-1] in ALWAYS
        if quoted:
            if not (gap and (opened or c.isupper())) or text[inside[k][0]] in "「『（":
                continue
        elif always:
            if c.islower():
                continue
        elif set(run) <= {"…"} and not gap:
            if not (c.isalnum() and ord(text[at - 1]) > 0x2E80):
                continue
        elif not gap:
            previous = text[at - 1] if at > start else ""
            token = WORD.search(text, max(start, at - 60), at)
            if token is None or any(x in token[0] for x in "/@\\") or not (previous.isalnum()):
                continue
            follows = text[first + 1] if first + 1 < end else " "
            if _cased(c) and not opened:
                if not c.isupper() or not (follows.islower() or follows == " " or follows == "." and run != ".") and not (c.isupper() and follows == "."):
                    continue
                if not (previous.isdigit() or previous.islower() and len(token[0].split(".")[-1]) >= 2):
                    continue
            elif not (c.isalpha() and not _cased(c) and ord(previous) > 0x0590 or opened):
                continue
            if run == "." and _abbreviated(text, at, start, text[first : first + 12]):
                continue
        else:
            if c.isdigit():
                if run == "." and (word := WORD.search(text, start, at)) and word[0].isdigit():
                    continue
            elif not starts:
                continue
            if run == "." and _abbreviated(text, at, start, text[first : first + 12]):
                continue
        if j > start:
            found.append(j)
    return sorted({*found, *(m.end() for m in THAI_GAP.finditer(text, start, end))})


def _wrapped(lines: list[tuple[int, int]], text: str, chat: bool | None) -> bool:
    """Whether the lines are prose read on over line ends.

    So if a sentence begins within a line, if each line but the last would have overrun the longest with the next
    line's first word, or, in what is known to be no chat, if a line goes on in lower case where the last didn't end.
    """
    width = max(e - s for s, e in lines)
    if len(lines) < 2 or width < 40:
        return False
    if any(_breaks(text, s, e) for s, e in lines):
        return True
    pairs = list(zip(lines, lines[1:]))
    if all(e - s + 1 + len(text[s2:e2].split(None, 1)[0]) > width for (s, e), (s2, e2) in pairs):
        return not all(END.search(text, e - 1, e) for s, e in lines)  # full lines that all end are no running text
    return chat is False and any(text[s2].islower() and not END.search(text, e - 1, e) for (s, e), (s2, e2) in pairs)


def unit_starts(text: str, chat: bool | None = None) -> list[int]:
    """Positions where units begin, in code points. ``chat``: whether each line is a message, None where that isn't known."""
    out: list[int] = []
    lines: list[tuple[int, int]] = []
    for m in LINE.finditer(text):
        if not m[0].isspace():
            s = m.start() + len(m[0]) - len(m[0].lstrip())
            lines.append((s, m.start() + len(m[0].rstrip())))
    i = 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and not _blank_between(text, lines[j - 1][1], lines[j][0]):
            j += 1
        _block(text, lines[i:j], chat, out)
        i = j
    return out


def _blank_between(text: str, a: int, b: int) -> bool:
    gap = text[a:b].replace("\r\n", "\n")
    return sum(c in "\n\r\x0b\x0c\x85\u2028\u2029" for c in gap) > 1


def _block(text: str, lines: list[tuple[int, int]], chat: bool | None, out: list[int]) -> None:
    if chat:
        out += [s for s, _ in lines]
        return
    run: list[tuple[int, int]] = []

    def close() -> None:
        if not run:
            return
        if _wrapped(run, text, chat):
            out.append(run[0][0])
            out.extend(_breaks(text, run[0][0], run[-1][1]))
        elif len(run) == 1:
            out.append(run[0][0])
            out.extend(_breaks(text, *run[0]))
        else:
            for s, e in run:
                out.append(s)
        run.clear()

    for s, e in lines:
        line = text[s:e]
        if LOG.match(line) or ITEM.match(line) and not run:
            close()
            out.append(s)
        else:
            run.append((s, e))
    close()


def with_units(df: DataFrame, text: str, source: str | None = None, out: str = "starts") -> DataFrame:
    """Adds the start positions of a text's units; none for null and blank texts. ``source`` names a column that is 'chat' for chats.

    Other columns pass through. Texts are read whole.
    """

    @F.arrow_udf("array<int>")
    def starts(texts: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array([unit_starts(t, None if s is None else s == "chat") if t else [] for t, s in zip(texts.to_pylist(), sources.to_pylist())], type=pa.list_(pa.int32()))

    return df.withColumn(out, starts(df[text], df[source] if source else F.lit(None).cast("string")))
