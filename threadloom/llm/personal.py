"""Personal data in texts: voting labelers, expectation maximization over their votes, a final span classifier.

Every span that looks like a value is a candidate. Labelers vote on each for, against, or abstain; expectation
maximization over the counts of equal votes estimates each labeler's accuracy and each candidate's odds, and a naive
Bayes classifier over the span's shape, trained on those, decides. Given names and surnames are learned first, from
mail headers, introductions, salutations and forms of address in the same texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.newtext import WORDS
from threadloom.llm.visible import BREAKS, LOOKS_HTML, TAG
from threadloom.session import cut

_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_MARKUP = re.compile(rf"{TAG.pattern}|(?P<entity>{_ENTITY.pattern})", re.S | re.I)
_LINK = re.compile(r"(?:mailto|tel):([^\"'>?]+)", re.I)

_GAP = r"[^\S\n]"
_AT = rf"(?:@|＠|{_GAP}?(?:\(at\)|\[at\]|\{{at\}}){_GAP}?|{_GAP}AT{_GAP})"
_DOT = rf"(?:\.|{_GAP}?(?:\(dot\)|\[dot\]|\{{dot\}}){_GAP}?|{_GAP}DOT{_GAP})"
EMAIL = re.compile(rf"(?<![\w.+@-])[\w][\w+'-]*(?:{_DOT}[\w+'-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}", re.I)
PHONE = re.compile(r"(?<![\w.,:/+\-@#=(])(?:\+\d|00\d|\(\+?\d|0\d|\d{3}[-.]\d{3}[-.]\d{4}(?!\d))[\d \xa0()/.–-]{4,24}(?<=\d)(?![\w@]|[.:-]\d)|(?<![\w.,:/+\-@#=(])\d{3}[-.]\d{3}[-.]\d{4}(?![\w@]|[.:-]\d)")
ID = re.compile(
    r"(?<![\w./:+-])(?:\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{2} ?\d{6} ?[A-Z] ?\d{3}|[A-Z]\d[A-Z0-9]{6,7}[A-Z]?|\d{3}[- ]\d{2}[- ]\d{4}|[12] ?\d\d ?\d\d ?[\dAB]{2} ?\d{3} ?\d{3} ?\d{2}|\d{4} ?\d{6}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{6}/\d{3,4}|\d{11}|\d{9})(?![\w/]|[.:-]\d)"
)
ID_CUE = re.compile(r"(?:steuer-?id|identifikationsnummer|versicherungsnummer|sozialversicherung|sv-?n(?:ummer|r)|svnr|rv-?nummer|ausweis|reisepass|passport|pass-?nr|\bID card|tax id|\bSSN|social security|national insurance|passeport|sécurité sociale|carte d'identité|\bNIR\b|\bDNI\b|\bNIE\b|\bNIF\b|pasaporte|seguridad social|pesel|rodné číslo|dowód)[^\d\n]{0,22}$", re.I)
ID_PROFILE = re.compile(r"(?:\bnumber|\bNummer|numéro|número)\s*$", re.I)
ID_AFTER = re.compile(r"\s(?:im Profil von|in the profile|manque dans le dossier|dans le dossier|falta en|en el perfil|im Personalbogen)", re.I)
NOT_VALUE = re.compile(r"(?:zählerstand|meter reads|compteur|contador|auftrag\w*|bestell\w*|kunden\w*|rechnung\w*|serien\w*|inventar\w*|artikel\w*|order|invoice|customer|serial|asset|ticket\w*|commande|facture|pedido|factura|série|serie|iban|hrb|ust-?\S*|version\w*|build|konto-?nr\S*|license|lizenz\w*|vorgang\w*|beträgt|device|host|adresse|ip|company no|client|cliente)[^\d\n.]{0,24}$", re.I)
PHONE_CUE = re.compile(r"(?:tel|telefon|fon|fax|mobil|handy\w*|phone|ph|cell|mobile|direct|durchwahl|dienstl|privat|móvil|tél|téléphone|portable|\bT|\bM|\bF|unter|erreichbar|ruf\w*|call\w*|back on|me at|joindre au|llamarme al|abends(?: oder)?|tagsüber|☎|\|)[\s.:)(]*(?:\w{2,9}\s)?$", re.I)

_STREET = r"(?:straße|strasse|str\.|weg|ring|platz|gasse|allee|wall|chaussee|hof|damm|ufer|stieg|steig|pfad|markt|graben|zeile|winkel|promenade)"
_HOUSE = r"\d{1,4}(?:[a-zA-Z](?!\w|\.\w)|\s[a-zA-Z](?![\w.]))?(?:\s?[-–/]\s?\d{1,4}(?:\s?[a-z](?!\w))?)?(?![\w:%]|[.,]\d|\s?(?:Uhr|Minuten|GB|Zeilen))"
_PLACES = "An der|An den|Auf der|Auf dem|Unter den|In der|In den|Am|Im|Zum|Zur|Hinter der|Vor dem|Hinterm"
_CAP = r"[^\W\d_a-zß][^\W\d_]*(?:[-'’][^\W\d_]+)*"
STREET = re.compile(
    rf"(?<![\w@.-])(?:(?:[^\W\d_][\w.]*-)*[^\W\d_]+{_STREET}|(?:[^\W\d_][\w.]*-)*{_CAP}[ -](?:Straße|Strasse|Str\.|Weg|Ring|Platz|Gasse|Allee|Pfad|Markt|Chaussee|Damm|Ufer|Wall|Graben|Stieg|Steig|Promenade|Zeile|Winkel)|(?:{_PLACES})(?: {_CAP}){{1,2}}),?\s{_HOUSE}"
    rf"|(?<![\w@.-])(?:C/|Calle|Plaza|Avenida|Avda\.|Paseo|ul\.|ulica|al\.|Camino)\s?(?:(?:del?|la|los|las|el)\s)*{_CAP}(?:\s(?:del?|la|los|las|el|{_CAP}))*,?\s{_HOUSE}"
    rf"|(?<![\w@./:,-])\d{{1,4}}(?:\s?(?:bis|ter|[a-z]))?,?\s(?:rue|avenue|place|boulevard|bd|allée|chemin|impasse|quai|route)\s(?:(?:d[eu]s?|la|l')\s?)*{_CAP}(?:-{_CAP})*"
    rf"|(?<![\w@./:,-])\d{{1,4}}[a-z]?\s(?:{_CAP}\s|St\.\s|[A-Z]\.\s){{1,3}}(?:Street|Road|Lane|Avenue|Ave\.?|Drive|Close|Blvd\.?|Boulevard|Square|St\.|Rd\.|Ln\.|Way|Court|Row|Terrace|Hill|Yard)(?!\w)",
)
LOWER_STREET = re.compile(rf"(?<![\w@.-])(?:(?:[^\W\d_][\w.]*-)+|(?:[^\W\d_][\w.]*-)*[^\W\d_]{{3,}})(?:straße|strasse|str\.|allee|chaussee|weg|ring|gasse|platz)\s{_HOUSE}", re.I)
#: A street in any spelling after words that announce one.
CUED_STREET = re.compile(rf"(?:(?<=[Ww]ohnhaft )|(?<=[Ww]ohnhaft: )|(?<=wohnt jetzt )|(?<=[Aa]nschrift )|(?<=[Aa]nschrift: )|(?<=[Aa]dresse: )|(?<=Techniker in der ))(?:[^\W\d_][\w.'’-]*\s){{1,5}}{_HOUSE}")
PLACE_CUE = re.compile(r"(?:wohnhaft:?|anschrift:?|adresse:?|address:?|lives at|wohnt(?: jetzt)?(?: in der| im| am| in)?|nach|sitzt der techniker in der|in der|an|to|au|va a|geliefert|domicilié au|sede:?)\s*$", re.I)
POSTCODE = re.compile(r"\s*(?:,|in|\(|\n|[-–|])?\s*(?:\d{5}|[A-Z]{1,2}\d)\b")
NOT_STREET = re.compile(r"^(?:Am|Im|In der|Auf der|An der|Zum|Zur)\s(?:Tor|Raum|Halle|Port|Stock|Terminal|Display|Platz|Gerät|Server|Drucker|Monitor|Schalter|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Mo\w*tag|Dienstag|Mittwoch|Donnerstag|Freitag|Sa\w*tag|Sonntag|Seite|Zeile|Kasse|Waage|Switch|Abschnitt|Ordner|Feld|Ticket|Profil|Build|Version|Anhang|Code|Fehler|Uhr|Jahr|Rack|Slot|Kanal)\b|^(?:Arbeits|Steck|Speicher|Stell)\w*\s\d", re.I)
MACHINES = re.compile(r"\s(?:und|and|et|y)\s\S+\s\d+\s(?:stehen|sind|are|sont|están)|\s(?:stehen|steht|sind|läuft|are|is down)\b")

_W = r"(?:[^\W\d_a-zß](?:[^\W\d_]|['’](?=[^\W\d_]))*(?:-[^\W\d_a-zß](?:[^\W\d_]|['’](?=[^\W\d_]))+|-(?=[^\W\d_]))*(?:[^\W\d_])*|al-[^\W\d_]+(?:-[^\W\d_]+)*)"
_PART = r"(?:von der|van der|van den|von|van|vom|zum|zur|zu|de la|de los|del|de|der|den|da|di|la|le|ten|ter|Mac|Mc|O['’])"
_SUR = rf"(?:{_PART} )*(?![^\W\d_]\. ){_W}"
_INITIAL = r"[^\W\d_a-z]\.(?= )"
NAME = re.compile(rf"(?<![\w@.'’/\\-])(?:{_INITIAL}|{_W})(?: (?:{_INITIAL}|{_SUR})){{0,4}}|(?<![\w@.'’/\\-]){_PART} (?!{_INITIAL}){_SUR}(?: (?:{_INITIAL}|{_SUR})){{0,3}}")
COMMA_NAME = re.compile(rf"(?<![\w@.'’/\\-]){_SUR}, {_W}(?!\w)")
_ACADEMIC = r"(?:(?:Dr|Prof|Dipl\.-\w+|Mag|Ing|Lic)\.?(?:-Ing\.)? )*"
TITLE = re.compile(rf"(?:(?<!\w)(?:Herrn?|Frau|Hr\.|Fr\.|Mr\.?|Mrs\.?|Ms\.?|Miss|Mme|Mlle|M\.|Monsieur|Madame|Sr\.|Sra\.|Señora?|Pan|Pani|paní|pan|Dr\.|Prof\.|ppa\.|i\. ?[AV]\.|p\. ?p\.) ){_ACADEMIC}$")
GREETING = re.compile(r"(?:^|[>\s|])(?:Hallo|Hi|Hello|Hey|Servus|Moin|Salut|Bonjour|Hola|Dear|Liebe[rs]?|Guten (?:Tag|Morgen|Abend)|Good (?:morning|day)|Buenos días|Cher|Chère|Estimad[oa]|Ahoj|Cześć|Sehr geehrte[rs]?) $")
HEADER = re.compile(r"(?:^|[>\s|])(?:Von|From|De|An|To|Para|À|Cc|Kopie)\s?: ?$")
INTRO = re.compile(r"(?:schrieb|geschrieben|hat|wrote|,|a écrit|escribió)\s$", re.I)
CLOSING = re.compile(rf"(?:{WORDS}|Thx|Danke|Thanks|Merci|Gracias)(?:,? ?|[!.–-]\s?)$", re.I)
ALONE_CLOSING = re.compile(rf"\s*(?:{WORDS}|Thx|Danke|Thanks|Merci|Gracias)(?:\s+aus\s+[\w .-]{{2,30}})?[,.!–-]?\s*$", re.I)
AFTER = re.compile(r"^(?:,? ?(?:<|&lt;|\()[^\s]*[@＠]|,? ?\(?[^\s]*@|:\s*$|,? (?:schrieb|wrote|a écrit|escribió|hat)\b|,?\s*(?:<|\()\s*$| (?:moved and|ist umgezogen|das morgen|look at it|s'en|back on|unter)\b|,\s*(?:steuer|Renten|Ausweis|Reisepass|SV|österr|tax|passport|ID card|SSN|social)|: ?(?:steuer|Steuer|Renten|Ausweis|Reisepass|SV|österr))", re.I)
FIRM = re.compile(r"^(?:\s(?:&|und|and|y|et)\s[^\W\d_a-z]\S*\s(?:GmbH|AG|KG|Logistik|OHG|[^\W\d_a-z]\S*)|\s(?:[^\W\d_a-z]\S*\s){0,2}(?:GmbH|AG|KG|eG|Ltd|Inc|S\.?L|SE|SA|SARL|OHG|Logistik|Druck|Wohnbau|Medien|Kältetechnik|Metallbau|Anlagenbau)\b|\s&\s)")
IN_FIRM = re.compile(r"(?:&|\bFa\.|\bFirma)\s$|[^\W\d_a-z]\S* (?:und|and|y) $")
TALK = re.compile(r"^ (?:and|und|et|y) [^\W\d_]+ (?:are the names|sind (?:die )?Namen|sont les noms)|^ (?:are the names|sind (?:die )?Namen|heißen)")
CHANGEABLE = re.compile(r"(?:im|Im|am|Am|der|Der|die|Die|das|Das|den|dem|ein|eine|the|The|le|la|el|Drucker|Server|Raum|Halle|printer|und im|in|In|each|this|next) $")


@lru_cache(maxsize=4096)
def _character(entity: str) -> str:
    return unescape(entity)


def _shown(m: re.Match) -> str:
    """What an entity or piece of markup shows as."""
    found = m[0]
    if found[0] == "&":
        return _character(found)
    return "\n" if m[3] and m[3].lower() in BREAKS else ""


def visible_text(text: str) -> str:
    """The visible text alone."""
    if "<" not in text and "&" not in text:
        return text
    return (_MARKUP if LOOKS_HTML.search(text) is not None else _ENTITY).sub(_shown, text)


def visible(text: str) -> tuple[str, list[int], list[int]]:
    """The visible text, and where runs of it begin: (text, positions in it, positions in the raw text)."""
    if "<" not in text and "&" not in text:
        return text, [0], [0]
    html = LOOKS_HTML.search(text) is not None
    parts: list[str] = []
    ours, raws = [0], [0]
    size = at = 0
    for m in (_MARKUP if html else _ENTITY).finditer(text):
        if m.start() > at:
            parts.append(text[at : m.start()])
            ours.append(size)
            raws.append(at)
            size += m.start() - at
        new = _shown(m)
        parts.append(new)
        ours.append(size)
        raws.append(m.start())
        size += len(new)
        at = m.end()
    parts.append(text[at:])
    ours.append(size)
    raws.append(at)
    return "".join(parts), ours, raws


def _line_before(text: str, at: int) -> str:
    return text[max(text.rfind("\n", 0, at) + 1, at - 60) : at]


def _line_after(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[at : min(end if end >= 0 else len(text), at + 60)]


def _given_and_family(words: str) -> tuple[list[str], list[str]]:
    if ", " in words:
        family, given = words.split(", ", 1)
        return [given], [family.split()[-1]]
    parts = [w for w in words.split() if not w.endswith(".")]
    return (parts[:1], parts[-1:]) if len(parts) > 1 else ([], [])


def _is_word(word: str) -> bool:
    return len(word) > 1 and not word.endswith(".") and word not in NOBODY and word.rstrip("'’") not in _PARTICLES


def name_words(counts: dict[tuple[str, str], int], least: int) -> dict[str, frozenset]:
    """The given names (g) and surnames (s); a word counts as both only if it is often enough seen as either."""
    words = {role: {w for (w, r), n in counts.items() if r == role and n >= least and n >= 0.2 * counts.get((w, other), 0)} for role, other in ("gs", "sg")}
    return {role: frozenset(known | {w.upper() for w in known if len(w) > 2}) for role, known in words.items()}


def _anchored(text: str) -> set[tuple[str, str]]:
    """(word, 'g' or 's') of the names that stand where only a person's name does."""
    found: set[tuple[str, str]] = set()
    addressed = ADDRESSED.finditer(text) if "@" in text or "＠" in text else ()
    named = (m for a in addressed if (m := BEFORE_ADDRESS.search(text, max(0, a.start() - 60), a.start())))
    titled = LEARN_TITLE.finditer(text) if any(x in text for x in _LEARNED) else ()
    greeted = LEARN_HELLO.finditer(text) if any(x in text for x in _HELLOS) else ()
    for rx, matches in ((ADDRESSED, named), (LEARN_TITLE, titled), (LEARN_HELLO, greeted)):
        for m in matches:
            name = m["name"]
            given, family = _given_and_family(name)
            if not given and rx is LEARN_TITLE:
                family = [name.split()[-1]]
            elif not given and rx is LEARN_HELLO:
                given = [name]
            found.update((w, "g") for w in given if _is_word(w))
            found.update((w, "s") for w in family if _is_word(w))
    return found


_LEARNED = ("Herr", "Frau", "Hr.", "Fr.", "Mr", "Ms", "Mme", "M.", "Sr", "Dr.")
_HELLOS = ("Hallo ", "Hi ", "Hello ", "Hey ", "Servus ", "Salut ", "Hola ", "Dear ")
_FULL = rf"(?:{_SUR}, {_W}|{_W}(?: [^\W\d_a-z]\.)?(?: {_SUR}){{1,2}})"
ADDRESSED = re.compile(r" <[^\s<>]+[@＠]")
BEFORE_ADDRESS = re.compile(rf"(?<![\w'’-])(?P<name>{_FULL})$")
LEARN_TITLE = re.compile(rf"(?<!\w)(?:Herrn?|Frau|Hr\.|Fr\.|Mr\.?|Mrs\.?|Ms\.?|Mme|M\.|Sr\.|Sra\.|Dr\.) {_ACADEMIC}(?P<name>(?:{_W} )?{_SUR})(?=[,.:;!?)]|\s*$)", re.M)
LEARN_HELLO = re.compile(rf"^[> |]*(?:Hallo|Hi|Hello|Hey|Servus|Salut|Hola|Dear) (?P<name>{_W}(?: {_SUR})?)(?=[,!]| -\s*$)", re.M)
NOBODY = frozenset("zusammen Team Support Helpdesk Kollegen Damen Service Desk Alle Herr Herrn Frau Hr Fr Mr Mrs Ms Mme M Dr Prof Sr Sra all there everyone".split())


def _name_candidates(text: str, given: frozenset, family: frozenset, taken: list[tuple[int, int]], a: int, b: int) -> list[tuple[str, int, str, str]]:
    out: list[tuple[str, int, str, str]] = []
    done = 0
    spans: list[tuple[int, int]] = []
    if text.find(", ", a, b) >= 0:
        spans = [(m.start(), m.end()) for m in COMMA_NAME.finditer(text, a, b) if m[0].split(", ")[1] in given and (m[0].split(", ")[0].split()[-1] in family or AFTER.match(_line_after(text, m.end())))]
    commas = {s for s, _ in spans}
    for m in NAME.finditer(text, a, b):
        parts = m[0].split()
        if not (given.isdisjoint(parts) and family.isdisjoint(parts) and _ADDRESS.isdisjoint(parts)) or _titled(text, a, m.start()):
            spans.append(m.span())
    spans.sort(key=lambda x: (x[0], -x[1]))
    for start, end in spans:
        if start < done:
            if end <= done:
                continue
            start = done + 1
        tokens = [(m.start() + start, m[0]) for m in _TOKEN.finditer(text[start:end])]
        if start in commas:
            group = [tokens]
        else:  # the known words, with the particles and initials among them
            group, now = [], []
            for token in tokens:
                word = token[1]
                if word in ("A.", "V.") and text[token[0] - 3 : token[0]].rstrip().endswith("i."):
                    continue
                if now and word in given and word not in family and all(w in _PARTICLES for _, w in now):
                    now = []
                if word in given or word in family or len(word) == 2 and word[1] == "." or word.rstrip("'’") in _PARTICLES:
                    if word in given and any(w in family for _, w in now) and word not in family:
                        group.append(now)
                        now = []
                    now.append(token)
                elif now and (now[-1][1] in given or now[-1][1][1:] == "." and now[0][1] in given) and token[0] == now[-1][0] + len(now[-1][1]) + 1 and word[0].isupper():
                    group.append([*now, token])  # an unknown word after a given name
                    now = []
                elif now:
                    group.append(now)
                    now = []
            group.append(now)
            if not any(w in given or w in family for g in group for _, w in g):  # an unknown name is told by what leads to it
                left = _line_before(text, start)
                at = next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i][1] in _ADDRESS), None)
                if at is not None:  # the form of address is part of the run of capital words
                    rest = tokens[at + 1 :]
                    while rest and rest[0][1] in _ACADEMICS:
                        rest = rest[1:]
                    group = [rest[:1]] if rest and not re.match(r"[A-ZÄÖÜ]{2,}\b|(?:" + "|".join(NOBODY) + r")\b", rest[0][1]) else []
                else:
                    group = [tokens[:3]] if TITLE.search(left) and not re.match(r"[A-Z]{2,}\b|(?:" + "|".join(NOBODY) + r")\b", tokens[0][1]) else []
        for g in group:
            while g and g[-1][1].rstrip("'’") in _PARTICLES or g and len(g[-1][1]) == 2 and g[-1][1][1] == ".":
                g = g[:-1]
            if not g:
                continue
            s, e = g[0][0], g[-1][0] + len(g[-1][1])
            if any(a < e and s < b for a, b in taken):
                continue
            words = [w for _, w in g if w.rstrip("'’,") not in _PARTICLES]
            vote = _name_votes(text, s, e, words, given, family)
            if vote:
                out.append(("name", s, *vote, e))
                done = e
    return out


def _titled(text: str, a: int, at: int) -> bool:
    """Whether what stands before ``at`` in its line may be a form of address; only rules out."""
    if at <= a or text[at - 1] != " ":
        return False
    word = text[max(a, text.rfind(" ", a, at - 1) + 1) : at - 1]
    return word[-1:] == "." or word.lstrip("<>(\"'|*-:;,/") in _TITLE_WORDS or word[-1:].isalpha() and _LETTERS.findall(word)[-1] in _TITLE_WORDS


_ADDRESS = frozenset("Herr Herrn Frau Hr. Fr. Mr Mr. Mrs Mrs. Ms Ms. Mme Monsieur Madame".split())
_ACADEMICS = frozenset("Dr. Prof. Mag. Ing. Lic. Dr Prof".split())
_PARTICLES = frozenset("von van der den vom zum zur zu de la los del da di le ten ter Mac Mc O".split())


#: What a left side ends with if the pattern of that name can match there; asked first, as that is much cheaper.
_SPOKEN = tuple(
    f"{x} "
    for x in (
        "Kann", "Könnte", "Could", "Can", "Laut", "vertritt mich", "covers for me is", "rufen Sie", "Please call", "please call", "Konto von", "account of", "compte de", "cuenta de", "Konto:", "Zugang anlegen für", "Unterlagen von",
        "papers of", "Profil von", "dossier de", "perfil de", "starter:", "Ansprechpartner vor Ort ist", "Fragen Sie", "Ask", "ask", "discussed this with", "mit", "und", "oder", "or", "and", "von", "for", "für", "Ich bin", "I am", "hier ist",
        "this is", "Name:", "nombre es", "frag", "bei", "an", "contact",
    )
)
_GREETED = tuple(f"{x} " for x in "Hallo Hi Hello Hey Servus Moin Salut Bonjour Hola Dear Liebe Lieber Liebes Tag Morgen Abend morning day días Cher Chère Estimado Estimada Ahoj Cześć geehrte geehrter geehrtes".split())
_CLOSED = ("br", "dank", "danke", "mfg", "lg", "vg", "bg", "hochachtungsvoll", "regards", "wishes", "best", "cheers", "sincerely", "yours", "faithfully", "truly", "thanks", "cordialement", "salutations", "distinguées", "vous", "toi", "saludo", "saludos", "cordiales", "atentamente", "abrazo", "thx", "merci", "gracias")
_FIRM_LEFT = ("&", "Fa.", "Firma", " und", " and", " y")
_PLACE_LEFT = ("Rose and", "Rose und", "Drucker", "Server", "Firma", "Fa.", "Standort", "Empfang", "Ort", "aus")


def _may_close(left: str) -> bool:
    tail = left.rstrip(" ,!.–-\t\xa0").lower()
    return tail.endswith(_CLOSED) or "gr" in tail[tail.rfind(" ") + 1 :] or tail[-1:] in ("ß", "e") and "gr" in tail


def _name_votes(text: str, s: int, e: int, words: list[str], given: frozenset, family: frozenset) -> tuple[str, str] | None:
    left, right = _line_before(text, s), _line_after(text, e)
    spaced = left[-1:].isspace()
    clean = [w.strip(",") for w in words]
    first, last = clean[0] in given, clean[-1] in family
    swapped = words[0].endswith(",")
    full = len(clean) > 1 and (first or swapped or clean[0][1:] == "." and last)
    title = _titled(text, s - len(left), s) and TITLE.search(left) is not None
    greeting = left.endswith(_GREETED) and GREETING.search(left) is not None
    rest = right.strip(" ,!-–.:")
    bare = left.strip(" >|*") == "" or title and TITLE.fullmatch(left.lstrip(" >|*")) is not None
    alone = bare and not rest
    closing = _may_close(left) and CLOSING.search(left) is not None
    if not closing and alone:
        above = text[max(0, s - 160) : s - len(left)].rstrip("\n >|").rsplit("\n", 1)[-1]
        closing = ALONE_CLOSING.match(above.lstrip("> |")) is not None or SIGNS.match(above.lstrip("> |")) is not None
    after_right = AFTER.match(right) is not None
    place = "+" if title or closing or greeting and (not rest or full) or greeting and right[:1] in ",!" or ":" in left[-3:] and HEADER.search(left) else "0"
    talk = "+" if spaced and (full or title or after_right) and left.endswith(_SPOKEN) else "0"
    known = "+" if full else "0"
    after = "+" if after_right or alone and (full or first and text[max(0, s - len(left) - 2) : s - len(left)] == "\n\n") else "0"
    if FIRM.match(right) or TALK.match(right):
        against = "-"
    else:
        before = left.rstrip() if spaced else ""
        firm = before.endswith(_FIRM_LEFT) and IN_FIRM.search(left) or before.endswith(_PLACE_LEFT)
        against = "-" if firm or any(w.isupper() and len(w) > 2 for w in clean) and not (title or closing or full and last) else "0"
    common = "-" if not full and not title and not closing and place == "0" and talk == "0" and after == "0" else "0"
    if right[:2].strip()[:1].isdigit() and not full and not title:
        against = "-"
    return place + talk + known + after + against + common, f"{min(len(words), 3)}{'l' if bare else 'i'}{'f' if first else '-'}{'s' if last else '-'}"


SIGNS = re.compile(r"(?:[-–—_*=~#]{2,}|—|–)\s*$")


_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
#: What an identity number of fewer than seven digits begins with.
_LETTERED = re.compile(r"[A-Z]\d[A-Z0-9]{6}")
_DIGITS = re.compile(r"\d[\d \xa0()/.–+-]{4}|\d[A-Z]\d|[A-Z]\d")
#: Words of which a line with a street in other languages than German has at least one.
_STREET_WORDS = frozenset("C Calle Plaza Avenida Avda Paseo ul ulica al Camino rue avenue place boulevard bd allée chemin impasse quai route Street Road Lane Avenue Ave Drive Close Blvd Boulevard Square St Rd Ln Way Court Row Terrace Hill Yard".split())
#: What a street with a house number behind it has before and at that number, in lower case.
_STREET_ENDS = tuple(_STREET[3:-1].replace("\\.", ".").split("|"))
_HOUSE_FOLLOWS = re.compile(r"\s\d")
#: The first words of streets that begin with a preposition, and how such a street goes on.
_STREET_PLACES = frozenset("An Auf Unter In Am Im Zum Zur Hinter Vor Hinterm".split())
_PLACE_STREET = re.compile(rf"(?:{_PLACES})(?: {_CAP}){{1,2}},?\s\d")
#: A number after or before a word, as house numbers stand.
_NUMBERED = re.compile(r"[^\W\d_]\.?,?\s\d|\d(?:\s?(?:bis|ter|[a-z]))?,?\s[^\W\d_]")
_DIGIT = re.compile(r"\d")
_SPELLED = re.compile(rf"{_GAP}AT{_GAP}")
#: Parts of the words that lead to identity numbers or follow them; a line without any has none.
_ID_SIGNS = ahocorasick.Automaton()
for _sign in ("steuer", "identifika", "versicher", "sv-n", "svnr", "rv-", "rvn", "ausweis", "pass", "id card", "tax id", "ssn", "social", "national", "sécurité", "carte d", "nir", "dni", "nie", "nif", "segur", "pesel", "rodné", "dowód", "number", "nummer", "numéro", "número"):
    _ID_SIGNS.add_word(_sign, True)
_ID_SIGNS.make_automaton()
_TITLE_WORDS = frozenset("Herr Herrn Frau Hr Fr Mr Mrs Ms Miss Mme Mlle M Monsieur Madame Sr Sra Señor Señora Pan Pani paní pan Dr Prof ppa A V p".split())


@lru_cache(maxsize=4)
def _pieces(given: frozenset, family: frozenset) -> frozenset:
    """The runs of letters of which a line with a name has at least one."""
    return frozenset(x for w in (*given, *family) for x in _LETTERS.findall(w)) | _TITLE_WORDS


def _line_candidates(seen: str, a: int, b: int, line: str, given: frozenset, family: frozenset, pieces: frozenset, out: list) -> bool:
    """Adds the candidates of one line; no value runs over its end. What is asked first only rules out lines without any.

    Tells whether nothing was asked of other lines, so that the same line gives the same elsewhere.
    """
    apart = not ("A." in line[:5] or "V." in line[:5])  # "i. V." may be wrapped
    taken: list[tuple[int, int]] = []
    lower = line.lower()
    if "@" in line or "＠" in line or "AT" in line and _SPELLED.search(line) or "(at)" in lower or "[at]" in lower or "{at}" in lower:
        for m in EMAIL.finditer(seen, a, b):
            value = m[0]
            plain = "@" in value or "＠" in value
            if not plain and not re.search(r"\[|\(|\{| AT ", value):
                continue
            taken.append(m.span())
            out.append(("email", m.start(), "+" + ("+" if plain else "0") + ("-" if seen[max(0, m.start() - 3) : m.start()] == "://" else "0"), "plain" if plain else "spelled", m.end()))
    words = _LETTERS.findall(line)
    digits = len(_DIGIT.findall(line))
    lettered = 0 < digits < 7 and _LETTERED.search(line) is not None
    if lettered or digits >= 6 and _DIGITS.search(line):
        values = []
        for m in ID.finditer(seen, a, b) if (lettered or digits >= 7) and next(_ID_SIGNS.iter(lower), None) else ():
            if any(x < m.end() and m.start() < y for x, y in taken):
                continue
            left, right = _line_before(seen, m.start()), seen[m.end() : m.end() + 30]
            apart = apart and m.end() + 30 <= b
            cue, profile, wrong = ID_CUE.search(left), ID_PROFILE.search(left) and ID_AFTER.match(right), NOT_VALUE.search(left)
            if cue or profile:
                values.append(m.span())
                out.append(("id_number", m.start(), ("+" if cue else "0") + ("+" if profile else "0") + ("-" if wrong and not cue else "0"), re.sub(r"[A-Za-z]", "A", re.sub(r"\d+", "0", m[0])), m.end()))
        taken += values
        for m in PHONE.finditer(seen, a, b) if digits >= 6 else ():
            if not 6 <= sum(c.isdigit() for c in m[0]) <= 16 or any(x < m.end() and m.start() < y for x, y in taken):
                continue
            left = _line_before(seen, m.start())
            grouped = re.match(r"\+|00|\(|0\d{1,4}[-/ –\xa0]|\d{3}[-.]\d{3}[-.]\d{4}|0\d{8,}", m[0]) is not None
            date = re.match(r"\d\d[./-]\d\d[./-]\d{2,4}|\d{4}-\d\d-\d\d|\d{1,3}(?:\.\d{1,3}){3}$", m[0]) is not None
            taken.append(m.span())
            cue = PHONE_CUE.search(left)
            out.append(("phone", m.start(), ("+" if grouped else "-") + ("+" if cue else "0") + ("-" if not cue and NOT_VALUE.search(left) else "0") + ("-" if date else "0"), re.sub(r"\d+", "0", m[0])[:12], m.end()))
    ends = digits > 0 and any(lower.endswith(_STREET_ENDS, 0, m.start() - (lower[m.start() - 1 : m.start()] == ",")) for m in _HOUSE_FOLLOWS.finditer(lower))
    near = ends or digits > 0 and (not _STREET_PLACES.isdisjoint(words) and _PLACE_STREET.search(line) is not None or not _STREET_WORDS.isdisjoint(words) and _NUMBERED.search(line) is not None)
    cued = digits and ("ohnhaft" in line or "wohnt jetzt" in line or "nschrift" in line or "dresse: " in line or "Techniker in der " in line)
    for rx, asked in ((STREET, near), (LOWER_STREET, ends), (CUED_STREET, cued)):
        if not asked:
            continue
        for m in rx.finditer(seen, a, b):
            if any(x < m.end() and m.start() < y for x, y in taken):
                continue
            left, right = _line_before(seen, m.start()), seen[m.end() : m.end() + 20]
            apart = False
            cue = PLACE_CUE.search(left) is not None or left.strip(" >|*") == ""
            wrong = NOT_STREET.search(m[0]) is not None or MACHINES.match(seen, m.end()) is not None
            taken.append(m.span())
            out.append(("street_address", m.start(), "+" + ("+" if cue else "0") + ("+" if POSTCODE.match(right) else "0") + ("-" if wrong else "0"), re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", m[0]))[:12], _address_end(seen, m.end(), b)))
    if (given or family) and not pieces.isdisjoint(words):
        found = _name_candidates(seen, given, family, taken, a, b)
        out += found
        apart = apart and not any(_alone(line, c[1] - a, c[4] - a) for c in found)
    return apart


def _alone(line: str, s: int, e: int) -> bool:
    """Whether a name may be all of its line, so that the line above counts; may say so too often."""
    return not line[e : e + 60].strip(" ,!-–.:")


#: How many different lines a worker keeps with what they gave.
_KEPT_LINES = 100_000


@lru_cache(maxsize=1)
def _known_lines(given: frozenset, family: frozenset) -> dict[str, tuple]:
    """What lines gave that were seen before with these names, with positions from the line's begin."""
    return {}


def candidates(text: str, given: frozenset, family: frozenset) -> list[tuple[str, int, str, str, int]]:
    """(type, position in the raw text, votes, shape, end) of everything in a text that looks like a value."""
    seen, ours, raws = visible(text)
    out: list[tuple[str, int, str, str, int]] = []
    pieces, known = _pieces(given, family), _known_lines(given, family)
    start = 0
    for line in seen.split("\n"):
        if line:
            before = known.get(line)
            if before is not None:
                out += [(t, p + start, v, k, e + start) for t, p, v, k, e in before]
            else:
                n = len(out)
                if _line_candidates(seen, start, start + len(line), line, given, family, pieces, out):
                    if len(known) >= _KEPT_LINES:
                        known.clear()
                    known[line] = tuple((t, p - start, v, k, e - start) for t, p, v, k, e in out[n:])
        start += len(line) + 1
    if len(ours) > 1:
        ours.append(len(seen) + 1)
        raws.append(len(text))

        def raw(p: int) -> int:
            i = bisect_right(ours, p) - 1
            return raws[i] + min(p - ours[i], max(0, raws[i + 1] - raws[i] - 1))

        def raw_end(p: int) -> int:
            i = bisect_right(ours, p - 1) - 1
            return raws[i + 1] if p == ours[i + 1] else raws[i] + p - ours[i]

        out = [(t, raw(p), v, k, raw_end(e)) for t, p, v, k, e in out]
        if "mailto:" in text or "tel:" in text:
            for m in TAG.finditer(text):
                if m[4] and (link := _LINK.search(m[4])):
                    kind = "email" if m[4][link.start() : link.start() + 1] in "mM" else "phone"
                    out.append((kind, m.start(4) + link.start(1), "++00"[: 3 if kind == "email" else 4], "link", m.start(4) + link.end(1)))
    return out


#: What may follow street and house number: flat, postcode, place.
_ADDRESS_TAIL = re.compile(rf"(?:\s[a-z](?!\w))?(?:,?\s(?:Unit|Apt\.?|Suite|Flat|Whg\.?|Etage|\d+\.º)\s?\w*\.?)?(?:\s?(?:,|in|\(|[-–|])?\s?(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s(?:St\.\s|Bad\s)?{_CAP}\)?|\s\((?:St\.\s|Bad\s)?{_CAP}\)|,\s(?:St\.\s|Bad\s)?{_CAP}(?=[.,;]|$))?")


def _address_end(text: str, at: int, line_end: int) -> int:
    tail = _ADDRESS_TAIL.match(text, at, line_end)
    return tail.end() if tail else at


def redacted_text(text: str, found: list[tuple[str, int, str, str, int]]) -> str:
    """The text with a placeholder such as [EMAIL] in the place of each value, all else unchanged; of overlapping values the first counts."""
    parts, at = [], 0
    for kind, start, _, _, end in sorted(found, key=lambda c: (c[1], -c[4])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*parts, text[at:]])


_ARROW = pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int32()), ("votes", pa.string()), ("shape", pa.string())]))


#: Log odds that a vote may come to; abstaining counts for nothing, and always saying the same for little.
_LIMITS = {"+": (0.4, 4.0), "0": (0.0, 0.0), "-": (-6.0, -2.5)}


def estimate(counts: list[tuple[str, str, str, int]], rounds: int = 25) -> set[tuple[str, str, str]]:
    """The (type, votes, shape) that are values, from how often each occurs.

    Expectation maximization over two classes with each labeler's rates of votes in either, for each type; then naive
    Bayes over shapes, trained on its odds.
    """
    kept: set[tuple[str, str, str]] = set()
    for kind in sorted({c[0] for c in counts}):
        patterns: dict[str, int] = {}
        for k, votes, _, n in counts:
            if k == kind:
                patterns[votes] = patterns.get(votes, 0) + n
        width = len(next(iter(patterns)))
        weight = [{"+": 1.5, "0": 0.0, "-": -3.0} for _ in range(width)]
        start, odds, p = 0.0, {}, {}
        for _ in range(rounds):
            odds = {votes: start + sum(weight[i][v] for i, v in enumerate(votes)) for votes in patterns}
            p = {v: 1 / (1 + math.exp(-max(-30, min(30, o)))) for v, o in odds.items()}
            yes = sum(n * p[v] for v, n in patterns.items())
            no = sum(n * (1 - p[v]) for v, n in patterns.items())
            start = max(-0.3, min(2.0, math.log((yes + 1) / (no + 1))))
            for i in range(width):
                for sign, (low, high) in _LIMITS.items():
                    a = sum(n * p[v] for v, n in patterns.items() if v[i] == sign) + 1
                    b = sum(n * (1 - p[v]) for v, n in patterns.items() if v[i] == sign) + 1
                    weight[i][sign] = max(low, min(high, math.log(a / (yes + 3)) - math.log(b / (no + 3))))
        shapes: dict[str, list[float]] = {}
        for k, votes, shape, n in counts:
            if k == kind:
                x = shapes.setdefault(shape, [0.0, 0.0])
                x[0] += n * p[votes]
                x[1] += n * (1 - p[votes])
        yes, no = sum(x[0] for x in shapes.values()) + 1, sum(x[1] for x in shapes.values()) + 1
        for k, votes, shape, _ in counts:
            if k == kind:
                x = shapes[shape]
                evidence = math.log((x[0] + 1) / yes) - math.log((x[1] + 1) / no)
                if odds[votes] + max(-1.0, min(1.0, evidence)) > 0:
                    kept.add((kind, votes, shape))
    return kept


def _names(df: DataFrame, text: str, least: int):
    """The given names and surnames of a collection, sent to all tasks: words seen at least ``least`` times where only names stand."""

    @F.arrow_udf("array<struct<word: string, role: string>>")
    def learn(texts: pa.Array) -> pa.Array:
        return pa.array([[{"word": w, "role": r} for w, r in _anchored(visible_text(t))] if t else [] for t in texts.to_pylist()], type=pa.list_(pa.struct([("word", pa.string()), ("role", pa.string())])))

    seen = df.select(F.explode(learn(df[text])).alias("w")).groupBy("w.word", "w.role").count().where(F.col("count") >= least).collect()
    return df.sparkSession.sparkContext.broadcast(name_words({(r["word"], r["role"]): r["count"] for r in seen}, least))


def _fitted(df: DataFrame, keys: list[str], text: str, least: int):
    """(names, candidates of all texts, the kinds of candidates that are values)."""
    shared = _names(df, text, least)

    @F.arrow_udf("array<struct<pii_type: string, start_pos: int, votes: string, shape: string>>")
    def look(texts: pa.Array) -> pa.Array:
        names = shared.value
        return pa.array([[c[:4] for c in candidates(t, names["g"], names["s"])] if t else [] for t in texts.to_pylist()], type=_ARROW)

    found = cut(df.select(*keys, F.explode(look(df[text])).alias("c")).select(*keys, "c.*").distinct())
    counts = [tuple(r) for r in found.groupBy("pii_type", "votes", "shape").count().collect()]
    return shared, found, sorted(estimate(counts))


def personal_data(df: DataFrame, keys: list[str], text: str, least: int = 2) -> DataFrame:
    """One row (keys, pii_type, start_pos) for each value in the texts; null texts have none.

    What stays on the driver is the list of name words seen at least ``least`` times and the counts of equal votes.
    """
    _, found, kept = _fitted(df, keys, text, least)
    if not kept:
        return found.select(*keys, "pii_type", "start_pos").limit(0)
    values = df.sparkSession.createDataFrame(kept, "pii_type string, votes string, shape string")
    return found.join(F.broadcast(values), ["pii_type", "votes", "shape"], "left_semi").select(*keys, "pii_type", "start_pos").distinct()


def redacted(df: DataFrame, keys: list[str], text: str, out: str = "redacted", least: int = 2) -> DataFrame:
    """Adds each text with typed placeholders for its values, by the same model as ``personal_data``; null stays null.

    Texts without values come out as they are. Other columns pass through; one named ``out`` is replaced.
    """
    shared, _, kept = _fitted(df, keys, text, least)
    values = df.sparkSession.sparkContext.broadcast(frozenset(kept))

    @F.arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        names, wanted = shared.value, values.value
        rows = []
        for t in texts.to_pylist():
            found = [c for c in candidates(t, names["g"], names["s"]) if (c[0], c[2], c[3]) in wanted] if t else []
            rows.append(redacted_text(t, found) if found else t)
        return pa.array(rows, type=pa.string())

    return df.withColumn(out, replace(df[text]))
