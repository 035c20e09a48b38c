"""Personal information inside free text, by weak-supervision aggregation.

One pass gathers a gazetteer: given and family names that stand in name contexts.  A second
pass proposes candidate spans of five kinds and lets labelers vote on each: a format
labeler (regular expressions), two context labelers (the words before, the words behind)
and two lexicon labelers (gazetteer, street words, number labels).  A vote is 1, -1, or 0
for no opinion.  Expectation-maximisation over the counts of all vote patterns estimates
how reliable each labeler is and how likely each pattern is personal information; these
likelihoods train a logistic classifier over the votes and the form of the span itself
(length, case, digits, separators).  Vote patterns are at most 3^5 and forms at most 108 per
kind, so what reaches the driver is bounded whatever the corpus; candidates and texts never do.

The gazetteer is a table and may have any size.  Tasks hold a bitmap of fixed size of its
given names, which only proposes spans; a join with the table decides them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.spread import spread_join
from pairlens.plans import WorkTables

KINDS = ("email", "phone", "id_number", "address", "name")
#: A gazetteer name stands with at least this many different partner names.
MIN_PARTNERS = 3
#: The bitmap of given names has 2 ** FILTER_BITS bits (1 MB), whatever their number.
FILTER_BITS = 23

Span = tuple[str, int, int, tuple[int, int, int, int, int]]

# --- e-mail -----------------------------------------------------------------------------

_AT = re.compile(r" ?@ ?|&#64;| ?\[at\] ?| ?\(at\) ?| at (?=[\w-]+(?: dot |\.\w))")
_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[^\W_](?:[\w-]*[^\W_])?)+")
_MAIL_CUE = re.compile(r"(?:mailto:|write to|mail ?=|courriel ?=|correo ?=|e-?mail:?|under|bitte an|Escribir a|!!!|reach(?:ed)? (?:at|under))\s?$", re.I)


def _run_before(t: str, end: int, also: str) -> int:
    """Start of the run of letters, digits and the given characters that ends before ``end``."""
    while end and (t[end - 1].isalnum() or t[end - 1] in also):
        end -= 1
    return end


def _emails(t: str) -> Iterator[Span]:
    if "@" not in t and "&#64;" not in t and "[at]" not in t and "(at)" not in t and " dot " not in t:
        return
    for at in _AT.finditer(t):
        start, domain = _run_before(t, at.start(), "_.+-"), _DOMAIN.match(t, at.end())
        while start < at.start() and not t[start].isalnum():
            start += 1
        if start == at.start() or not domain:
            continue
        spelled = at.group() == " at "
        if spelled and " dot " not in domain.group():
            continue
        end = domain.end()
        tld = re.split(r"[^\w]+", domain.group())[-1]
        plain = at.group() == "@" and "." in domain.group()
        before, behind = t[max(0, start - 24) : start], t[end : end + 2]
        yield "email", start, end, (1 if plain else 0, 1 if _MAIL_CUE.search(before) else -1 if before.endswith(("{{User ", "Follow ")) else 0, -1 if behind[:1] in ("/", "@") else 0, 1 if tld.isalpha() and len(tld) > 1 else -1, 0 if spelled else 1)


# --- telephone numbers and numbers of persons ---------------------------------------------

_DIGITS = re.compile(r"[+(\d](?:(?:\) |[ ./-]| \(|\(|\))?\d){6,}")
_PHONE_SURE = re.compile(r"\+\d{1,3}[ .-]?(?:\(0\))?\d(?:[ .-]?\d){6,12}|00\d{1,3}[ .-]\d(?:[ .-]?\d){6,11}|(?:\+\d{1,3} )?\(\d{3}\) \d{3}-\d{4}|0\d(?:[ .]\d\d){4}|0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,4})?|0\d{9,10}")
_PHONE_LIKE = re.compile(r"\d{3}([.-])\d{3}\1\d{4}|\d{3} \d{3} \d{4}")
_PHONE_CUE = re.compile(r"(?:\btel\.?:?|\btél\.?:?|\btel=|\bphone:?|\bfax:?|\bcall|\bor|\bon|\|\||\w,)\s?$", re.I)
_PHONE_WORD = re.compile(r"(?:\bt[eé]l|phone|fax|call|mobile|Telefon|reached)", re.I)
_THING_CUE = re.compile(r"(?:ISBN|entry|code|Rev\.|relabelled|Inventory no\.|Accession|no\.|coord\||\bin|\bof|invoice|order|serial|version)\s?$", re.I)
_THING_AFTER = re.compile(r"\s?(?:\(spare|was with|was reverted|was relabel|in the county|[NSEW]\b|m\b|km\b|%)")
_REACHED = re.compile(r"(?:[,;]|\s*(?:-->|\|\||\}\}|\n|$| and ask))")

#: Labels of numbers that an authority issues to a person.
ID_LABELS = (
    "social security", "SSN", "NI no", "national insurance", "passport", "identity card", "driving licence", "driver's license", "tax number",
    "Steuer-ID", "Steuernummer", "Sozialversicherungsnummer", "Reisepass", "Personalausweis", "Führerschein",
    "carte d'identité", "passeport", "sécurité sociale", "permis de conduire", "numéro fiscal",
    "DNI", "NIE", "NIF", "pasaporte", "seguridad social", "permiso de conducir",
)
_ID_LABEL = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ID_LABELS)) + r")(?!\w)(?: (?:number|no|Nr|card|n°|nº))?\.?(?: is| ist| es| est| ?:| =)? ", re.I)
_LOW_LABELS = tuple(label.lower() for label in ID_LABELS)
_ID_VALUE = re.compile(r"[A-Z0-9]+(?![^\W_])(?:[ ./-][A-Z0-9]+(?![^\W_]))*")
_ID_LIKE = re.compile(r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|\d{4}-\d{4}-\d\d|\d{9,12}|\d{6}/\d{5}")


def _numbers(t: str) -> Iterator[Span]:
    labelled: list[tuple[int, int]] = []
    low = t.lower()
    if any(label in low for label in _LOW_LABELS):
        for label in _ID_LABEL.finditer(t):
            value = _ID_VALUE.match(t, label.end())
            if value and sum(c.isdigit() for c in value.group()) >= 5:
                start, end = value.span()
                labelled.append((start, end))
                yield "id_number", start, end, (1, 1, 1 if _REACHED.match(t, end) or t.startswith(" and", end) else 0, 1, 0)
    for m in _DIGITS.finditer(t):
        start, end = m.span()
        if (start and (t[start - 1].isalnum() or t[start - 1] in "_.,-/")) or (end < len(t) and (t[end].isalnum() or t[end] == "_")) or any(a < end and start < b for a, b in labelled):
            continue
        found = m.group()
        before = t[max(0, start - 24) : start]
        behind = -1 if _THING_AFTER.match(t, end) else 1 if _REACHED.match(t, end) else 0
        thing = _THING_CUE.search(before) is not None
        if sum(c.isdigit() for c in found) < 7:
            continue
        sure, like = _PHONE_SURE.fullmatch(found), _PHONE_LIKE.fullmatch(found)
        word = 1 if _PHONE_WORD.search(before) else -1 if thing or not (sure or like) else 0
        yield "phone", start, end, (1 if sure else 0 if like else -1, 1 if _PHONE_CUE.search(before) else -1 if thing else 0, behind, word, 0)
        if _ID_LIKE.fullmatch(found):
            yield "id_number", start, end, (0, -1 if thing else 0, -1 if behind < 0 else 0, -1, 0)


# --- street addresses -------------------------------------------------------------------

_CAP = r"[^\W\d_a-zß-öø-ÿ][\w’'-]*"
_EN = re.compile(rf"\d(?:\d{{0,4}}) ?[A-Za-z]?,? (?:{_CAP} ){{1,3}}(?:(?:Road|Street|Lane|Avenue|Ave|Close|Terrace|Row|Drive|Court|Square|Way|Place|Gardens|Crescent|Boulevard|Blvd|Hill|Walk|ROAD|STREET|LANE|AVENUE|AVE|CLOSE|TERRACE|ROW|DRIVE|COURT|ST|St|Dr)\b|(?:Rd|RD)\b\.?)")
_FR = re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|ruelle|Rue|Avenue|RUE|AVENUE)(?: (?:de la|des|du|de|DES|DU|DE|DE LA)\b)?(?: [dl][’'])? ?{_CAP}(?:[ -]{_CAP})*")
_DE = re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|markt|STRASSE|STR\.|GASSE|WEG) \d{1,4} ?[a-z]?(?!\w)")
_DE_WORD = re.compile(_CAP)
_DE_AT = re.compile(rf"[AIZUH](?:(?<=\bA)m|(?<=\bA)n de[rn]|(?<=\bA)uf de[mr]|(?<=\bI)m|(?<=\bI)n der|(?<=\bZ)u[mr]|(?<=\bU)nter den|(?<=\bH)inter dem) {_CAP} \d{{1,3}} ?[a-z]?(?!\w)")
_ES = re.compile(rf"(?:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía|CALLE|AVDA\.)(?: (?:del|de la|de los|de las|de|DEL|DE))? {_CAP}(?: {_CAP})*,? (?:(?:nº|n\.º|núm\.|Nº) ?)?\d{{1,4}} ?(?:[A-Za-z](?!\w)|bis\b)?")
_HOME_CUE = re.compile(r"(?:lives at|wohnhaft|wohnt|demeurant|habite|domicilio en|vive en|address ?=|adresse ?=|Anschrift ?=|dirección ?=|post:|Post:|\|\||[^\W\d_],)\s?$")
_HOME_AFTER = re.compile(r"(?:, (?:tel|tél|Tel|to the|\[\[)| \|\|| go and|\.|\n|$| -->|,|</)")


_EN_WORDS = (
    " Road", " Street", " Lane", " Ave", " Close", " Terrace", " Row", " Drive", " Court", " Square", " Way", " Place", " Gardens", " Crescent", " B", " Hill", " Walk", " Rd", " RD", " St", " ST", " Dr",
    " ROAD", " LANE", " AVE", " CLOSE", " TERRACE", " ROW", " DRIVE", " COURT",
)
_EN_NUMBER = re.compile(r"\d[A-Za-z]?,? [A-Z]")
_FR_WORDS = ("rue", "avenue", "av.", "boulevard", "bd ", "place ", "chemin", "allée", "impasse", "quai", "route", "cours ", "Rue", "Avenue", "RUE", "AVENUE")
_DE_WORDS = ("straße ", "strasse ", "str. ", "gasse ", "weg ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig ", "markt ", "STRASSE ", "STR. ", "GASSE ", "WEG ")
_DE_AT_WORDS = ("Am ", "An d", "Auf d", "Im ", "In der ", "Zum ", "Zur ", "Unter den ", "Hinter dem ")
_ES_WORDS = ("Calle", "C/", "Avda.", "Avenida", "Av.", "Plaza", "Pza.", "Paseo", "Camino", "Ronda", "Travesía", "CALLE", "AVDA.")


def _some(words: tuple[str, ...], t: str) -> bool:
    return any(w in t for w in words)


def _addresses(t: str) -> Iterator[Span]:
    spans: dict[tuple[int, int], int] = {}
    if _EN_NUMBER.search(t) and _some(_EN_WORDS, t):
        spans |= {m.span(): 1 for m in _EN.finditer(t)}
    if _some(_FR_WORDS, t):
        spans |= {m.span(): 1 for m in _FR.finditer(t)}
    for m in _DE.finditer(t) if _some(_DE_WORDS, t) else ():
        word = _DE_WORD.search(t, _run_before(t, m.start(), "_’'-"), m.start())
        if word:
            spans[word.start(), m.end()] = 1
        elif old := re.search(r"(?<!\w)(?:Alte|Neue|Lange|Kleine|Große|Hohe|Obere|Untere) $", t[max(0, m.start() - 12) : m.start()]):
            spans[max(0, m.start() - 12) + old.start(), m.end()] = 1
    if _some(_DE_AT_WORDS, t):
        spans |= {m.span(): 0 for m in _DE_AT.finditer(t)}
    if _some(_ES_WORDS, t):
        spans |= {m.span(): 1 for m in _ES.finditer(t)}
    for (start, end), sure in spans.items():
        if start and (t[start - 1].isalnum() or t[start - 1] in "_.-/"):
            continue
        end -= len(t[start:end]) - len(t[start:end].rstrip())
        number = re.search(r"\d+", t[start:end])
        year = len(number.group()) == 4
        cue = 1 if _HOME_CUE.search(t, max(0, start - 24), start) else -1 if t[max(0, start - 3) : start] in ("in ", "In ", "of ") else 0
        yield "address", start, end, (-1 if year else 1 if sure else 0, cue, 1 if _HOME_AFTER.match(t, end) else -1, sure, 0)


# --- names of persons ---------------------------------------------------------------------

_W = r"[^\W\d_]+(?:[’'-][^\W\d_]+)*"
_PART = r"(?:von|van|der|den|de|da|del|della|di|du|la|le|zu|zur|ter|St\.|Mc|Mac|VON|VAN|DE|DEL|DU|LA|ST\.|st\.)"
_FULL = rf"(?:(?:{_PART} ){{0,2}}{_W}, {_W}(?: [^\W\d_]\.)*|{_W}(?: [^\W\d_]\.)*(?: {_PART}){{0,2}} {_W})"
_TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Mme|M|Sr|Sra|Don|Doña|Sir|Lady)\.? )*"
#: Words that stand before a person's name.
NAME_CUES = (
    "Signed: ", "appointment with ", "caretaker (", "form shows ", "lol ", "Letter from ", "led by ", "Ask ", "|name=", "|curator = ", "written by ", "|encargado = ", "|responsable = ",
    "|Ansprechpartner = ", "|Ansprechpartnerin = ", "note: ", "<!-- ", "nennt ", "leitete ", "lettre cite ", "dirigé par ", "menciona a ", "dirigió ", "dirigida por ",
    "Contact : ", "Contact: ", "Contacto: ", "Kontakt: ",
)
_AFTER_CUE = re.compile(rf"{_TITLE}(?P<name>{_FULL})(?=,|\||\)|\]\]|!!!|\s*\n|\s*-->|\.|\s*$| lives at| in the | can be| en 1| im Jahr| in den | dans les | en los )")
_TALK = re.compile(r"User talk:[^|\]\n]*\|")
_CELL = re.compile(r"\|\| (?:\d{1,5}[A-Za-z]?(?: bis)?,? (?:[^\W\d_a-z]|rue|avenue)|C/|Calle|Av|Am |[^\W\d_]+(?:str|weg|gasse|platz))")
_ROW = re.compile(rf"\| ?(?P<name>{_FULL}) $")
_NEEDS = {"lol ": " lives at", "<!-- ": ",", "nennt ": ","}
_CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+")
_NOT_PERSON = re.compile(r"\s(?:Institute|Institut|School|Foundation|Museum|Prize|Award|Road|Street|Lane|Society|Company|Park|Hall|Church|Bridge|festival|brook|tramway|company|gazette|valley)\b")
_PLACE_BEFORE = re.compile(r"(?:Mount|Lake|Cape|Port|Old|Saint|River|Fort|The|ship|User:|title=)\s?$")


_CAPWORD = r"(?=[^\W\d_]+[’'-]?[^\W\d_])[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[’'-][^\W\d_]+)*"
_CAPFULL = rf"(?P<name>{_CAPWORD}(?: [^\W\d_a-z]\.)*(?: {_PART}){{0,2}} {_CAPWORD})(?!\w)"
#: Titles, introductions, salutations and closings, which stand before a name in any text.
_TITLED = re.compile(rf"(?<!\w)(?:Dr|Mr|Mrs|Ms|Prof|Mme|Mlle|Herrn?|Frau|Sra?|Señora?|Doña|Monsieur|Madame)\.? (?:(?:Dr|Prof)\. )*{_CAPFULL}")
_INTRODUCED = re.compile(rf"(?<!\w)(?:[Mm]y name is|I am|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|Dear|Lieber?|Chère?|Estimad[oa]|Querid[oa]|geehrter?) {_TITLE}{_CAPFULL}")
_CLOSED = re.compile(rf"(?:[Rr]egards|[Ss]incerely|[Ww]ishes|Grüßen?|Cordialement|Saludos|Atentamente),?[ \t]*\n\s*{_CAPFULL}")
_INTRO_WORDS = ("y name is", "I am ", "ch heiße", "ein Name ist", "appelle ", "on nom est", "e llamo", "i nombre es", "Dear ", "Liebe", "Cher ", "Chère ", "Estimad", "Querid", "geehrte")
_CLOSE_WORDS = ("egards", "incerely", "ishes", "Grüße", "Cordialement", "Saludos", "Atentamente")
_TITLE_WORDS = ("Dr", "Mr", "Ms", "Prof", "Mme", "Mlle", "Herr", "Frau", "Sr", "Señor", "Doña", "Monsieur", "Madame")


def _parts(name: str) -> tuple[str, str]:
    """Given and family name of a matched name, in lower case, without initials and particles."""
    if "," in name:
        family, given = name.split(",", 1)
    else:
        given, family = name.split(" ", 1)
    words = re.findall(_W, family)
    return re.findall(_W, given)[0].lower(), words[-1].lower() if words else ""


def _in_context(t: str) -> dict[tuple[int, int], None]:
    """Names behind a cue, in a talk link, or in a table row before an address."""
    out: dict[tuple[int, int], None] = {}
    for cue in NAME_CUES:
        at = t.find(cue)
        while at >= 0:
            at += len(cue)
            m = _AFTER_CUE.match(t, at)
            if m and t.startswith(_NEEDS.get(cue, ""), m.end()):
                out[m.span("name")] = None
            at = t.find(cue, at)
    for known, words in ((_TITLED, _TITLE_WORDS), (_INTRODUCED, _INTRO_WORDS), (_CLOSED, _CLOSE_WORDS)):
        if _some(words, t):
            out |= {m.span("name"): None for m in known.finditer(t)}
    if "User talk:" in t:
        for link in _TALK.finditer(t):
            m = _AFTER_CUE.match(t, link.end())
            if m and t.startswith("]]", m.end()):
                out[m.span("name")] = None
    if "||" in t:
        for cell in _CELL.finditer(t):
            line = t.rfind("\n", 0, cell.start()) + 1
            m = _ROW.match(t, line, cell.start())
            if m:
                out[m.span("name")] = None
    return out


_FAMILY = re.compile(r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[’'-][^\W\d_]+)*")


def _known(t: str, given: Callable[[str], bool]) -> dict[tuple[int, int], None]:
    """Names around a given name of the gazetteer that is written with a capital."""
    out: dict[tuple[int, int], None] = {}
    listed = {w for w in set(_CAPITAL.findall(t)) if given(w.lower())}
    for m in _CAPITAL.finditer(t) if listed else ():
        if m.group() not in listed or (m.start() and (t[m.start() - 1].isalnum() or t[m.start() - 1] in "_.+-@")):
            continue
        forward = re.compile(rf"{re.escape(m.group())}(?: [^\W\d_]\.)*(?: {_PART}){{0,2}} [^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[’'-][^\W\d_]+)*").match(t, m.start())
        if forward and not re.compile(r"[\w.+-]*@").match(t, forward.end()):
            out[forward.span()] = None
            continue
        if t.endswith(", ", 0, m.start()):
            end = m.start() - 2
            start = _run_before(t, end, "’'-")
            family = _FAMILY.fullmatch(t, start, end)
            if family and (not start or t[start - 1] not in "._"):
                particles = re.search(rf"(?<!\w)(?:{_PART} ){{1,2}}$", t[max(0, start - 12) : start])
                initials = re.compile(r"(?: [^\W\d_]\.)*").match(t, m.end())
                out[max(0, start - 12) + particles.start() if particles else start, initials.end()] = None
    return out


def _names(t: str, given: Callable[[str], bool] | None) -> Iterator[tuple[Span, str, str, bool]]:
    """Spans with given and family name, and whether only the list of given names proposes them.

    The lexicon votes are open here: a join with the gazetteer gives them.
    """
    context = _in_context(t)
    spans = dict(context)
    if given:
        for s in _known(t, given):
            if not any(a < s[1] and s[0] < b for a, b in context):
                spans[s] = None
    for start, end in spans:
        name = t[start:end]
        first, last = _parts(name)
        letters = re.sub(r"[^\W\d_]\.|" + _PART, "", name)
        shape = 1 if all(w[0].isupper() for w in re.findall(_W, letters)) else 0
        place = _PLACE_BEFORE.search(t, max(0, start - 12), start) or _NOT_PERSON.match(t, end)
        yield ("name", start, end, (shape, 1 if (start, end) in context else 0, -1 if place else 0, 0, 0)), first, last, (start, end) not in context


def form_of(text: str) -> str:
    """The form of a span, as four digits: length (0-2), case (0-2), digits (0-3), separators (0-2)."""
    letters, digits = sum(c.isalpha() for c in text), sum(c.isdigit() for c in text)
    upper = sum(c.isupper() for c in text)
    case = 0 if not upper else 2 if upper == letters and letters > 1 else 1
    apart = sum(not c.isalnum() for c in text)
    return f"{min(2, len(text) // 12)}{case}{0 if not digits else 1 if digits < 5 else 2 if digits < 10 else 3}{min(2, apart)}"


#: Other forms of blanks and hyphens, and the plain ones that the patterns know; one character each.
_FORMS = (("\u00a0", " "), ("\u2007", " "), ("\u2009", " "), ("\u202f", " "), ("\u2010", "-"), ("\u2011", "-"), ("\u2012", "-"), ("\u2013", "-"))


def plain(text: str) -> str:
    """The text with plain blanks and hyphens; every character keeps its place."""
    if not text.isascii():
        for form, simple in _FORMS:
            text = text.replace(form, simple)
    return text


def candidates(text: str | None, given: Callable[[str], bool] | None) -> list[tuple[Span, str | None, str | None, bool]]:
    """All candidate spans of one text with the labelers' votes, and for names their parts."""
    if not text:
        return []
    text = plain(text)
    return [*((s, None, None, False) for s in chain(_emails(text), _numbers(text), _addresses(text))), *_names(text, given)]


# --- Spark ----------------------------------------------------------------------------------


def _context_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [_parts(t[a:b]) for t in map(plain, filter(None, batch.column("text").to_pylist())) for a, b in _in_context(t)]
        yield pa.record_batch([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["given", "family"])


def gazetteer(documents: DataFrame) -> DataFrame:
    """``role, name``: given and family names that stand in name contexts with several different partners."""
    pairs = documents.select("text").mapInArrow(_context_names, "given string, family string").distinct()
    roles = pairs.select(F.explode(F.array(F.struct(F.lit("given").alias("role"), F.col("given").alias("name")), F.struct(F.lit("family").alias("role"), F.col("family").alias("name")))).alias("r"))
    return roles.groupBy("r.role", "r.name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PARTNERS).select("role", "name")


def _bit(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << FILTER_BITS) - 1)


def _bits_of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [_bit(name) for name in batch.column("name").to_pylist()]
        yield pa.record_batch([pa.array([b >> 6 for b in at], pa.int32()), pa.array(np.array([1 << (b & 63) for b in at], dtype=np.uint64).view(np.int64))], names=["word", "bits"])


def _bitmap(given: DataFrame) -> np.ndarray | None:
    """Bits of all given names, or None without any; at most 2 ** (FILTER_BITS - 6) rows reach the driver."""
    words = given.select("name").mapInArrow(_bits_of_names, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not words.num_rows:
        return None
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _signs(votes) -> str:
    return "".join("-0+"[v + 1] for v in votes)


_SPAN_SCHEMA = "doc_id bigint, doc_key bigint, kind string, start int, end int, found_text string, votes string, form string, first string, last string, listed boolean"


def _spans(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        known: dict[str, bool] = {}

        def given(word: str) -> bool:
            held = known.get(word)
            if held is None:
                if len(known) > 200_000:  # a memo, begun anew
                    known.clear()
                b = _bit(word)
                held = known[word] = bool(int(bits[b >> 6]) >> (b & 63) & 1)
            return held

        for batch in batches:
            found = [
                (i, kind, a, b, t[a:b], _signs(votes), form_of(t[a:b]), first, last, listed)
                for i, t in enumerate(batch.column("text").to_pylist())
                for (kind, a, b, votes), first, last, listed in candidates(t, None if bits is None else given)
            ]
            at, *columns = zip(*found, strict=True) if found else ((),) * 10
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "doc_key")]
            yield pa.record_batch([*ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in _SPAN_SCHEMA.split(", ")])

    return rows


def _with_lexicon(spans: DataFrame, names: DataFrame, any_given: bool, any_family: bool) -> DataFrame:
    """Spans with the votes of the name lists; names that only the bitmap proposed are dropped."""
    own = spans.filter("kind = 'name'")
    pairs = own.groupBy("first", "last").agg(F.count(F.lit(1)).alias("n"))
    listed = lambda role, column: names.filter(F.col("role") == role).select(F.col("name").alias(column), F.lit(True).alias(role))
    judged = pairs.join(listed("given", "first"), "first", "left").join(listed("family", "last"), "last", "left").select("first", "last", "n", F.coalesce("given", F.lit(False)).alias("given"), F.coalesce("family", F.lit(False)).alias("family"))
    met = spread_join(own, judged.drop("n"), judged.select("first", "last", "n"), ["first", "last"], "n", "doc_id").filter("given OR NOT listed")
    lexicon = F.concat(F.when(F.col("given"), "+").otherwise("-" if any_given else "0"), F.when(F.col("family") & F.lit(any_family), "+").otherwise("0"))
    columns = ["doc_id", "doc_key", "kind", "start", "end", "found_text", "form"]
    return spans.filter("kind <> 'name'").select(*columns, "votes").unionByName(met.select(*columns, F.concat(F.substring("votes", 1, 3), lexicon).alias("votes")))


def aggregate_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability of each vote pattern (n x labelers, in -1, 0, 1) by expectation-maximisation.

    Labelers are independent given the class; each has its own table of votes per class,
    smoothed towards a labeler that is right in four of five votes.
    """
    weight = counts / counts.sum() * min(counts.sum(), 1e6)
    belief = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
    prior_votes = np.array([[0.32, 0.5, 0.18], [0.1, 0.5, 0.4]]) * max(20.0, 0.02 * weight.sum())  # class x vote
    for _ in range(rounds):
        by_class = np.stack([weight * (1 - belief), weight * belief])
        share = (by_class.sum(axis=1) + 1) / (weight.sum() + 2)
        score = np.log(share)[:, None].repeat(len(patterns), axis=1)
        for labeler in patterns.T:
            table = prior_votes.copy()
            for vote in (-1, 0, 1):
                table[:, vote + 1] += by_class[:, labeler == vote].sum(axis=1)
            table /= table.sum(axis=1, keepdims=True)
            score += np.log(table[:, labeler + 1])
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return belief


def span_classifier(patterns: np.ndarray, forms: np.ndarray, counts: np.ndarray, belief: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Scores of a logistic model over single votes and the parts of the form, fitted to the aggregated beliefs."""
    votes = [np.stack([c == -1, c == 1], axis=1) for c in patterns.T]
    shapes = [c[:, None] == np.arange(1, 4) for c in forms.T]
    x = np.concatenate([np.ones((len(patterns), 1)), *votes, *shapes], axis=1).astype(float)
    weight = np.sqrt(counts) / np.sqrt(counts).sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - belief)) + 1e-4 * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-x @ w))


def accepted_patterns(spans: DataFrame) -> set[tuple[str, str, str]]:
    """(kind, votes, form) that the classifier takes for personal information."""
    rows = spans.groupBy("kind", "votes", "form").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 5 * 3^5 * 108 rows
    out = set()
    for kind in KINDS:
        own = sorted((r["votes"], r["form"], r["n"]) for r in rows if r["kind"] == kind)
        if own:
            patterns = np.array([["-0+".index(v) - 1 for v in votes] for votes, _, _ in own])
            forms = np.array([[int(c) for c in form] for _, form, _ in own])
            counts = np.array([n for _, _, n in own], dtype=float)
            distinct, at = np.unique(patterns, axis=0, return_inverse=True)
            belief = aggregate_votes(distinct, np.bincount(at.ravel(), weights=counts))[at.ravel()]
            score = span_classifier(patterns, forms, counts, belief)
            out |= {(kind, votes, form) for (votes, form, _), s in zip(own, score, strict=True) if s >= 0.5}
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("doc_key"))


def find_personal(documents: DataFrame, tables: WorkTables) -> DataFrame:
    """Accepted spans ``doc_id, doc_key, kind, start, end, found_text``.

    ``doc_key`` is a hash of id and text (``_keyed``), so documents without an id, or with the
    same one, are told apart.  ``start`` and ``end`` count characters of the whole text from 0.  Null and empty texts
    give no rows; a table without candidates gives none.  Every document is read whole.
    """
    spark = documents.sparkSession
    narrow = _keyed(documents)
    names = tables.save(gazetteer(narrow), "names")
    shared = spark.sparkContext.broadcast(_bitmap(names.filter("role = 'given'")))
    found = tables.save(narrow.mapInArrow(_spans(shared), _SPAN_SCHEMA), "found")
    roles = {r["role"] for r in names.select("role").distinct().collect()}  # at most two rows
    spans = tables.save(_with_lexicon(found, names, "given" in roles, "family" in roles), "spans")
    kept = spark.createDataFrame(sorted(accepted_patterns(spans)), "kind string, votes string, form string")  # at most 5 * 3^5 * 108 rows
    return spans.join(F.broadcast(kept), ["kind", "votes", "form"]).select("doc_id", "doc_key", "kind", "start", "end", "found_text")


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with ``[KIND]`` in place of each span; of overlapping spans the first, then longest, counts."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, redacted, n_spans``: every text with typed placeholders; other text stays as it is.

    Each document meets the list of its own spans.  Null texts stay null.
    """
    lists = spans.groupBy("doc_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("spans"))  # one document's
    joined = _keyed(documents).join(lists, "doc_key", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[(s["kind"], s["start"], s["end"]) for s in spans or ()] for spans in batch.column("spans").to_pylist()]
            redacted = pa.array([redact_text(t, s) if t is not None else None for t, s in zip(batch.column("text").to_pylist(), own, strict=True)], pa.string())
            yield pa.record_batch([batch.column("doc_id"), redacted, pa.array([len(s) for s in own], pa.int32())], names=["doc_id", "redacted", "n_spans"])

    return joined.mapInArrow(rows, "doc_id bigint, redacted string, n_spans int")
