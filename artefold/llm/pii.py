"""Personal information in free text: mentions and redaction.

One Aho-Corasick pass finds anchors: at-signs in all their spellings, cues of
identity numbers, words of streets and cues of names; starts of digit runs are
the anchors of phone numbers.  From each anchor a local parser expands to both
sides and validates what it found.  A document is never cut.

Names are known by form: given name or initial with family name, in either
order.  Beside a cue (``Author:``, ``cc``, ``wrote``, ``Dr.`` ...) or joined to
such a name a form is a name.  Elsewhere it is one if the corpus shows it: its
given and its family name each stand beside cues in at least ``least_share`` of
the documents that hold them in such a form, whichever names they are combined
with.  So words that begin sentences or make up titles are none, and there is
no list of names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artefold.session import written

# What may stand before a family name.
PARTICLES = r"(?:(?:van|von|de|del|della|der|den|di|da|do|dos|du|la|le|las|los|ten|ter|zu|zur|VAN|VON|DE|DEL|DER|DEN|LA|LE)[  ])*"
# Cues before a name.
NAME_CUES = (
    "author", "reporter", "assignee", "reviewer", "approver", "maintainer", "committer", "signed-off-by", "reviewed-by", "acked-by", "tested-by", "reported-by", "co-authored-by",
    "suggested-by", "cc", "assigned to", "reviewed by", "reviewed with", "approved by", "written by", "reported by", "opened by", "merged by", "signed by", "received by", "on behalf of",
    "attn", "ping", "todo(", "fixme(", "contacter", "avisar a", "rückfragen an", "empfang durch", "ansprechpartner", "reçu par", "a nombre de", "mr.", "mrs.", "ms.", "dr.", "prof.",
    "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "sr.", "sra.",
)
# Cues before a name if a colon, an equals sign or a quote follows.
FIELD_CUES = ("user", "owner", "contact", "name", "login", "by", "from", "to")
# What only people do, behind a name.
VERBS = r"(?:wrote|said|says|asked|replied|commented|reviewed|approved|reported|confirmed|suggested|noted|schrieb|fragte|sagte|bat|a écrit|a demandé|escribió|preguntó|dijo)"
# Words before an initial with a family name.
BEFORE_INITIAL = r"(?:by|with|from|for|to|and|via|ask|von|mit|für|an|und|par|avec|pour|et|por|con|para|y)"
# Cues of identity numbers.
ID_CUES = (
    "ssn", "social security", "tax id", "taxpayer id", "itin", "passport", "travel document", "dni", "nif", "nie", "nir", "numéro de sécu", "numero de secu",
    "sécurité sociale", "ni number", "national insurance", "nino", "steuer-id", "steueridentifikationsnummer", "sozialversicherungsnummer", "reisepass",
    "personalausweis", "pasaporte", "passeport", "seguridad social", "driver's license", "driving licence", "national id", "identity card",
)
# Spellings of the at-sign.
AT_SIGNS = ("@", "＠", "%40", "&#64;", "&commat;", "(at)", "[at]", "{at}", "<at>", " at ", "\\u0040")
# Words of street names.
ENGLISH_STREETS = "street st road rd avenue ave boulevard blvd lane ln drive dr court ct terrace ter mews crescent close way place pl square sq row gardens grove walk parade wharf yard circle cir parkway pkwy highway hwy trail rise vale gate hill quay passage loop".split()
GERMAN_ENDINGS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ufer", "ring", "steig", "graben", "stieg")
GERMAN_HEADS = ("am ", "an der ", "an den ", "auf dem ", "auf der ", "im ", "in der ", "zum ", "zur ", "unter den ", "hinter der ")
FRENCH_STREETS = "rue avenue boulevard place allée allee chemin impasse quai cours route square passage sentier faubourg villa esplanade".split()
SPANISH_STREETS = ("c/", "calle", "plaza", "pza", "avda", "avenida", "paseo", "camino", "ronda", "travesía", "carrer", "glorieta", "cuesta")

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_ZERO = "​‌‍⁠﻿­"
_SP = r"[   \t]"
_FAMILY = rf"(?:[{_UP}]['’])?[{_UP}][{_UP}{_LOW}]+(?:[-'’][{_UP}][{_UP}{_LOW}]+)*"
_GIVEN = rf"(?:[{_UP}][{_LOW}]+|[{_UP}]{{2,}})(?:-(?:[{_UP}][{_LOW}]+|[{_UP}]{{2,}}))*"
_EDGE = rf"(?![\w{_LOW}])"
_NAMES = tuple(
    re.compile(p)
    for p in (
        rf"{PARTICLES}(?P<family>{_FAMILY}),{_SP}(?P<given>{_GIVEN})(?:{_SP}[{_UP}]\.)?{_EDGE}",
        rf"{PARTICLES}(?P<family>{_FAMILY}),{_SP}[{_UP}]\.(?!{_SP}?[{_UP}]){_EDGE}",
        rf"(?P<given>{_GIVEN})(?:{_SP}[{_UP}]\.)?{_SP}{PARTICLES}(?P<family>{_FAMILY}){_EDGE}",
        rf"[{_UP}]\.(?:{_SP}?[{_UP}]\.)?{_SP}?{PARTICLES}(?P<family>{_FAMILY}){_EDGE}",
    )
)
_START = re.compile(rf"(?<![\w/\\@.'’-])[{_UP}]")
_BEFORE_FAMILY = re.compile(rf"(?<![\w'’.-])(?:(?:van|von|de|del|della|der|den|di|da|do|dos|du|la|le|las|los|ten|ter|zu|zur){_SP})+\Z")
_CUED = re.compile(r"[\s\"'“«:=(]*")
_FIELD = re.compile(r"\"?\s*[:=]\s*[\"'“«]?\s*|[\"'“«]")
_VERB = re.compile(rf"{_SP}{VERBS}\b")
_JOINED = re.compile(r"(?:,? (?:and|und|et|y) |, | & |/)\Z")
_BEFORE = re.compile(rf"(?:\b{BEFORE_INITIAL}{_SP}|[|(\"])\Z")
_LABEL = re.compile(r"(?:[a-zé]*\.?)(?:[  ]*(?:no|nr|n[º°]|num|number|nummer|numéro|número|id|card|sociale)\b\.?)*[  ]*(?:\(?(?:is|was|ist|es|est|war)\b|[=:#])*[  \"']*", re.I)
_IDS = re.compile(
    r"(?:[12][ .]?\d{2}[ .]?(?:0[1-9]|1[0-2]|[2-9]\d)[ .]?(?:\d{2}|2[AB])[ .]?\d{3}[ .]?\d{3}(?:[ .]?\d{2})?"  # French
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # British
    r"|\d{3}[- ]\d{2}[- ]\d{4}"  # American
    r"|[XYZ]?-?\d{7,8}[- ]?[A-Z]"  # Spanish
    r"|[A-Z]{1,2}\d{6,9}"  # passports
    r"|\d{2} \d{3} \d{3} \d{3}|\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3}|\d{9,11})(?![\w])"
)
_DIGITS = re.compile(r"(?<![\w.,/@:#-])(?:\+|\()?\d|(?<=[=:])\+?\(?\d")
_PHONES = re.compile(
    r"(?:"
    r"(?:\+|00)1[ .-]?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}"
    r"|1[ .-]\(?[2-9]\d{2}\)?[ .-][2-9]\d{2}[ .-]\d{4}"
    r"|\([2-9]\d{2}\) ?[2-9]\d{2}[ .-]\d{4}"
    r"|[2-9]\d{2}([ .-])[2-9]\d{2}\1\d{4}"
    r"|(?:\+|00)44[ .-]?(?:\(0\)[ ]?)?\d{2,4}[ .-]?\d{3,4}[ .-]?\d{3,6}"
    r"|0(?:20[ .-]?\d{4}|7\d{3}[ .-]?\d{3}|1\d{2,3}[ .-]\d{3})[ .-]?\d{3,4}"
    r"|\(0\d{2,5}\)[ ]?\d{3,8}(?:[ /-]\d{1,6})*"
    r"|(?:\+|00)49[ .-]?(?:\(0\)[ ]?)?[1-9]\d{1,4}[ ./-]?\d{3,8}(?:[ -]\d{1,5})?"
    r"|0[2-9]\d{1,4}[ /-]\d{3,8}(?:[ -]\d{1,5})?"
    r"|(?:\+|00)33[ .-]?(?:\(0\)[ ]?)?[1-9](?:[ .-]?\d{2}){4}"
    r"|0[1-9]([ .-]?)\d{2}(?:\2\d{2}){3}"
    r"|(?:\+|00)34[ .-]?[6-9]\d{2}[ .-]?\d{2,3}[ .-]?\d{2,3}[ .-]?\d{0,3}"
    r"|(?:\+|00)[1-9]\d{0,2}[ .-]\d{1,4}(?:[ .-]\d{2,4}){2,4}"
    r")(?![\w@])(?!\.\d)"
)
_IN_LOCAL = "_.+'’-" + _ZERO
_DOMAIN = re.compile(rf"[ {_ZERO}]*(\w(?:[\w{_ZERO}-]*\w)?(?:(?:[ ]?(?:\.|\[dot\]|\(dot\)|\{{dot\}})[ ]?|[ ]dot[ ])\w(?:[\w-]*\w)?)+)", re.I)
_CAP = rf"[{_UP}][\w'’-]*"
_GAP = r"(?:[   \t]+|[   \t]*\r?\n(?!\s*\n)[>|#* \t]*)"  # within a line, or over one line end
_UNIT = rf"(?:flat|unit|apt\.?|apartment|suite|ste\.?|room|studio)[ ]*#?\w+,?{_GAP}"
_ENGLISH = re.compile(
    rf"(?<![\w.,#/-])(?:(?i:{_UNIT}))?\d{{1,5}}[A-Za-z]?{_GAP}(?:[NSEW]\.?{_GAP})?(?:{_CAP}{_GAP}){{1,4}}(?:{'|'.join(f'{w.capitalize()}|{w.upper()}' for w in ENGLISH_STREETS)})\b\.?"
)
_GERMAN = re.compile(
    rf"(?<![\w-])(?:(?:{_CAP}{_GAP}){{0,2}}(?:[{_UP}][\w-]*(?i:{'|'.join(re.escape(e) for e in GERMAN_ENDINGS)})|(?:Allee|Platz|Ring|Damm|Weg|Straße|Strasse|Str\.|ALLEE|PLATZ|RING|DAMM|WEG|STRASSE))"
    rf"|(?i:{'|'.join(h.strip().replace(' ', chr(92) + 's+') for h in GERMAN_HEADS)}){_GAP}{_CAP}(?:{_GAP}{_CAP})?){_GAP}\d{{1,4}}[ ]?[a-z]?(?!\w)"
)
_FRENCH = re.compile(rf"(?<![\w.,#/-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[A-D])\b)?,?{_GAP}(?i:{'|'.join(FRENCH_STREETS)}){_GAP}(?:(?i:de|du|des|la|le|les|l['’]|d['’]){_GAP}?)*{_CAP}(?:[ ]{_CAP})*")
_SPANISH = re.compile(
    rf"(?<![\w-])(?i:c/|(?:{'|'.join(s for s in SPANISH_STREETS if s != 'c/')})\b\.?){_GAP}?(?:(?i:de|del|la|las|los|el|y){_GAP})*{_CAP}(?:{_GAP}(?:(?i:de|del|la|las|los|el|y){_GAP})*{_CAP})*,?{_GAP}(?i:n[.º°úum]*[ ]*)?\d{{1,4}}(?!\d)"
)
#: What may follow the street: unit, floor, postcode with town, town with postcode.
_TAIL = re.compile(
    rf"(?:,?{_GAP}(?:#[ ]?\d+|(?i:{_UNIT.split('[ ]*')[0]})[ ]*#?\w+|\d{{1,2}}\.?[ºª](?:[ ][A-Z]\b)?|(?i:bajo|ático|entlo)\b\.?|[A-Z](?=,)))*"
    rf"(?:,?{_GAP}(?:\d{{5}}{_GAP}{_CAP}|{_CAP}(?:[ ]{_CAP})?{_GAP}[A-Z]{{1,2}}\d[A-Z\d]?[ ]\d[A-Z]{{2}}\b))?"
)
PRIORITY = {"id_number": 0, "email": 1, "phone": 2, "address": 3, "name": 4}


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).replace("ø", "o")


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, set[str]] = {}
    for kind, words in (
        ("cue", NAME_CUES),
        ("field", FIELD_CUES),
        ("id", ID_CUES),
        ("email", AT_SIGNS),
        ("english", [f" {w}" for w in ENGLISH_STREETS]),
        ("german", GERMAN_ENDINGS + GERMAN_HEADS),
        ("french", [f" {w} " for w in FRENCH_STREETS]),
        ("spanish", SPANISH_STREETS),
    ):
        for w in words:
            found.setdefault(w, set()).add(kind)
    automaton = ahocorasick.Automaton()
    for w, kinds in found.items():
        automaton.add_word(w, (len(w), tuple(sorted(kinds))))
    automaton.make_automaton()
    return automaton


_CACHE: list[ahocorasick.Automaton] = []


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(text: str, a: int, b: int) -> bool:
    return not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))


def _email(text: str, a: int, b: int, sign: str) -> tuple[int, int] | None:
    spaced = sign.strip() in ("(at)", "[at]", "{at}", "<at>")
    left = a
    while spaced and left and text[left - 1] in "  ":
        left -= 1
    start = left
    while start and (text[start - 1].isalnum() or text[start - 1] in _IN_LOCAL):
        start -= 1
    domain = _DOMAIN.match(text, b if sign != " at " else b - 1)
    if start == left or not domain or not (text[left - 1].isalnum() or text[left - 1] in "_+-" + _ZERO):
        return None
    if sign == " at " and not re.search(r"[ \[({]dot\b", domain[1], re.I):
        return None
    if not spaced and sign != " at " and text[b : b + 1].isspace():
        return None
    while text[start] in _ZERO + "'’-.+":
        start += 1
        if start >= left:
            return None
    last = re.split(r"\.|dot|\W", domain[1])[-1]
    if not re.fullmatch(r"[^\W\d_]{2,24}", last):
        return None
    before = text[max(0, start - 3) : start]
    if before.endswith("//") or re.match(r":(?!\d*(?:\s|$))[\w~/.-]", text[domain.end() :]):
        return None  # the login of a remote
    return start, domain.end(1)


def _street(text: str, a: int, kind: str) -> tuple[int, int] | None:
    """The address whose street word stands at ``a``: it begins at one of the ten words before, or at ``a``."""
    pattern = {"english": _ENGLISH, "german": _GERMAN, "french": _FRENCH, "spanish": _SPANISH}[kind]
    starts, i = [a], a
    while i and len(starts) < 11 and text[i - 2 : i] != "\n\n":
        i -= 1
        if not text[i].isspace() and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            starts.append(i)
    for i in reversed(starts):
        m = pattern.match(text, i)
        if m and m.start() <= a + 1 <= m.end():
            return m.start(), _TAIL.match(text, m.end()).end()
    return None


_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: the control letters of Spanish numbers


def _valid_id(found: str, cue: str) -> bool:
    """Control letters, control digits and ranges that are never given out."""
    plain = re.sub(r"[ .-]", "", found)
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", plain) and len(plain) == 9:
        digits = plain[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
        return _DNI_LETTERS[int(digits) % 23] == plain[-1]
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", found):
        return plain[:3] not in ("000", "666") and plain[3:5] != "00" and plain[5:] != "0000"
    if "steuer" in cue and re.fullmatch(r"\d{11}", plain):
        rest = 10
        for d in plain[:10]:
            rest = ((int(d) + rest) % 10 or 10) * 2 % 11
        return (11 - rest) % 10 == int(plain[10])
    return True


class _Spans:
    """Spans that do not overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.rows: list[tuple] = []

    def is_free(self, row: tuple) -> bool:
        """Whether ``row``, (type, start, end, ...), overlaps none that is kept."""
        at = bisect_left(self.starts, row[1])
        return not ((at and self.rows[at - 1][2] > row[1]) or (at < len(self.rows) and self.rows[at][1] < row[2]))

    def add(self, row: tuple) -> bool:
        """Keeps ``row`` if it is free."""
        if not self.is_free(row):
            return False
        at = bisect_left(self.starts, row[1])
        self.starts.insert(at, row[1])
        self.rows.insert(at, row)
        return True


def _token(name: str | None) -> str | None:
    """A name as it is compared: without accents, in lower case; of double given names the first."""
    return _plain(name.split("-")[0]).casefold() if name else None


def scan(text: str | None) -> list[tuple[str, int, int, str | None, str | None, bool]]:
    """(type, start, end, given, family, sure) in order of place, 0-based.

    Sure mentions do not overlap; where two did, the order of types is
    identity number, e-mail, phone, address, name, and of one type the
    earlier, then the longer one stays.  Those not sure have the form of a
    name, and may overlap each other.  ``given`` and ``family`` are for
    comparing; an initial is no given name.  Null and blank texts have none.
    """
    if not isinstance(text, str) or not text.strip():
        return []
    if not _CACHE:
        _CACHE.append(_automaton())
    found: set[tuple[str, int, int]] = set()
    cued: set[int] = set()
    for last, (size, kinds) in _CACHE[0].iter(_lower(text)):
        a, b = last - size + 1, last + 1
        for kind in kinds:
            label, span = "address", None
            if kind == "email":
                span, label = _email(text, a, b, text[a:b].lower()), "email"
            elif kind in ("cue", "field"):
                open_end = text[b - 1] in "(." or not (b < len(text) and (text[b].isalnum() or text[b] == "_"))
                if open_end and not (a and (text[a - 1].isalnum() or text[a - 1] == "_")):
                    after = (_CUED if kind == "cue" else _FIELD).match(text, b)
                    if after and (after.end() > b or text[b - 1] == "("):
                        cued.add(after.end())
            elif kind == "id":
                label = "id_number"
                if not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and text[b].isalnum()):
                    m = _IDS.match(text, _LABEL.match(text, b).end())
                    span = m and _valid_id(m[0], text[a:b].lower()) and m.span()
            else:
                span = _street(text, a, kind)
            if span:
                found.add((label, *span))
    for m in _DIGITS.finditer(text):
        p = _PHONES.match(text, m.start())
        if p and sum(c.isdigit() for c in p[0]) >= 8:
            found.add(("phone", p.start(), p.end()))
    kept, maybe, ends = _Spans(), [], set()
    for label, a, b in sorted(found, key=lambda x: (PRIORITY[x[0]], x[1], -x[2])):
        kept.add((label, a, b, None, None, True))
    for a in sorted(cued | {m.start() for m in _START.finditer(text)}):
        for k, pattern in enumerate(_NAMES):
            m = pattern.match(text, a)
            if not m or len(m["family"]) < 3:
                continue
            start = a
            if k < 2 and a not in cued:
                before = _BEFORE_FAMILY.search(text, max(0, text.rfind("\n", 0, a)), a)
                start = max([before.start() if before else a, *[c for c in cued if before and before.start() < c <= a]])
            initial = "given" not in m.groupdict()
            if initial and re.search(r"\d[A-Za-z]?[  ]\Z", text[max(0, a - 3) : a]):
                continue
            joined = _JOINED.search(text, max(0, start - 6), start)
            sure = bool(start in cued or a in cued or _VERB.match(text, m.end()) or (joined and joined.start() in ends) or (initial and len(m["family"]) > 3 and _BEFORE.search(text, max(0, start - 6), start)))
            row = ("name", start, m.end(), None if initial else _token(m["given"]), _token(m["family"].replace("-", "")), sure)
            if sure and kept.add(row):
                ends.add(m.end())
            elif not sure:
                maybe.append(row)
            break
    return sorted(kept.rows + [r for r in maybe if kept.is_free(r)], key=lambda x: x[1])


def resolved(rows: list[tuple]) -> list[tuple]:
    """``rows`` without those that overlap a sure one, or one not sure that is earlier or longer."""
    kept = _Spans()
    for r in sorted(rows, key=lambda x: (not x[5], x[1], -x[2])):
        kept.add(r)
    return kept.rows


def mentions(text: str | None, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(type, start, end) of all mentions of a text by itself; ``given`` and ``family`` are names known to be some."""
    return [r[:3] for r in resolved([r for r in scan(text) if r[5] or (r[4] in family and (r[3] is None or r[3] in given))])]


def redacted(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """``text`` with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]`` for each mention; null stays null."""
    if not isinstance(text, str):
        return None
    out, at = [], 0
    for label, a, b in mentions(text) if spans is None else spans:
        out += [text[at:a], f"[{label.upper()}]"]
        at = b
    return "".join(out) + text[at:]


SCANNED = "pii_type string, start_char bigint, end_char bigint, given string, family string, sure boolean"


def _spans(documents: DataFrame, id_col: str, text_col: str, least_share: float) -> DataFrame:
    """``__row, __id, __text_hash, pii_type, start_char, end_char``: the mentions of every row.

    A first pass finds sure mentions and forms of names; the given and family
    names of the sure ones, counted over all documents, decide on the forms
    in a join.  Rows are told apart by a number that is written with them.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, i, h, r[0], r[1] + 1, *r[2:]) for n, i, h, text in zip(pdf["__row"], pdf["__id"], pdf["__text_hash"], pdf["__text"]) for r in scan(text)]
            yield pd.DataFrame(rows, columns=["__row", "__id", "__text_hash", "pii_type", "start_char", "end_char", "given", "family", "sure"])

    source = documents.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__text_hash"), F.col(text_col).alias("__text")).filter("__text is not null and __id is not null")
    scanned = written(source.mapInPandas(run, f"__row bigint, __id {kind}, __text_hash bigint, {SCANNED}"), "pii-scanned")
    named = scanned.filter("pii_type = 'name'").select("given", "family", "sure", "__text_hash").distinct()
    seen = F.count_if(F.col("sure") & F.col("given").isNotNull())
    known = lambda c: named.groupBy(c).agg(seen.alias("n"), F.count("*").alias("of")).filter((F.col("n") > 0) & (F.col("n") >= least_share * F.col("of"))).select(c)
    forms = scanned.filter("not sure").join(known("family"), "family", "left_semi")
    forms = forms.filter("given is null").unionByName(forms.filter("given is not null").join(known("given"), "given", "left_semi"))
    taken = written(forms.select(*scanned.columns), "pii-forms")
    # forms never overlap sure mentions; only documents whose forms overlap each other have to be resolved
    before = F.max("end_char").over(Window.partitionBy("__row").orderBy("start_char", "end_char").rowsBetween(Window.unboundedPreceding, -1))
    clashing = taken.withColumn("__before", before).filter("start_char <= __before").select("__row").distinct()
    mixed = taken.join(clashing, "__row", "left_semi")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["pii_type"], pdf["start_char"], pdf["end_char"] + 1, pdf["given"], pdf["family"], pdf["sure"]))
        kept = {(r[1], r[2] - 1) for r in resolved(rows)}
        return pdf[[(a, b) in kept for a, b in zip(pdf["start_char"], pdf["end_char"])]]

    result = scanned.filter("sure").unionByName(taken.join(clashing, "__row", "left_anti").select(*scanned.columns)).unionByName(mixed.groupBy("__row").applyInPandas(resolve, mixed.schema).select(*scanned.columns))
    return result.select("__row", "__id", "__text_hash", "pii_type", "start_char", "end_char")


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.05) -> DataFrame:
    """One row for each mention: the id, ``pii_type``, ``start_char`` (1-based), ``end_char`` (of its last character).

    Rows with a null id or text have none; repeated rows are each their own.
    """
    return _spans(documents, id_col, text_col, least_share).select(F.col("__id").alias(id_col), "pii_type", "start_char", "end_char")


def redact(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.05) -> DataFrame:
    """The id and the text with placeholders, one row for each document; rows with a null id keep their text."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        found = [[] if x is None else [(r["pii_type"], r["start_char"] - 1, r["end_char"]) for r in x] for x in spans]
        return pd.Series([redacted(t, sorted(x, key=lambda r: r[1])) for t, x in zip(texts, found)])

    spans = _spans(documents, id_col, text_col, least_share).select("__id", "__text_hash", F.struct("start_char", "end_char", "pii_type").alias("span")).distinct()
    held = spans.groupBy("__id", "__text_hash").agg(F.collect_list("span").alias("spans"))
    rows = documents.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__text_hash"), F.col(text_col).alias("__text"))
    return rows.join(held, ["__id", "__text_hash"], "left").select(F.col("__id").alias(id_col), clean("__text", "spans").alias(text_col))
