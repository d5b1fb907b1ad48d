"""Personal information in free text: found, listed, and replaced by typed placeholders or by surrogates.

Detectors run in a fixed order and each masks what it has found, so that a name inside an address or an email isn't found
again: emails (disguised ones too), street addresses, identity numbers, phone numbers, names of persons. Numbers count by the
shape of their kind, and by a word that says so where the shape alone could be an order or a part number. Names count by a word
that introduces a person, or by the known name parts together with a model of family-name endings that is fitted on them.

Surrogates are keyed permutations (`Surrogates`): the letters and digits of an item number it within the space of all items of
its kind, script and format, and a Feistel network with that key permutes the space in one cycle. So nothing stands for itself,
two items never share a surrogate in any two documents, and every spelling of one item gets the same one, all without any state
between texts. Names are replaced part by part; a part's first letter alone decides the first letter of its surrogate, so that
initials agree with names, and a soft ending, which is what the known names tell of gender, stays.

Every document is handled where it is read, by one pass that gives the items with their placeholders and surrogates. Only the
known name parts are sent to the executors; their number is checked.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name parts that may be sent to the executors.
NAMES_MOST = 1_000_000
#: An ending is one of family names if so many known ones share it.
ENDING_LETTERS, ENDING_SUPPORT = (3, 4, 5, 6), 5
#: How far before a number the word that explains it may stand.
NEAR = 48
BATCH_CHARS = 4_000_000

L = r"A-Za-zÀ-ÖØ-öø-žß"
EDGE, STOP = rf"(?<![{L}0-9_])", rf"(?![{L}0-9_])"

# --- emails
LOCAL = rf"[{L}0-9](?:[{L}0-9._%+'\-]*[{L}0-9_+\-])?"
LABEL = rf"[{L}0-9](?:[{L}0-9\-]*[{L}0-9])?"
DOT_WORD = r"(?:\s*[\(\[\{]\s*(?:dot|punkt|point|punto|punt)\s*[\)\]\}]\s*|\s+dot\s+)"
DOT = rf"(?:\.|{DOT_WORD})"
AT_WORD = r"\s*[\(\[\{]\s*(?:at|ät|arroba|arobase|@)\s*[\)\]\}]\s*"
BEFORE_EMAIL, AFTER_EMAIL = rf"(?<![{L}0-9._%+\-@/])", rf"(?![{L}0-9_\-])"
# Each with what a text must have to hold it: one of the texts, in lower case, and the pattern.
AT_SIGN = re.compile(r"[\(\[\{]\s*(?:at|ät|arroba|arobase|@)\s*[\)\]\}]", re.I)
EMAILS = [
    (("@",), None, re.compile(rf"{BEFORE_EMAIL}{LOCAL}(?:@|\s@\s){LABEL}(?:\.{LABEL})*\.[{L}]{{2,}}{AFTER_EMAIL}")),
    (("(", "[", "{"), AT_SIGN, re.compile(rf"{BEFORE_EMAIL}{LOCAL}{AT_WORD}{LABEL}(?:{DOT}{LABEL})*{DOT}[{L}]{{2,}}{AFTER_EMAIL}", re.I)),
    (("dot", "punkt", "point", "punt"), re.compile(r"\sat\s", re.I), re.compile(rf"{BEFORE_EMAIL}{LOCAL}\s+at\s+{LABEL}(?:{DOT_WORD}{LABEL})*{DOT_WORD}[{L}]{{2,}}{AFTER_EMAIL}", re.I)),
]
# Endings of file names, which are no domains.
FILES = re.compile(r"\.(?:png|jpe?g|gif|webp|svg|avif|ico|css|js|json|html?|php|pdf|zip|gz|xml|txt|md|ya?ml|mp4|woff2?)$", re.I)

# --- street addresses
UNIT = r"(?:(?:\s*,\s*|\s+)(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|No\.?)\s+(?:\d+[A-Za-z]?|[A-Z])(?!\w)|\s*,?\s*#\s?\d+[A-Za-z]?(?!\w))?"
CAP = rf"[A-ZÀ-ÖØ-Þ][{L}'’\-]*"
NUMBER = r"\d{1,5}(?:\s?[-–/]\s?\d{1,5})?(?:[a-z](?!\w)|\s[a-h](?=\s(?:in|and|und|en|et|y)\s|\s*[,;.()\n]|\s*$|\s+[A-ZÀ-Þ]))?"
EN_TYPE = r"(?:Street|Road|Avenue|Lane|Drive|Court|Boulevard|Close|Place|Square|Terrace|Crescent|Gardens|Grove|Hill|Way|Mews|Parade|Row|Walk|Quay|(?:St|Rd|Ave|Ln|Dr|Ct|Blvd|Pl|Sq|Terr|Cres)(?:\.(?!\w)|(?![\w.])|(?=\.)))"
# Of each form's words a text must have one; the forms name the same words.
STREETS_EN = ("Street", "Road", "Avenue", "Lane", "Drive", "Court", "Boulevard", "Close", "Place", "Square", "Terrace", "Crescent", "Gardens", "Grove", "Hill", "Way", "Mews", "Parade", "Row", "Walk", "Quay", "St", "Rd", "Ave", "Ln", "Dr", "Ct", "Blvd", "Pl", "Sq", "Terr", "Cres")
STREETS_FR = ("rue", "avenue", "boulevard", "impasse", "chemin", "allée", "place", "quai", "cours", "route", "passage", "square", "sentier", "faubourg")
STREETS_ES = ("Calle", "C/", "Avenida", "Avda", "Av.", "Plaza", "Pza", "Paseo", "Camino", "Ronda", "Travesía", "Carrera", "Glorieta")
STREETS_DE = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig", "pfad", "chaussee", "straat", "laan", "dreef", "werf", "plein", "gracht", "kade", "singel", "steeg", "hof", "dijk", "pad", "markt")
STREETS_WORDS = ("Straße", "Strasse", "Str.", "Weg", "Gasse", "Platz", "Allee", "Ufer", "Damm", "Ring", "Laan", "Plein", "Kade")
STREETS_AT = ("Am", "An", "Im", "In", "Zum", "Zur", "Auf", "Unter", "Hinter", "Vor")
ADDRESSES = [
    (STREETS_EN, re.compile(rf"{EDGE}\d{{1,5}}(?:[a-z]|\s?[-–]\s?\d{{1,5}})?\s+(?:{CAP}\s+){{1,3}}{EN_TYPE}(?![\w])(?!\s+[A-Z][a-z]+s\s){UNIT}")),
    (STREETS_FR, re.compile(rf"{EDGE}\d{{1,5}}(?:\s?(?:bis|ter|quater))?\s*,?\s+(?:rue|avenue|boulevard|impasse|chemin|allée|place|quai|cours|route|passage|square|sentier|ruelle|faubourg)\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|d['’])\s*)?{CAP}(?:\s+{CAP}(?!\s*[:.]))?")),
    (STREETS_ES, re.compile(rf"{EDGE}(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía|Carrera|Glorieta)\s+(?:(?:de\s+(?:los|las|la)|del|de)\s+)?{CAP}(?:\s+(?:(?:de\s+(?:los|las|la)|del|de)\s+)?{CAP})?\s*,?\s+(?:(?:nº|n\.º|n°|núm\.?|num\.)\s*)?{NUMBER}{UNIT}")),
    (STREETS_DE, re.compile(rf"{EDGE}(?:{CAP}-)?[A-ZÄÖÜ][{L}]{{2,}}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|pfad|chaussee|straat|laan|dreef|werf|plein|gracht|kade|singel|steeg|hof|dijk|pad|markt)\s+{NUMBER}{UNIT}")),
    (STREETS_WORDS, re.compile(rf"{EDGE}(?:[A-ZÄÖÜ][{L}]+(?:er|sche)?\s+)(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring|Laan|Plein|Kade)\s+{NUMBER}{UNIT}")),
    (STREETS_AT, re.compile(rf"{EDGE}(?:Am|An\s+de[rn]|Im|In\s+de[rn]|Zum|Zur|Auf\s+de[rmn]|Unter\s+den|Hinter\s+de[rmn]|Vor\s+de[rmn])\s+(?:[A-ZÄÖÜ][{L}]+(?:en|er|e)\s+)?[A-ZÄÖÜ][{L}]{{3,}}\s+{NUMBER}{UNIT}")),
]
# Streets in Cyrillic and Greek letters: the word for street, its name, and a number.
OTHER_LETTER, OTHER_CAP = re.compile("[\u0370-\u052f]"), "[Α-ΩΆ-ΏЀ-Я][α-ωά-ώа-џ]+"
OTHER_STREET = re.compile(rf"(?<!\w)(?:улица|ул\.|проспект|пр-т|переулок|пер\.|бульвар|площадь|οδός|οδ\.|λεωφόρος)\s+{OTHER_CAP}(?:\s+{OTHER_CAP})?\s*,?\s*(?:д\.\s*|дом\s+|αρ\.\s*)?\d{{1,4}}[а-гα-δ]?(?:\s*,?\s*кв\.\s*\d{{1,4}})?(?!\w)", re.I)
# The last form is a street only where something says so.
ADDRESS_SAID = re.compile(r"(?:address|adresse|anschrift|dirección|adres|lieferung an|visit us at|went to|live at|moved to|pick-up|ship to|deliver(?:ed)? to|wohne|besuchen sie uns|abholung)\s*:?\s*$", re.I)
POSTCODE = re.compile(r"\s*,\s*(?:\d{4,5}|[A-Z]{1,2}\d)|\s+(?:in\s+[A-Z]|\([A-Z])")

# --- identity numbers: shape, and the words that must stand near (None: the shape says enough)
SSN_SAID = r"\b(?:ssn|social\s+security|soc\.?\s*sec\.?)\b"
TAX_SAID = r"\b(?:steuer|tax|tin\b|idnr|itin|fiscal|nif\b|impôt|belasting|btw)|налог|ИНН"
IDS = [
    (re.compile(rf"{EDGE}\d{{3}}[- ]\d{{2}}[- ]\d{{4}}{STOP}|{EDGE}\d{{9}}{STOP}"), SSN_SAID),
    (re.compile(rf"{EDGE}[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z]\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D]{STOP}"), r"\b(?:national\s+insurance|ni\s+(?:no|number)|nino|insurance\s+(?:no|number))\b"),
    (re.compile(rf"{EDGE}QQ\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D]{STOP}"), None),
    (re.compile(rf"{EDGE}\d\s\d{{2}}\s\d{{2}}\s\d{{2}}\s\d{{3}}\s\d{{3}}\s\d{{2}}{STOP}"), None),
    (re.compile(rf"{EDGE}\d{{13}}(?:\s?\d{{2}})?{STOP}"), r"s[ée]cu(?:rité)?\b|\bnir\b"),
    (re.compile(rf"{EDGE}\d{{2}}\s\d{{3}}\s\d{{3}}\s\d{{3}}{STOP}|{EDGE}\d{{11}}{STOP}|{EDGE}\d{{2,3}}/\d{{3}}/\d{{4,5}}{STOP}|{EDGE}\d{{2}}\s\d{{6}}\s[A-Z]\s\d{{3}}{STOP}"), TAX_SAID + r"|sozialversicherung|rentenversicherung|versicherungsnummer"),
    (re.compile(rf"{EDGE}[XYZ]-?\d{{7}}-?[A-Z]{STOP}"), None),
    (re.compile(rf"{EDGE}\d{{8}}-?[A-Z]{STOP}"), r"\b(?:dni|nie|nif)\b|documento\s+(?:nacional|de\s+identidad)|identidad"),
    (re.compile(rf"{EDGE}(?:[A-Z]{{1,2}}\s?\d{{6,8}}|\d{{2}}[A-Z]{{2}}\d{{5}}|(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{{8,10}}|\d{{9}}){STOP}"), r"passport|reisepass|passeport|pasaporte|paspoort|паспорт|διαβατ|パスポート|جواز|personalausweis|ausweis|identity\s+card|id[\s-]card|carte\s+d['’]identité|identiteitskaart|\bbsn\b|\bcni\b|cédula"),
]

IDS = [(shape, said and re.compile(said, re.I)) for shape, said in IDS]
# What every shape of a number has: five digits with a sign between two of them at most, or eight letters and digits (the last
# shape); a phone number has nine digits with few signs between.
DIGIT, FIVE, EIGHT, NINE = re.compile(r"\d"), re.compile(r"\d(?:[\s/\-]?\d){4}"), re.compile(r"[A-Z0-9]{8}"), re.compile(r"\d(?:\D{0,5}\d){8}")
BREAK = re.compile(r"[\n\x00]|[.!?]\s(?=[A-Z])|\d{4,}|\d[\d\s\-]{4,}\d")
THEN = re.compile(r"\s+(?:is|was|=)\s[^\d\n.!?]{0,30}")

# --- phone numbers
G = r"[\s.\-]?"
PHONES = re.compile(
    EDGE.replace("_]", r"_+./\-]")
    + r"(?<!\d\s)(?:"
    + "|".join(
        [
            r"(?:\+49|0049)[\s\-/.]?(?:\(0\)\s?)?\d{2,4}[\s/\-](?:\d{6,8}(?:-\d{1,4})?|\d{3,5}[\s\-]\d{2,4})",
            r"\(?0\d{2,4}\)?(?:/|\s)(?:\d{6,8}(?:-\d{1,4})?|\d{5}[\s\-]\d{2,4})",
            rf"(?:(?:\+44|0044)\s?(?:\(0\)\s?)?|\(?0)(?:1\d{{3}}\)?\s?\d{{3}}\s?\d{{3}}|7\d{{3}}\s?\d{{3}}\s?\d{{3}}|2\d\)?{G}\d{{4}}{G}\d{{4}}|1\d{{2}}\)?{G}\d{{3}}{G}\d{{4}})",
            r"(?:(?:\+33|0033)[\s.]?(?:\(0\)\s?)?|0)[1-9](?:[\s.\-]?\d{2}){4}",
            r"(?:\+1[\s.\-]?|1[.\-\s])?(?:\(\d{3}\)\s?|\d{3}[.\-\s])\d{3}[.\-\s]\d{4}",
            r"\+1\d{10}",
            r"(?:\+34|0034)\s?\d{3}(?:\s?\d{2}){3}|(?:\+34|0034)\s?\d{3}\s?\d{3}\s?\d{3}",
            r"(?:\+31|0031)\s?(?:\(0\)\s?)?\d{1,3}[\s\-]?\d{3,4}\s?\d{3,4}",
            r"\+(?:7|81|30|20|9\d{1,2}|2\d{1,2}|3[0-9]{1,2}|4[0-9]{1,2}|5\d{1,2}|6\d|8\d{1,2})[\s.\-]?(?:\(\d{1,4}\)[\s.\-]?)?\d{1,4}(?:[\s.\-]\d{2,4}){1,4}",
        ]
    )
    + r")(?![\d])(?!-\d)(?!\.\d)"
)
PHONE_SAID = re.compile(r"(?:tel|tél|phone|telefon|teléfono|telefoon|whatsapp|fax|mobil|mobile|handy|call|number is|back on|ring|dial|电话|電話|тел|τηλ|هاتف)[^\d\n]{0,12}$", re.I)
PLAIN = re.compile(rf"{EDGE}(?:\+?\d{{10,13}}){STOP}")
NOT_PHONE = re.compile(r"(?:order|ticket|sku|part|gtin|isbn|version|build|invoice|article|art\.|ref\.?|no\.|№|model|rfc|iso)\s*(?:no\.?|nr\.?|number|#|:)?\s*$", re.I)

# --- names
NAME = rf"[A-ZÀ-ÖØ-Þ][{L}]*(?:['’](?!s\b)[{L}]+)?"
FULL = rf"{NAME}(?:-{NAME})?"
PARTICLE = r"(?:(?:van +de[nr]|von +de[nr]|van|von|vom|zu|de +la|de|del|della|di|da|dos|du|le|la|den|der|ten|ter|af|av|al|el|bin) +)"
INITIAL = r"(?:[A-ZÀ-ÖØ-Þ]\. ?){1,2}"
PERSON = re.compile(rf"(?<![{L}0-9_@/.\-])(?:{FULL} +(?:{INITIAL})?|{INITIAL}){PARTICLE}?{FULL}(?![{L}0-9_])")
PERSON_BACK = re.compile(rf"(?<![{L}0-9_@/.\-])(?P<f>{PARTICLE}?{FULL}), +(?P<g>{FULL}(?: +[A-ZÀ-ÖØ-Þ]\.)?|[A-ZÀ-ÖØ-Þ]\.)(?![{L}0-9_])")
# Where a name may begin: two capitalised words, an initial, or a word and a comma.
CANDIDATE = re.compile(rf"(?<![{L}0-9_@/.\-])(?:(?:van|von|de|del|di|da|du|le|la|den|ter|ten)(?: +de[nr]?| +la)? +)?[A-ZÀ-ÖØ-Þ](?:\. ?|[{L}'’\-]*,? +)(?:[A-ZÀ-ÖØ-Þ]\. ?)*(?:(?:van|von|vom|zu|de|del|della|di|da|dos|du|le|la|den|der|ten|ter|af|av|al|el|bin) +){{0,2}}[A-ZÀ-ÖØ-Þ]")
LETTER, AFTER_GAP = re.compile(rf"[{L}0-9]"), re.compile(rf"[^{L}0-9\n]*")
OPENS = re.compile(r"(?:^|[.!?:;\n\x00]\s*)$")
TOKEN = re.compile(rf"[{L}0-9'’]+[.\-]?,? *|.", re.S)
# Words that introduce a person; a title isn't part of the name.
INTRODUCED = re.compile(
    r"(?:\b(?:written|reviewed|edited|translated|reported|approved|signed|posted|checked|photographed)\s+by|\bby|\bauthor|\bautor(?:in)?|\bauteur|\bassigned\s+to|\battn\.?|\bcc|\bbcc|\bmy\s+name\s+is|\bname\s*:|\bich\s+heiße|\bmein\s+name\s+ist|\bje\s+m['’]appelle|\bme\s+llamo|\bmijn\s+naam\s+is|"
    r"\b(?:came|come|complaint|message|letter|call|review)\s+from|\bcontact\s+person|\bansprechpartner(?:in)?|\b(?:dear\s+)?(?:mr|ms|mrs|miss|mx|dr|prof|herr|frau|hr|fr|mme|mlle|madame|monsieur|sr|sra|señora?|mevr|dhr|mevrouw|meneer)\b\.?|\bregards,?|\bthanks,?|\bgrüße[n]?,?|\bcordialement,?|\bsaludos,?)\s*:?\s*$",
    re.I,
)
# Words that introduce a person in Cyrillic and Greek letters.
OTHER_SAID = re.compile(rf"(?<!\w)(?:[Мм]еня\s+зовут|[Аа]втор|[Гг]-н|[Гг]-жа|[Гг]осподин|[Гг]оспожа|[Мм]ε\s+λένε|[Κκ]\.|[Κκ]υρία|[Κκ]ύριος)\s*:?\s+(?P<n>{OTHER_CAP}(?:-{OTHER_CAP})?(?:\s+{OTHER_CAP}(?:-{OTHER_CAP})?){{1,2}})(?!\w)")
AS_SAID, AFTER_AS = re.compile(r"\b(?:as|wie|comme|como|zoals)\s+$", re.I), re.compile(r"\s+(?:told|said|says|wrote|noted|explained|sagte|dit|dijo|zei)\b")
FOLLOWED = re.compile(r"\s+(?:wrote\s+(?:this|that|the|a|to|us)|told\s+us|checked\s+the|and\s+I\s+run|\(customer\s+since|schrieb|a\s+écrit|escribió|schreef)\b")
NO_PERSON = re.compile(r"\s+(?:&\s|(?:Tools|Garden|Gardens|Press|GmbH|Ltd|Inc|LLC|AG|KG|BV|SARL|S\.L\.|Street|Road|Lane|Avenue|Square|Studio|Market|Academy|Cycles|Journal|Home|Clinic|Outfitters|Supply|Goods|Group|Bros|Sons)\b)")
# Capitalised words that no name begins with.
NO_NAME = frozenset(
    "The A An And Or But If In On At Of For From To With Without By Is Are Was Were Be Do Does Did Has Have Had Not No Nor So As It Its This That These Those They We You He She I My Our Your Their His Her What Which Who When Where Why How There Here Please Dear Hello Hi Thanks Thank Kind Best "
    "Regards Contact Phone Tel Fax Email Mail Address Adresse Order Ticket Version Build Model Price Home Support Team Service Customer Customers Sales Every Each Visit Written Author Assigned Call Ring Probe Passport Der Die Das Ein Eine Den Dem Des Und Oder Wir Sie Ich Für Mit Von Zu Bei Le La Les Un Une Des Du Et Ou "
    "Nous Vous Je El Los Las Una Y O Het De Een En Of Op Van Mr Ms Mrs Dr Prof Herr Frau WARN INFO DEBUG ERROR SSN NIE DNI NI".casefold().split()
)
# Name parts that are everyday words; without an introduction they need more than themselves.
EVERYDAY = frozenset("mark rose hope will grace page link marsh banner may april june summer art bill frank jack faith joy iris lily ivy dean grant chase hunter mason cook baker smith young long short white black brown green wood field hill stone church bell king knight price bishop".split())


class Names:
    """Known name parts and what they teach about family names."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.given = {p.casefold() for p, k in parts if k == "given"}
        self.family = {p.casefold() for p, k in parts if k == "family"}
        ends = Counter(f[-n:] for f in self.family for n in ENDING_LETTERS if len(f) > n + 1)
        # Of endings that the same names share, the longest says the most.
        self.endings = tuple(e for e, n in ends.items() if n >= ENDING_SUPPORT and not any(x.endswith(e) and x != e and m == n for x, m in ends.items()))

    def is_given(self, token: str) -> bool:
        return token.casefold() in self.given

    def is_family(self, token: str) -> bool:
        """A known family name, one of their endings, or a double name with such a part; everyday words don't count."""
        for t in token.casefold().split("-"):
            if (t in self.family and t not in EVERYDAY) or (len(t) > 5 and t.endswith(self.endings) and bool(self.endings)):
                return True
        return False


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with \x00 in place of the spans, so that places stay."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "\x00" * (b - a)]
            at = b
    return "".join(out) + text[at:]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    for signs, more, form in EMAILS:
        if any(x in low for x in signs) and (more is None or more.search(text)):
            for m in form.finditer(text):
                if not FILES.search(m.group()):
                    yield m.span()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    if not DIGIT.search(text):
        return
    if OTHER_LETTER.search(text):
        yield from (m.span() for m in OTHER_STREET.finditer(text) if any(c.isupper() for c in m.group()))
    for i, (words, p) in enumerate(ADDRESSES):
        if not any(w in text for w in words):
            continue
        for m in p.finditer(text):
            a, b = m.span()
            if i >= 4 and not (ADDRESS_SAID.search(text[max(0, a - 30) : a]) or POSTCODE.match(text, b)):
                continue
            yield a, b


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    five = FIVE.search(text)
    for shape, said in IDS if five else IDS[-1:] if EIGHT.search(text) else ():
        for m in shape.finditer(text):
            if said is None:
                yield m.span()
                continue
            # The explaining word belongs to the same sentence, with no other number in between; or it follows at once.
            before = BREAK.split(text[max(0, m.start() - NEAR) : m.start()])[-1]
            after = THEN.match(text[m.end() : m.end() + 40])
            if said.search(before) or (after and said.search(after.group())):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if not NINE.search(text):
        return
    for m in PHONES.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15 and not NOT_PHONE.search(text[max(0, m.start() - 24) : m.start()]):
            yield m.span()
    for m in PLAIN.finditer(text):
        if PHONE_SAID.search(text[max(0, m.start() - 24) : m.start()]):
            yield m.span()


def _persons(text: str, names: Names) -> Iterator[tuple[int, int]]:
    if OTHER_LETTER.search(text):
        yield from (m.span("n") for m in OTHER_SAID.finditer(text))
    at = 0
    while found := CANDIDATE.search(text, at):
        start = found.start()
        for form in (PERSON_BACK, PERSON):
            m = form.match(text, start)
            if m and _is_person(text, m, names):
                yield m.span()
                at = m.end()
                break
        else:  # on from the next word, which the rejected candidate may hide
            at = max(TOKEN.match(text, start).end(), start + 1)


def _alone(text: str, a: int, b: int) -> bool:
    """Whether the line of text[a:b] has no other letter or digit; looks no further than the next one."""
    a -= 1
    while a >= 0 and text[a] != "\n":
        if LETTER.match(text, a):
            return False
        a -= 1
    m = AFTER_GAP.match(text, b)
    return m.end() == len(text) or text[m.end()] == "\n"


def _is_person(text: str, m: re.Match, names: Names) -> bool:
    a, b = m.span()
    if NO_PERSON.match(text, b):
        return False
    if m.re is PERSON_BACK:
        family, given = m.group("f").split()[-1], m.group("g").split()[0]
        if family.casefold() in NO_NAME or given.casefold() in NO_NAME:
            return False
    else:
        words = m.group().split()
        given, family = words[0], words[-1]
        if given.casefold() in NO_NAME or family.casefold() in NO_NAME:
            return False
    before, alone = text[max(0, a - 40) : a], _alone(text, a, b)
    initial = len(given.rstrip(".")) == 1
    said = bool(INTRODUCED.search(before)) or bool(AS_SAID.search(before) and AFTER_AS.match(text, b)) or bool(FOLLOWED.match(text, b))
    known_given, known_family = names.is_given(given), names.is_family(family)
    listed = family.casefold() in names.family
    if m.re is PERSON_BACK:
        if said:
            return known_given or known_family or listed or bool(FOLLOWED.match(text, b) or AFTER_AS.match(text, b))
        return (known_family or listed) and (known_given or alone)
    if said:
        return True
    if known_family:
        return known_given or initial or alone or (listed and not OPENS.search(before))
    return known_given and listed and (alone or given.casefold() not in EVERYDAY)


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(from, to, kind) of every item, in order, without overlaps."""
    out: list[tuple[int, int, str]] = []
    for kind, detector in (("email", _emails), ("address", _addresses), ("id_number", _numbers), ("phone", _phones), ("person_name", lambda t: _persons(t, names))):
        spans, end = [], -1
        for a, b in sorted(set(detector(text)), key=lambda s: (s[0], -s[1])):
            if a >= end and "\x00" not in text[a:b]:
                spans.append((a, b))
                end = b
        out += [(a, b, kind) for a, b in spans]
        text = _mask(text, spans)
    return sorted(out)


# --- replacement
ROUNDS = 8
#: Characters that are numbered at once; a longer item is permuted piece by piece, each piece under what came before it.
PIECE = 40
#: Surrogates that a worker remembers; only speed depends on it.
REMEMBERED = 100_000
# Letters that stand for each other, so that a surrogate can be spoken like the item; other letters stand for those
# of the same case and block of 256.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöøùúûü", "çñßýÿðþšžčćřłśźż")
SOFT = "aeiy"
WORD_PART = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=4096)
def alphabet(c: str) -> tuple[str, int]:
    """The letters that may stand for c, a letter or digit in lower case, and c's place among them."""
    for letters in ALPHABETS:
        if c in letters:
            return letters, letters.index(c)
    low, kind = ord(c) >> 8 << 8, unicodedata.category(c)
    letters = "".join(x for x in map(chr, range(low, low + 256)) if unicodedata.category(x) == kind and x == x.lower() and not any(x in a for a in ALPHABETS))
    return letters, letters.index(c)


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Surrogates:
    """Keyed one-to-one replacements, the same in every text and process that has the key."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a key")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}

    def _mix(self, tag: str, x: int, n: int, rounds) -> int:
        """A Feistel network over two parts of x, walked on until it is back below n; `rounds` in reverse undo it."""
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        sign = 1 if rounds[0] == 0 else -1
        while True:
            right, left = divmod(x, a)
            for r in rounds:
                f = int.from_bytes(hashlib.blake2b(f"{tag}|{r}|{right if r % 2 == 0 else left}".encode("utf-8", "surrogatepass"), key=self.key, digest_size=32).digest(), "big")
                if r % 2 == 0:
                    left = (left + sign * f) % a
                else:
                    right = (right + sign * f) % b
            x = right * a + left
            if x < n:
                return x

    def cycle(self, tag: str, x: int, n: int) -> int:
        """The successor of x on a keyed cycle through all of range(n): one to one, and never x itself if n > 1."""
        if n < 2:
            return x
        return self._mix(tag, (self._mix(tag, x, n, range(ROUNDS)) + 1) % n, n, range(ROUNDS - 1, -1, -1))

    def _same_form(self, tag: str, text: str, fixed: set[int]) -> str:
        """`text`, in lower case, with other letters and digits of the same alphabets in the same places."""
        out = list(text)
        places = [i for i, c in enumerate(text) if i not in fixed and c.isalnum()]
        form = "".join("*" if i in fixed or not c.isalnum() else alphabet(c)[0][0] for i, c in enumerate(text))
        form += "|" + "".join(c for i, c in enumerate(text) if i in fixed or not c.isalnum())
        for k in range(0, len(places), PIECE):
            piece, number, space = places[k : k + PIECE], 0, 1
            for i in piece:
                letters, at = alphabet(text[i])
                number, space = number + at * space, space * len(letters)
            number = self.cycle(f"{tag}|{form}|{k}|{text[: piece[0]] if k else ''}", number, space)
            for i in piece:
                letters, _ = alphabet(text[i])
                number, at = divmod(number, len(letters))
                out[i] = letters[at]
        return "".join(out)

    def part(self, name: str) -> str:
        """A part of a name, in lower case. The first letter's surrogate depends on that letter alone; a soft ending stays."""
        first = self._same_form("initial", name[0], set())
        rest = name[1:]
        return first + (self._same_form(f"name|{name[0]}", rest, {len(rest) - 1} if len(rest) > 1 and rest[-1] in SOFT else set()) if rest else "")

    def _new(self, kind: str, normal: str) -> str:
        keep = KEPT.get(kind)
        return self._same_form(kind, normal, {i for m in keep.finditer(normal) for i in range(*m.span())} if keep else set())

    def replace(self, kind: str, text: str) -> str:
        """The item's surrogate in the item's own spelling."""
        low = lowered(text)
        if kind == "person_name":
            new = WORD_PART.sub(lambda m: m.group() if m.group() in PARTICLES and text[m.start()].islower() else self._remembered("part", m.group()), low)
        else:
            letters = iter(c for c in self._remembered(kind, normal_form(kind, text)) if c.isalnum())
            kept = {i for m in SPELLING[kind].finditer(low) for i in range(*m.span())} if kind in SPELLING else set()
            new = "".join(next(letters, c) if c.isalnum() and i not in kept else c for i, c in enumerate(low))
        return "".join(n.upper() if c != c.lower() and len(n.upper()) == 1 else n for c, n in zip(text, new, strict=True))

    def _remembered(self, kind: str, normal: str) -> str:
        found = self.known.get((kind, normal))
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[kind, normal] = self.part(normal) if kind == "part" else self._new(kind, normal)
        return found


PARTICLES = frozenset("van von vom zu de la del della di da dos du le den der ten ter af av al el bin".split())
# What of an item's normal form stays: the domain's ending, the words of a street, a country code.
KEPT = {
    "email": re.compile(r"\.[^.@]+$"),
    "address": re.compile(r"(?:straße|strasse|str|weg|gasse|platz|straat|laan|dreef|werf)(?= |$)|\b(?:street|road|avenue|lane|drive|court|boulevard|place|square|way|hill|st|rd|ave|blvd|flat|apt|unit|suite|room|rue|impasse|chemin|allée|quai|bis|ter|calle|avenida|plaza|paseo|nº|des|du|de|la|los|las|del|am|an|im|in|der|zum|zur)\b"),
    "phone": re.compile(r"^\+\d{1,2}|^00\d{2}"),
}
# What spellings add to the normal form.
SPELLING = {"email": re.compile(rf"{AT_WORD}|\s+at\s+|{DOT_WORD}", re.I), "phone": re.compile(r"\(0\)")}


def normal_form(kind: str, text: str) -> str:
    """What spellings of one item have in common."""
    low = lowered(text)
    if kind == "email":
        return re.sub(r"\s+", "", re.sub(DOT_WORD, ".", re.sub(rf"{AT_WORD}|\s+at\s+", "@", low)))
    if kind in ("phone", "id_number"):
        return "".join(c for c in low.replace("(0)", "") if c.isalnum() or c == "+")
    if kind == "person_name":
        return " ".join(sorted(WORD_PART.findall(low)))
    return re.sub(r"[^\w]+|_", " ", low).strip()


def rewritten(text: str, new: list[tuple[int, int, str]]) -> str:
    """The text with (from, to, text) put in."""
    out, at = [], 0
    for a, b, x in new:
        out += [text[at:a], x]
        at = b
    return "".join(out) + text[at:]


def known_names(parts: DataFrame, part: str = "name_part", kind: str = "part_kind") -> list[tuple[str, str]]:
    """The distinct name parts; more than NAMES_MOST are refused."""
    rows = parts.select(part, kind).dropna().distinct().limit(NAMES_MOST + 1).collect()
    if len(rows) > NAMES_MOST:
        raise ValueError(f"more than {NAMES_MOST} name parts")
    return sorted((r[0], r[1]) for r in rows)


def _over(texts: DataFrame, id: str, text: str, schema: str, types: list, each) -> DataFrame:
    """Applies each(id, text) -> rows to every row where it lies."""
    fields = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars, kind = 0, None
        make = each()

        def write() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind if t is None else t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=fields)

        for b in batches:
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.extend(make(k, t))
                chars += len(t or "")
                if chars >= BATCH_CHARS and held:
                    yield write()
                    held.clear()
                    chars = 0
        if held:
            yield write()

    return texts.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(of, schema)


def _replacements(text: str, names: Names, surrogates: Surrogates) -> list[tuple[int, int, str, str, str]]:
    """(from, to, kind, placeholder, surrogate) of every item, in order. Placeholders are numbered by item within the text."""
    numbers: dict[tuple[str, str], int] = {}
    counts: Counter[str] = Counter()
    out = []
    for a, b, kind in find(text, names):
        item = text[a:b]
        which = (kind, normal_form(kind, item))
        if which not in numbers:
            counts[kind] += 1
            numbers[which] = counts[kind]
        out.append((a, b, kind, f"[{kind.upper()}_{numbers[which]}]", surrogates.replace(kind, item)))
    return out


def items(texts: DataFrame, names: DataFrame, *, id: str, text: str, key: str) -> DataFrame:
    """(id, kind, found, placeholder, surrogate): every item as it is written, once for each row and spelling, with what stands
    for it. Null and empty texts give none. `key` is secret and must be the same wherever surrogates shall agree."""
    known = texts.sparkSession.sparkContext.broadcast(known_names(names))

    def each():
        parts, surrogates = Names(known.value), Surrogates(key.encode())

        def rows(k, t):
            return {(k, kind, t[a:b], new, other) for a, b, kind, new, other in _replacements(t, parts, surrogates)} if t else ()

        return rows

    kind = texts.schema[id].dataType.simpleString()
    return _over(texts, id, text, f"_id {kind}, kind string, found string, placeholder string, surrogate string", [None, *[pa.string()] * 4], each).withColumnRenamed("_id", id)


def entities(texts: DataFrame, names: DataFrame, *, id: str, text: str, key: str) -> DataFrame:
    """(id, kind, found): the items of `items`, once for each text."""
    return items(texts, names, id=id, text=text, key=key).select(id, "kind", "found").distinct()


def redacted(texts: DataFrame, names: DataFrame, *, id: str, text: str, key: str) -> DataFrame:
    """(id, masked, pseudonymous): the text with placeholders such as [EMAIL_1], numbered by item within the text, and with
    keyed surrogates. Null stays null, an empty text empty; a text without items is unchanged. One row for each input row."""
    known = texts.sparkSession.sparkContext.broadcast(known_names(names))

    def each():
        parts, surrogates = Names(known.value), Surrogates(key.encode())

        def rows(k, t):
            if not t:
                return [(k, t, t)]
            found = _replacements(t, parts, surrogates)
            return [(k, rewritten(t, [(a, b, new) for a, b, _, new, _ in found]), rewritten(t, [(a, b, other) for a, b, _, _, other in found]))]

        return rows

    kind = texts.schema[id].dataType.simpleString()
    return _over(texts, id, text, f"_id {kind}, masked string, pseudonymous string", [None, pa.string(), pa.string()], each).withColumnRenamed("_id", id)
