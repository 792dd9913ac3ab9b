"""Personal items inside free text (problem 1).

Generators of high recall propose spans, which may overlap: addresses of mail, runs of
digits, street words, words that may be given or family names by the address book, and words that merely have the
shape of a name. Each gets features of its form and its context; boosted trees, trained on a bounded sample that labelling
rules have marked, score it, and a calibrated threshold for each kind selects. The trees for shapes see nothing of the
address book: they learn from the names that the book vouches for, and judge those it doesn't have. Of spans that overlap the
likelier stays. The text itself is only read where it lies.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.boosting import Trees, fit
from quaystone.llm.names import _FORMAL, _LEGAL, _PARTICLES, _TRADES, fold, read_person
from quaystone.llm.packing import TOKENIZER
from quaystone.session import cut

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Names of which the address book has no part: they are a person_name, but judged by trees of their own.
SHAPE = "shape"
#: A word as common as this, or two common words, make no name unless a title or a word that asks for a person stands before them.
COMMON = 3
#: Least calibrated chance of a name that nothing but its shape and context speaks for.
SHAPE_CHANCE = 0.9
#: Texts that the trees are trained on at most, chosen by hash over all three tables.
TRAIN_TEXTS = 6000
#: Family names end and begin alike in at least this share; typing errors make rarer ends.
END_SHARE = 2e-3
#: A part typed first by at least this share of people is a given name; by fewer, it may be a family name typed first, and the part beside it decides.
GIVEN_SHARE = 1e-3

_BREAK = re.compile(r"\n(?:[ \t]*(?:>|\||::|[A-ZÀ-ÖØ-ÞŁ]{1,4}>)[ \t]?)*")
_OPENING = re.compile(r"(?:[ \t]*(?:>|\||::|[A-ZÀ-ÖØ-ÞŁ]{1,4}>)[ \t]?)+")
_GAP = r"(?:[ \xa0]{1,2}\n?|\n)"


class View:
    """A text whose line breaks, with the quote marks after them, are single line feeds; knows where its characters stood."""

    def __init__(self, text: str):
        if "\n" not in text and text[:1] not in ">|:":
            self.text, self.at, self.shift = text, None, None
            return
        first = _OPENING.match(text)
        pos = first.end() if first else 0
        parts, at, shift, size = [], [0], [pos], 0
        for m in _BREAK.finditer(text, pos):
            part = text[pos : m.start()].rstrip(" \t\r")
            parts.append(part)
            parts.append("\n")
            pos = m.end()
            size += len(part) + 1
            at.append(size)
            shift.append(pos - size)
        parts.append(text[pos:])
        self.text, self.at, self.shift = "".join(parts), at, shift

    def original(self, pos: int) -> int:
        return pos if self.at is None else pos + self.shift[bisect_right(self.at, pos) - 1]


# ---- generators

_AT = re.compile(r"@|\s*(?:\[at\]|\(at\)|\{at\}|<at>)\s*|\s+at\s+(?=[\w-]+\s+dot\s+\w)", re.IGNORECASE)
_PLAIN_AT = re.compile("@")
_LOCAL = re.compile(r"[^\W_][\w.+'-]*$|[\w.+'-]*[^\W_]$")
_HOST = re.compile(r"[\w-]+(?:(?:\.|\s*(?:\[dot\]|\(dot\)|\{dot\})\s*|\s+dot\s+)[\w-]+)+", re.IGNORECASE)

_NUMBER = re.compile(
    rf"""(?=[+(\dA-Z])(?<![\w@/])(?<![\d][.,:-])(?:
    (?P<intl>\+\d{{1,3}}(?:(?:[ .-]\n?|\n)\(?\d{{1,5}}\)?){{2,5}}(?:{_GAP}?(?:ext\.?|x){_GAP}?\d{{1,5}})?)
    |(?P<nat>(?:1{_GAP})?\(\d{{3}}\){_GAP}?\d{{3}}[ .-]?\n?\d{{4}}(?:{_GAP}?(?:ext\.?|x){_GAP}?\d{{1,5}})?)
    |(?P<dash>(?:1[-.])?\d{{3}}(?P<q>[-.])\d{{3}}(?P=q)\d{{4}}(?:{_GAP}?(?:ext\.?|x){_GAP}?\d{{1,5}})?)
    |(?P<ssn>\d{{3}}(?P<r>-|\.|[ \xa0\n])\d{{2}}(?:(?P=r)|[ \xa0\n])\d{{4}})
    |(?P<trunk>0\d{{1,4}}(?:[ \xa0/-]\d{{2,4}}){{1,4}}|0\d{{9,10}})
    |(?P<seven>\d{{3}}-\d{{4}})
    |(?P<eleven>\d{{2}}{_GAP}\d{{3}}{_GAP}\d{{3}}{_GAP}\d{{3}})
    |(?P<ni>[A-Z]{{2}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?[A-D])
    |(?P<lic>[A-Z]\d{{3}}-\d{{4}}-\d{{4}})
    |(?P<dni>\d{{8}}-?[A-Z])
    |(?P<pass>[A-Z]{{1,2}}\d{{7,8}})
    |(?P<ten>\d{{10}})
    |(?P<nine>\d{{9}})
    )(?![\w]|[-/]\d|\.\d|,\d{{3}})""",
    re.VERBOSE,
)
# National digits by country code.
_NATIONAL = {"1": 10, "33": 9, "44": 10, "49": 11, "34": 9}
_PHONE_FORMS = {"intl", "nat", "dash", "ten", "trunk", "seven"}
_FORMS = ("intl", "nat", "dash", "ssn", "eleven", "ni", "lic", "dni", "pass", "ten", "nine", "trunk", "seven")

_W = r"[A-ZÀ-ÖØ-ÞŁ][\w'’.-]*"
_US = r"(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Ter|Way|Place|Pl|Parkway|Pkwy|Highway|Hwy|Square|Sq|STREET|ST|ROAD|RD|AVENUE|AVE|BOULEVARD|BLVD|LANE|LN|DRIVE|DR|COURT|CT|TERRACE|TER|WAY|PLACE|PL|PARKWAY|PKWY|HIGHWAY|SQUARE)"
_STREET_FORMS = (
    ("us", re.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]?{_GAP}(?:[NSEW]\.?{_GAP})?(?:{_W}{_GAP}){{1,3}}?{_US}\b")),
    ("fr", re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:{_GAP}?(?:bis|ter))?,?{_GAP}(?:rue|avenue|impasse|boulevard|place|chemin|allée|quai|route|cours|RUE|AVENUE|IMPASSE|BOULEVARD|PLACE|CHEMIN|ALLÉE|QUAI|ROUTE)\b(?:{_GAP}(?:de|du|des|la|le|les|DE|DU|DES|LA|LE|LES)\b)*{_GAP}(?:[dlDL]['’])?{_W}")),
    ("de", re.compile(rf"(?<!\w)(?:[A-ZÄÖÜ][\wß-]*?(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|STRASSE|STRAßE|WEG|GASSE|ALLEE|PLATZ)|(?:Am|An{_GAP}der|Im|Auf{_GAP}dem|Zum|Zur|AM|IM|ZUM|ZUR)(?:{_GAP}{_W}){{1,3}}){_GAP}\d{{1,4}}{_GAP}?[a-zA-Z]?\b(?![.:-]\d)")),
    ("es", re.compile(rf"(?<!\w)(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|CALLE|AVENIDA|PLAZA|PASEO|CAMINO)\b(?:{_GAP}(?:de|del|la|las|los|el|DE|DEL|LA|LAS|LOS|EL)\b)*(?:{_GAP}{_W}){{1,3}}?,?{_GAP}(?:n\.?º?{_GAP})?\d{{1,4}}\b")),
    ("it", re.compile(rf"(?<!\w)(?:Via|Viale|Piazza|Corso|Largo|Vicolo)(?:{_GAP}(?:di|del|della|dei|delle|degli|dell['’]))?(?:{_GAP}{_W}){{1,3}}?,?{_GAP}\d{{1,4}}\b(?![.:/-]\d)")),
    ("nl", re.compile(rf"(?<!\w)[A-Z][\w’'-]*(?:straat|gracht|laan|plein|kade|dijk|singel|steeg){_GAP}\d{{1,4}}{_GAP}?[a-zA-Z]?\b(?![.:/-]\d)")),
)
# A text without any of these has no street of the form.
_STREET_HINTS = {
    "us": tuple(" St Ro Rd Av Bo Bl La Ln Dr Co Ct Te Wa Pl Pa Pk Hi Hw Sq ST RO RD AV BO BL LA LN DR CO CT TE WA PL PA PK HI HW SQ".split()),
    "fr": ("rue", "avenue", "impasse", "boulevard", "place", "chemin", "allée", "quai", "route", "cours", "RUE", "AVENUE", "IMPASSE", "BOULEVARD", "PLACE", "CHEMIN", "ALLÉE", "QUAI", "ROUTE"),
    "de": ("straße", "strasse", "str.", "weg ", "weg\n", "gasse", "allee", "platz", "ring ", "damm ", "ufer ", "Am ", "An der", "Im ", "Auf dem", "Zum ", "Zur ", "AM ", "IM ", "ZUM ", "ZUR ", "STRASSE", "STRAßE", "WEG", "GASSE", "ALLEE", "PLATZ", "Am\n", "Im\n"),
    "it": ("Via ", "Viale ", "Piazza ", "Corso ", "Largo ", "Vicolo "),
    "nl": ("straat", "gracht", "laan", "plein", "kade", "dijk", "singel", "steeg"),
    "es": ("Calle", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Carrera", "Ronda", "CALLE", "AVENIDA", "PLAZA", "PASEO", "CAMINO"),
}
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLE_WORD = re.compile(r"(?:mr|mrs|ms|miss|dr|prof|hr|herr|frau|m|mme|sir|madam|team|dear|hello|hi)", re.IGNORECASE)
_TITLE_BEFORE = re.compile(r"(?:^|\W)(?:mr|mrs|ms|miss|dr|prof|hr|herr|frau|m|mme)\.?\s+$", re.IGNORECASE)
_NAME_LEFT = re.compile(r"(?:/s/|signed by|by:|by|approved:|attention|attn:?|for|with|reach|and|that|used|check for|from:?|von:|de ?:|schrieb|wrote|spoke with|\d,|\bam|\bpm|\d\d|contact|to)\s*(?:(?:mr|mrs|ms|dr|prof|hr)\.?\s+)?$", re.IGNORECASE)
_NAME_RIGHT = re.compile(r"\s*(?:,? ?(?:cfo|ceo|controller|audit|tax|ap lead|fp&a|treasury|payroll|internal|engagement|assistant|director|manager)\b|<|\(|/ |left\b|from\b|moved\b|at\b|and\b|:|a écrit|escribió|wrote|\t|\.?$|\.|,|\n)", re.IGNORECASE)
_STREETWORD = re.compile(rf"\s*(?:{_W}\s+)?{_US}\b")
_ORG_RIGHT = re.compile(r"\s*(?:inc|llc|ltd|gmbh|corp|co|s\.a\.|l\.l\.c\.|" + "|".join(_TRADES) + r")\b", re.IGNORECASE)

_PHONE_LEFT = re.compile(r"(?:call|phone|tel\.?|t:|m|mobile is|mobile|cell|fax|reach|at|dial|/|\+)\s*$", re.IGNORECASE)
_ID_LEFT = re.compile(r"(?:ssn|social[\s\n]+security(?:[\s\n]+no\.?|[\s\n]+number)?|soc\.?[\s\n]+sec\.?|steuer-?id(?:nr)?\.?|tax[\s\n]+id|tin|passport|pass(?:-?nr\.?)|dni|nie|nif|ni[\s\n]+number|national[\s\n]+insurance(?:[\s\n]+number)?|licen[cs]e|personalausweis|identity[\s\n]+(?:card|number))\W*(?:no\.?|number|nr\.?|#)?[\s\n:#(]*$", re.IGNORECASE)
_ID_NOT = re.compile(r"(?:serial|lot|tag|check|cheque|po|account|ticket|invoice|order|batch|number|voucher|policy|journal|item|request|posten|poste|saldo|cuenta|rechnung|factura|facture)\W*(?:number|is|no\.?|nr\.?)?[\s\n:#(]*(?:is[\s\n]*)?$", re.IGNORECASE)
_ID_RIGHT = re.compile(r"\)?,?[\s\n]+(?:who[\s\n]+lives|home\b|phone\b)|[\s\n]+for[\s\n]+(?:(?:Mr|Ms|Mrs|Dr)\.|[A-ZÀ-ÖØ-ÞŁ][\w.'’-]*[\s\n,]+[A-ZÀ-ÖØ-ÞŁ])")
_HEAD_ID = re.compile(r"tax id|ssn|social|^nr\.?$|steuer|nif|dni|passport|id no|identity|n° ?(?:fiscal|ss)|sécu|identif|licen[cs]e|national", re.IGNORECASE)
_HEAD_NOT = re.compile(r"asset|serial|account|invoice|amount|debit|credit|cost|lot|order|voucher|current|\d", re.IGNORECASE)
_HEAD_PHONE = re.compile(r"phone|tel|mobile|fax|movil|móvil", re.IGNORECASE)
_HEAD_HOME = re.compile(r"home|address|anschrift|adresse|domicili|direcci|remit|street|residence", re.IGNORECASE)
_HEAD_NAME = re.compile(r"^(?:name|employee|mitarbeiter|nom|employé|salarié|nombre|empleado|contact|person|kontakt|contacto)", re.IGNORECASE)


# Words that stand before a family name without being a given name.
_NO_GIVEN = {"mrs", "miss", "prof", "herr", "frau", "mme", "sir", "the", "and", "partner", "auditor", "team", "dear", "hello", "from", "von", "van", "der", "attention", "contact", "vendor", "name", "near", "with", "for", "bonjour", "hola", "hallo", "liebe", "guten", "good", "morning", "estimado", "estimada", "cher", "chere", "best", "regards", "thanks", "cheers", "sincerely", "cordialement", "saludos", "viele", "beste", "freundliche", "herzliche", "schöne", "many", "kind", "warm", "yours", "cordiales", "bien", "buenos", "buenas", "muchas"}


class Parts:
    """What the address book says of name parts: how often a word was a given or a family name, or rarely typed first and so either, and how family names begin and end."""

    def __init__(self, given: dict[str, float], family: dict[str, float], ends: dict[str, float], heads: dict[str, float], either: dict[str, float] | None = None):
        self.given, self.family, self.ends, self.heads, self.either = given, family, ends, heads, either or {}
        for nick, formal in _FORMAL.items():
            if formal in given:
                self.given.setdefault(nick, given[formal] / 2)
        self.seen: dict[str, tuple[float, float, float, float, bool, float]] = {}
        self.opens = _Opens(self)

    def of(self, word: str) -> tuple[float, float, float, float, bool, float]:
        """(given, family, end, head) of a word as typed, shares of the address book in logarithmic steps; whether a name may start or end with it; share of a part that may be either."""
        got = self.seen.get(word)
        if got is None:
            w = re.sub(r"['’]", "", fold(word))
            halves = w.split("-")
            step = lambda x: 0.0 if x <= 0 else float(min(6, max(1, 6 + np.log10(x) * 1.5)))
            got = (step(self.given.get(w, 0)), max(step(self.family.get(x, 0)) for x in (w.replace("-", ""), *halves)), max(step(self.ends.get(x[-4:], 0)) if len(x) > 5 else 0.0 for x in halves), step(self.heads.get(w[:3], 0)))
            either = 0.0 if got[0] or got[1] else step(self.either.get(w.replace("-", ""), self.either.get(w, 0)))
            got = (*got, bool(got[0] or got[1] or got[2] or either) or len(word) == 1 and word.isupper(), either)
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[word] = got
        return got


class _Opens(dict):
    """Whether a name may open with a word: one that the book knows, or a capitalised one, if the next tells a family name."""

    def __init__(self, parts: Parts):
        super().__init__()
        self.parts = parts

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = self.parts.of(word)[4] or len(word) > 2 and word[0].isupper() and fold(word) not in _NO_GIVEN
        return out


def _case(word: str) -> int:
    return 2 if word.isupper() and len(word) > 1 else 1 if word[0].isupper() else 0


class Reader:
    """Candidates of one text with their features."""

    def __init__(self, text: str, parts: Parts):
        self.view = View(text)
        self.t = self.view.text
        self.parts = parts
        self.tabs = "\t" in self.t
        self.head: list[str] = []
        if self.tabs:
            for line in self.t.split("\n"):
                if "\t" in line:
                    self.head = line.split("\t")
                    break

    def cell(self, s: int, e: int) -> tuple[str, float, float]:
        """Header of the column, whether the span fills its cell, and whether the row starts with a person."""
        if not self.tabs:
            return "", 0.0, 0.0
        a = self.t.rfind("\n", 0, s) + 1
        b = self.t.find("\n", s)
        line = self.t[a : b if b >= 0 else len(self.t)]
        if "\t" not in line:
            return "", 0.0, 0.0
        k = line.count("\t", 0, s - a)
        cells = line.split("\t")
        words = _TOKEN.findall(cells[0])
        person = float(any(self.parts.of(w)[0] > 0 for w in words) or len(words) == 2 and len(words[0]) == 1) if 2 <= len(words) <= 4 else 0.0
        return self.head[k] if k < len(self.head) else "", float(cells[k].strip() == self.t[s:e].strip()), person

    def emails(self):
        t = self.t
        low = t.lower()
        marks = _AT if "at]" in low or "at)" in low or "at}" in low or "at>" in low or " dot " in low else _PLAIN_AT
        for m in marks.finditer(t):
            left = _LOCAL.search(t, max(0, m.start() - 64), m.start())
            right = _HOST.match(t, m.end())
            if not left or not right:
                continue
            s, e = left.start(), right.end()
            while t[s] in ".'-+":
                s += 1
            tail = re.split(r"\W+", t[right.start() : e])[-1]
            before = t[max(0, s - 6) : s].lower()
            yield "email", s, e, (float(m[0] != "@"), float(tail.isalpha() and len(tail) > 1), float("cid:" in before), float(len(t[s:e])), float("mailto" in before), float(bool(re.search(r"\.(?:png|jpg|gif)$", t[s : m.start()].lower()))))

    def phone_end(self, s: int, e: int) -> int:
        """Where a number with country code ends: the digits of the next line are not its own if it is complete without them."""
        t = self.t[s:e]
        country = next((c for c in _NATIONAL if t[1:].startswith(c)), "")
        most = _NATIONAL.get(country, 12)
        while True:
            main = re.split(r"ext|x", t)[0]
            digits = sum(c.isdigit() for c in main) - len(country)
            if digits <= most or "\n" not in t:
                break
            t = t[: t.rfind("\n")].rstrip()
        return s + len(t) if 7 <= digits <= 13 else -1

    def numbers(self):
        t = self.t
        for m in _NUMBER.finditer(t):
            form = next(f for f in _FORMS if m[f] is not None)
            s, e = m.start(), m.end()
            if form == "intl":
                e = self.phone_end(s, e)
                if e < 0:
                    continue
            elif form == "trunk" and not 9 <= sum(c.isdigit() for c in m[0]) <= 12:
                continue
            left, right = t[max(0, s - 40) : s], t[e : e + 30]
            head, fills, person = self.cell(s, e)
            line_start = t.rfind("\n", 0, s) + 1
            alone = t[line_start:s].strip() == "" and (right == "" or right[0] == "\n")
            common = (float(_FORMS.index(form)), float(bool(_ID_LEFT.search(left))), float(bool(_ID_NOT.search(left))), float(bool(_PHONE_LEFT.search(left))), float(bool(_HEAD_ID.search(head))), float(bool(_HEAD_NOT.search(head))), float(bool(_HEAD_PHONE.search(head))), fills, person, float(alone), float("*" in left[-4:] or "x" in left[-3:].lower()), float(sum(c.isdigit() for c in t[s:e])), float(bool(_ID_RIGHT.match(right))))
            yield ("phone" if form in _PHONE_FORMS else "id_number"), s, e, common

    def streets(self):
        t = self.t
        if not _DIGIT.search(t):
            return
        for k, (form, pattern) in enumerate(_STREET_FORMS):
            if not any(map(t.__contains__, _STREET_HINTS[form])):
                continue
            for m in pattern.finditer(t):
                s, e = m.start(), m.end()
                left, right = t[max(0, s - 30) : s].lower(), t[e : e + 24]
                head, fills, _ = self.cell(s, e)
                cue = bool(re.search(r"(?:lives at|home|address is|original \w+ to|at|to|:)\s*$", left))
                town = bool(re.match(r"\.?,?\s+(?:\d{5}\b|Apt\b|APT\b|Suite\b|SUITE\b|Unit\b)", right))
                alone = t[t.rfind("\n", 0, s) + 1 : s].strip() == ""
                yield "street_address", s, e, (float(k), float(cue), float(town), float(alone), float(bool(_HEAD_HOME.search(head))), fills, float(len(m[0].split())), float(len(re.match(r"\d*", m[0])[0])))

    def names(self):
        t, of = self.t, self.parts.of
        found = list(_TOKEN.finditer(t))
        plain = [m[0] for m in found]
        n = len(found)
        seen = self.parts.seen
        # only words that may open a name are looked at one by one
        for i in compress(range(n - 1), map(self.parts.opens.__getitem__, plain)):
            w = plain[i]
            known = seen.get(w) or of(w)
            if not known[4]:
                # an unknown given name, told by the family name after it
                family = plain[i + 1]
                after = seen.get(family) or of(family)
                if not (after[2] and after[3]) or after[0] or _case(family) != _case(w):
                    continue
            s, e = found[i].span()
            g, f, end, head, _, either = known
            single = len(w) == 1
            if s and t[s - 1] in "@/&" and t[s - 4 : s] != "/s/ ":
                continue
            # what follows: particles, a middle initial, then the other part
            j, last, comma, middle, particles = i + 1, e, False, 0, 0
            while j < n:
                (a, b), x = found[j].span(), plain[j]
                gap = t[last:a]
                dot = gap[:1] == "." and len(plain[j - 1]) == 1
                body = gap[1:] if dot else gap
                if body[:1] == "," and not comma and j == i + 1 + particles and not single:
                    comma, body = True, body[1:]
                if not body or body.strip(" \t\xa0\n") or len(body) > 4 or body.count("\n") > 1 or "\t" in body or self.tabs and "\n" in body:
                    j = n
                    break
                if fold(x) in _PARTICLES and len(x) <= 3 and j - i <= 4:
                    particles += 1
                    last = b
                    j += 1
                    continue
                if len(x) == 1 and x.isupper() and j == i + 1 and not comma and not single:
                    middle = 1
                    last = b
                    j += 1
                    continue
                break
            if j >= n:
                continue
            (a, b), x = found[j].span(), plain[j]
            g2, f2, end2, head2, _, either2 = of(x)
            if either and (g2 or f2 or end2):
                g, f = (0.0, either) if g2 else (either, 0.0)
            if either2 and (g or f or end or single):
                g2, f2 = (0.0, either2) if g or single else (either2, 0.0)
            initial2 = len(x) == 1 and x.isupper() and comma and (t[b : b + 1] != " " and "\n" not in gap)
            if not (g2 or f2 or end2 or initial2 or comma and self.tabs and end and head and not g and len(x) > 2 and x[0].isupper()):
                continue
            if single and not (f2 or end2):
                continue
            if b < len(t) and t[b] == "@" or t[b : b + 1] == "." and t[b + 1 : b + 2].isalnum() or s and t[s - 1] == "." and s > 1 and t[s - 2].isalnum() and len(plain[i - 1]) > 1:
                continue
            start = s
            k = i - 1
            if comma:
                while k >= 0 and fold(plain[k]) in _PARTICLES and len(plain[k]) <= 3 and t[found[k].end() : start].strip(" \xa0\n") == "" and found[k].end() < start and t[found[k].end() : start].count("\n") < 2:
                    start = found[k].start()
                    k -= 1
            stop = b + (1 if initial2 and t[b : b + 1] == "." else 0)
            left, right = t[max(0, start - 26) : start], t[stop : stop + 22]
            header, fills, _ = self.cell(start, stop)
            yield "person_name", start, stop, (
                g, f, end, head, g2, f2, end2, head2, float(single), float(initial2), float(comma), float(particles), float(middle), float(_case(w)), float(_case(x)),
                float(bool(_TITLE_BEFORE.search(left))), float(bool(_NAME_LEFT.search(left))), float(bool(_NAME_RIGHT.match(right))), float(bool(_STREETWORD.match(right))), float(bool(_ORG_RIGHT.match(right))),
                float(bool(_HEAD_NAME.search(header))), fills, float("\n" in t[start:stop]),
            )

    def candidates(self):
        yield from self.emails()
        yield from self.numbers()
        yield from self.streets()
        yield from self.names()


_NAME_WORD = r"[A-ZÀ-ÖØ-ÞŁ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_PART = "(?:van|von|der|de|den|del|della|di|da|la|le|al|el|bin|ibn|ten|ter|zu|zum|dos|du)"
# the first capital is taken and the rest only looked at, so that a name may start within what looks like one
_SHAPED = re.compile(rf"[A-ZÀ-ÖØ-ÞŁ](?<![\w@/&.'’-].)(?=(?P<a>[^\W\d_]*(?:['’-][^\W\d_]+)*)\.?(?:[ \xa0]\n?|\n)(?P<m>[A-ZÀ-ÖØ-ÞŁ]\.?[ \xa0])?(?P<p>(?:{_PART}[ \xa0])*)(?P<b>{_NAME_WORD}(?<=[^\W\d_]{{2}}))(?![\w@]))")
_CAP_BEFORE, _CAP_AFTER = re.compile(r"[A-ZÀ-ÖØ-ÞŁ][\w'’-]*[ \xa0]$"), re.compile(r"[ \xa0-][A-ZÀ-ÖØ-ÞŁ]")
# Words that ask for a person after them.
_ASKS = set("with met call called ask asked told thank thanked reach contact cc dear hi hello attn attention by colleague sincerely regards interviewed interview according from von de name signed /s/ cheers thanks approved reviewer preparer".split())
_ASKS_BELOW = set("sincerely regards cheers thanks name from signed approved reviewer preparer contact attention".split())
_TITLES_BEFORE = set("mr mrs ms miss dr prof hr herr frau m mme".split())
_PERSON_RIGHT = re.compile(r"\s*(?:,? ?(?:cfo|ceo|coo|controller|auditor|manager|director|partner|assistant|analyst|accountant|treasurer|clerk)\b|<|\(|(?:said|says|wrote|asked|told|called|confirmed|signed|left|joined|will|has|is|was|who|agreed|approved|schrieb|a écrit|escribió)\b|from the\b|at the\b)", re.IGNORECASE)


class Vocabulary:
    """How common words are in lower case, by their rank in a public vocabulary; names are hardly ever in it."""

    def __init__(self, tokenizer: str = TOKENIZER):
        import base64

        with open(tokenizer, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.seen: dict[str, tuple[float, bool]] = {}

    def of(self, word: str) -> tuple[float, bool]:
        """Steps from 0, absent, to 6, most common, of a word with hyphens those of its most common part; whether it addresses people or is a legal form, and so is part of no name."""
        got = self.seen.get(word)
        if got is None:
            ranks = [self.ranks.get(f" {x}".encode()) for x in word.lower().split("-")]
            got = max(0.0 if r is None else float(max(1, 6 - r // 10_000)) for r in ranks), fold(word) in _NO_GIVEN or word.lower() in _LEGAL or bool(_TITLE_WORD.fullmatch(word))
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[word] = got
        return got


def shapes(reader: Reader, words: Vocabulary, taken: list[tuple[int, int]]):
    """Spans of the shape `Given Family`, in capitals or not, with an initial or particles, whether or not the address book knows a part of them.

    Not proposed is what meets a taken span (in order), starts with a word of address or ends in a title or legal form, and common words
    without a title or a word that asks for a person before them.
    """
    t = reader.t
    starts = [s for s, _ in taken]
    for m in _SHAPED.finditer(t):
        s, e, b = m.start(), m.end("b"), m["b"]
        if starts:
            k = bisect_right(starts, e - 1)
            if any(x > s for _, x in taken[max(0, k - 3) : k]):
                continue
        a = t[s : m.end("a")]
        (common_a, opens_none), (common_b, ends_none) = words.of(a), words.of(b)
        if opens_none or ends_none or (t[s + 1] not in ". " if len(a) == 1 else t[m.end("a")] == "."):
            continue
        left = t[max(0, s - 26) : s]
        if left[-1:] in (" ", "\xa0") and left[-2:-1].isalpha() and (given := _CAP_BEFORE.search(left)) and len(given[0]) > 2 and words.of(given[0][:-1]) == (0.0, False):
            s -= len(given[0])  # a first of several given names
            left = t[max(0, s - 26) : s]
        last = left.split()[-1:] or [""]
        word = last[0].lower().strip(".:,;(")
        title, asked = word in _TITLES_BEFORE, word in _ASKS and last[0][-1] != "." and ("\n" not in t[max(0, s - 3) : s] or word in _ASKS_BELOW)
        if not asked and not title and (common_a >= COMMON or common_b >= COMMON or common_a and common_b):
            continue
        right = t[e : e + 22]
        header, fills, _ = reader.cell(s, e)
        before = left.rstrip(" \xa0")
        yield SHAPE, s, e, (
            common_a, common_b, float(len(a) == 1), float(_case(a)), float(_case(b)), float(bool(m["m"])), float(bool(m["p"])), float(title), float(asked), float(bool(_PERSON_RIGHT.match(right))),
            float(bool(_NAME_LEFT.search(left))), float(bool(_NAME_RIGHT.match(right))), float(bool(_STREETWORD.match(right))), float(bool(_ORG_RIGHT.match(right)) or b.lower() in _TRADES),
            float(bool(_CAP_BEFORE.search(left))), float(bool(_CAP_AFTER.match(right))), float(before[-1:] in ("", ".", "!", "?", "\n", ":")), float("\n" in t[s:e]), float(bool(_HEAD_NAME.search(header))), fills,
        )


# ---- labelling rules for the training sample


def rule_label(kind: str, x: tuple[float, ...]) -> int | None:
    """What the rules say of a candidate: 1, 0, or None if they don't know."""
    if kind == "email":
        return int(x[1] and not x[2] and not x[5])
    if kind in ("phone", "id_number"):
        form = _FORMS[int(x[0])]
        labelled, named, phone, head_id, head_not, head_phone, fills, person, alone, masked = (bool(v) for v in x[1:11])
        if masked:
            return 0
        if kind == "phone":
            if named and not phone or head_not:
                return 0
            if form in ("trunk", "seven"):
                return int(phone or head_phone or form == "trunk" and alone)
            return 1 if form in ("intl", "nat", "dash") or phone or head_phone or alone else None
        if labelled or head_id or fills and person or x[12]:
            return 1
        if named or head_not:
            return 0
        return 1 if form in ("ni", "eleven") else 0 if form in ("nine", "pass", "ssn") else None
    if kind == "street_address":
        return 1 if x[1] or x[2] or x[3] or x[4] else None
    g, f, end, _, g2, f2, end2 = x[:7]
    single, initial2, comma = x[8:11]
    street, org = x[18], x[19]
    if street or org and not (x[15] or x[20]):
        return 0
    if comma:
        if g and g2 and not (f or end):
            return 0
        if not g2 and not initial2:
            return int(bool(x[21] and x[20]))
        return int(bool((f or end) and (g2 or initial2)))
    if single:
        return int(bool(f2 or end2))
    if g and (f2 or end2) and not g2:
        return 1
    if (f or end) and g2 and not g:
        return int(bool(x[13] == 2 and x[14] == 2 or x[15] or x[16] or x[20]))
    if not g and not g2:
        told = end2 and x[7] and x[13] == x[14] >= 1
        return 0 if not told else 1 if x[15] or x[16] or x[20] else None
    return 0 if not (f2 or end2 or f or end) or g and g2 else None


def _proposed(text: str, parts: Parts, words: Vocabulary):
    """The reader of a text and its candidates; of shapes only those that the address book proposes nothing in."""
    reader = Reader(text, parts)
    known = list(reader.candidates())
    return reader, known, list(shapes(reader, words, sorted((s, e) for kind, s, e, _ in known if kind == "person_name")))


def training_set(texts: list[str], parts: Parts, words: Vocabulary) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Candidates that a rule can label. A shape is a name where the book vouches for the very span, and none where it proposes nothing in it."""
    rows: dict[str, list] = {k: [] for k in (*KINDS, SHAPE)}
    for t in texts:
        reader, known, free = _proposed(t, parts, words)
        sure = set()
        for kind, s, e, x in known:
            y = rule_label(kind, x)
            if y is not None:
                rows[kind].append((x, y))
                if kind == "person_name" and y:
                    sure.add((s, e))
        rows[SHAPE] += [(x, 1) for _, s, e, x in shapes(reader, words, []) if (s, e) in sure] + [(x, 0) for *_, x in free]
    return {k: (np.array([x for x, _ in v], float), np.array([y for _, y in v], float)) for k, v in rows.items()}


def train(texts: list[str], parts: Parts, words: Vocabulary) -> dict[str, Trees]:
    models = {k: fit(x, y) for k, (x, y) in training_set(texts, parts, words).items() if len(x)}
    if SHAPE in models:
        models[SHAPE].cut = max(models[SHAPE].cut, SHAPE_CHANCE)
    return models


# ---- selection


def find_items(texts: list[str | None], parts: Parts, models: dict[str, Trees], words: Vocabulary) -> tuple[list[int], list[str], list[int], list[int]]:
    """(text, kind, start, end) of the selected items, in order of text and start."""
    pool: dict[str, list] = {k: [] for k in models}
    for i, text in enumerate(texts):
        if text and not text.isspace():
            reader, known, free = _proposed(text, parts, words)
            for kind, s, e, x in known + free:
                if kind in pool:
                    pool[kind].append((i, reader.view.original(s), reader.view.original(e - 1) + 1, x))
    chosen = []
    for kind, rows in pool.items():
        if rows:
            p = models[kind].chance(np.array([r[3] for r in rows], float))
            # a shape yields to whatever the other generators are sure of
            chosen += [(r[0], kind == SHAPE, -q, -(r[2] - r[1]), r[1], r[2], kind) for r, q in zip(rows, p) if q >= models[kind].cut]
    chosen.sort()
    out: list[tuple[int, int, int, str]] = []
    text, taken = -1, []
    for i, _, _, _, s, e, kind in chosen:
        if i != text:
            text, taken = i, []
        if all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            out.append((i, s, e, "person_name" if kind == SHAPE else kind))
    out.sort()
    return [x[0] for x in out], [x[3] for x in out], [x[1] for x in out], [x[2] for x in out]


def name_parts(addresses: DataFrame, messages: DataFrame) -> Parts:
    """Shares of given names, family names, their ends and heads in the address book and the heads of mails.

    Counted over all rows. Every part comes to the driver and to each task, however rare, so that a name that is known in a small
    book is known in a large one; of ends and heads, at most 1 / END_SHARE.
    """

    @F.pandas_udf("given string, family string")
    def split(names: pd.Series) -> pd.DataFrame:
        out = []
        for name in names:
            got = read_person(name)
            if not got or got[0] != "full" or name.isupper():
                out.append((None, None))
                continue
            plain = re.sub(r"\([^)]*\)", " ", name).strip("'\" ")
            first = re.sub(r"[^\w]", "", fold(plain).split(",")[-1].replace(".", " ").split()[0]) if "," in plain and fold(plain).split(",")[-1].replace(".", " ").split() else None
            words = [w for w in re.sub(r"['’]", "", fold(plain)).replace(".", " ").replace("_", " ").split() if w not in ("dr", "mr", "mrs", "ms", "hr", "prof", "frau", "herr")]
            first = first or (words[0] if words else "")
            first = _FORMAL.get(first, first)
            other = got[2] if got[1] == first else got[1] if got[2] == first else None
            out.append((first, other) if other else (None, None))
        return pd.DataFrame(out, columns=["given", "family"], dtype=object)

    typed = addresses.select(F.col("display_name").alias("name")).unionByName(messages.select(F.explode(F.concat(F.array("sender.display_name"), *[F.coalesce(F.transform(c, lambda a: a["display_name"]), F.array().cast("array<string>")) for c in ("to_addrs", "cc_addrs")])).alias("name")))
    # each pair of parts counts once: a family name that one person types first has one partner, a given name has many
    said = cut(typed.where("name is not null").distinct().select(split("name").alias("p")).select("p.*").where("given is not null").distinct())
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("w")) for k, v in (("given", F.col("given")), ("family", F.col("family")), ("end", F.when(F.length("family") > 5, F.substring(F.col("family"), -4, 4))), ("head", F.substring("family", 1, 3)))]))
    counted = said.select(kinds.alias("s")).select("s.*").where("w is not null").groupBy("k", "w").agg(F.count("*").alias("n"))
    total = said.count()
    rows = counted.where(F.col("k").isin("given", "family") | (F.col("n") >= END_SHARE * total)).collect()
    share: dict[str, dict[str, float]] = {k: {} for k in ("given", "family", "end", "head")}
    for r in rows:
        share[r.k][r.w] = r.n / max(1, total)
    given = {w: v for w, v in share["given"].items() if v > 2 * share["family"].get(w, 0) and v >= GIVEN_SHARE}
    family = {w: v for w, v in share["family"].items() if w not in given}
    either = {w: v for w, v in share["given"].items() if w not in given and w not in family}
    return Parts(given, family, share["end"], share["head"], either)


def all_texts(messages: DataFrame, sheets: DataFrame, spans: DataFrame) -> DataFrame:
    pick = lambda df, name, key, text: df.select(F.lit(name).alias("src_table"), F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).where("text is not null")
    return pick(messages, "messages", "delivery_id", "body_text").unionByName(pick(sheets, "sheets", "sheet_id", "text")).unionByName(pick(spans, "spans", "span_id", "snippet"))


def trained(messages: DataFrame, sheets: DataFrame, spans: DataFrame, addresses: DataFrame, most: int = TRAIN_TEXTS, tokenizer: str = TOKENIZER) -> tuple[Parts, dict[str, Trees]]:
    """Name parts from the whole address book, and trees fitted on at most `most` texts.

    The sample is a share of each table chosen by hash of its key, cut at its third of `most`; it only trains, what is searched
    is everything.
    """
    parts = name_parts(addresses, messages)
    sample = []
    for df, key, text in ((messages, "delivery_id", "body_text"), (sheets, "sheet_id", "text"), (spans, "span_id", "snippet")):
        n = df.count()
        share = min(1.0, most / 3 / max(1, n))
        some = df.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select(F.col(key).alias("k"), F.col(text).alias("t")).orderBy(F.xxhash64("k"), "k").limit(most // 3)
        sample += [(r.k, r.t) for r in some.collect()]
    return parts, train([t for _, t in sample], parts, Vocabulary(tokenizer))


def personal_items(messages: DataFrame, sheets: DataFrame, spans: DataFrame, addresses: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(src_table, row_id, pii_kind, start_pos, end_pos) of each personal item; positions count characters from 0.

    Null and blank texts have none; a text of any length is read whole.
    """
    parts, models = trained(messages, sheets, spans, addresses, tokenizer=tokenizer)
    known = (parts.given, parts.family, parts.ends, parts.heads, parts.either)

    def search(frames):
        own, words = Parts(*known), Vocabulary(tokenizer)
        for p in frames:
            who, kind, start, end = find_items(p["text"].tolist(), own, models, words)
            yield pd.DataFrame({"src_table": p["src_table"].to_numpy()[who], "row_id": p["row_id"].to_numpy()[who], "pii_kind": kind, "start_pos": np.array(start, np.int64), "end_pos": np.array(end, np.int64)})

    return all_texts(messages, sheets, spans).mapInPandas(search, "src_table string, row_id bigint, pii_kind string, start_pos bigint, end_pos bigint")


def redacted(messages: DataFrame, sheets: DataFrame, spans: DataFrame, addresses: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(src_table, row_id, text, n_items) of each text, with [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] or [PERSON_NAME] for each item."""
    parts, models = trained(messages, sheets, spans, addresses, tokenizer=tokenizer)
    known = (parts.given, parts.family, parts.ends, parts.heads, parts.either)

    def replace(frames):
        own, words = Parts(*known), Vocabulary(tokenizer)
        for p in frames:
            texts = p["text"].tolist()
            pieces: list[list] = [[] for _ in texts]
            for i, kind, s, e in zip(*find_items(texts, own, models, words)):
                pieces[i].append((s, e, kind))
            out = []
            for t, items in zip(texts, pieces):
                for s, e, kind in reversed(items):
                    t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
                out.append(t)
            yield pd.DataFrame({"src_table": p["src_table"], "row_id": p["row_id"], "text": out, "n_items": np.array([len(x) for x in pieces], np.int64)})

    return all_texts(messages, sheets, spans).mapInPandas(replace, "src_table string, row_id bigint, text string, n_items bigint")
