"""Reading of written points in time: one pass of one pattern over each text."""

from __future__ import annotations

import re
from datetime import date

import numpy as np
import pandas as pd

# Names of months by language, and the offsets in minutes of zone abbreviations that several zones share.
_ENGLISH = "january february march april may june july august september october november december"
_GERMAN = "januar februar märz april mai juni juli august september oktober november dezember"
_FRENCH = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
_SPANISH = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
_FIXED_ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "AEST": 600, "AEDT": 660,
}


def _abbreviations() -> dict[str, int]:
    """Offsets in minutes by abbreviation: those of the tz database that mean one offset in all its zones, and the fixed ones."""
    from datetime import datetime
    from zoneinfo import ZoneInfo, available_timezones

    seen: dict[str, set[int]] = {}
    for zone in available_timezones():
        tz = ZoneInfo(zone)
        for month in (1, 7):
            day = datetime(2024, month, 1, tzinfo=tz)
            name = day.tzname() or ""
            if "/" in zone and name.isalpha() and name.isupper() and 3 <= len(name) <= 5:
                seen.setdefault(name, set()).add(int(day.utcoffset().total_seconds()) // 60)
    return {name: min(x) for name, x in seen.items() if len(x) == 1} | _FIXED_ABBREVIATIONS


_ABBREVIATIONS = _abbreviations()

MONTHS: dict[str, int] = {}
for _names in (_ENGLISH, _GERMAN, _FRENCH, _SPANISH):
    for _n, _name in enumerate(_names.split(), 1):
        MONTHS[_name] = _n
        MONTHS.setdefault(_name[:3], _n)
MONTHS |= {"sept": 9, "maerz": 3, "fevrier": 2, "aout": 8, "decembre": 12, "mär": 3, "mrz": 3}

_M = "|".join(sorted(MONTHS, key=len, reverse=True))
_CLOCK = r"(?P<{0}h>\d{{1,2}}):(?P<{0}m>\d\d)(?::(?P<{0}s>\d\d)(?:[.,](?P<{0}f>\d+))?)?"
_ABBR = "|".join(sorted(_ABBREVIATIONS, key=len, reverse=True))
_ZONE = r"(?:\s*\[(?P<{0}z>[A-Za-z0-9_+\-/]+)\]|\s+\(?(?P<{0}y>(?-i:[A-Z])[A-Za-z]+/[A-Za-z0-9_+\-/]+)\)?)?"
_TAIL = rf"(?:\s*(?P<{{0}}o>Z\b|[+-]\d\d:?\d\d\b|[+-]\d\d\b)|\s+\(?(?P<{{0}}a>(?-i:{_ABBR}))\b\)?)?" + _ZONE
_HALF = r"(?:\s*(?P<{0}p>[ap])\.?m\b\.?)"
# an hour alone is a time of day only with its half of the day or with the word for hours
_BARE_HALF = r"(?P<{0}H>\d{{1,2}})\s?(?P<{0}P>[ap])\.?m\b\.?"
_BARE_UHR = r"(?P<{0}U>\d{{1,2}})(?:\.(?P<{0}u>\d\d))?\s?Uhr\b"


def _form(tag: str, day: str, between: str, half: str = "", bare: str = "") -> str:
    clock = _CLOCK.format(tag) + half.format(tag)
    return day + between + (f"(?:{clock}|{bare.format(tag)})" if bare else clock) + _TAIL.format(tag)


_FORMS = "|".join(
    f"(?P<{tag}>{form})"
    for tag, form in zip(
        "icrfesd",
        (
            _form("i", r"(?<!\d)(?P<iY>\d{4})-(?P<iM>\d\d)-(?P<iD>\d\d)", r"(?:[T]|\s+)"),
            r"(?<!\d)(?P<cY>\d{4})(?P<cM>\d\d)(?P<cD>\d\d)T(?P<ch>\d\d)(?P<cm>\d\d)(?P<cs>\d\d)?(?P<co>Z\b|[+-]\d\d:?\d\d\b)?(?![\d])",
            _form("r", rf"(?<![\w.])(?P<rD>\d{{1,2}})(?:\.\s*|-|\s+)(?:de\s+)?(?P<rN>{_M})\.?(?:-|\s+)(?:de\s+)?(?P<rY>\d{{4}}|\d\d)", r",?\s+(?:(?:um|at|a\s+las)\s+)?", _HALF + "?", f"{_BARE_HALF}|{_BARE_UHR}"),
            rf"(?<![\w.])(?P<fD>\d{{1,2}})(?:er)?\s+(?P<fN>{_M})\.?\s+(?P<fY>\d{{4}})\s+(?:à\s+)?(?P<fh>\d{{1,2}})\s?h(?:\s?(?P<fm>\d\d)(?!\d)|\b)",
            _form("e", rf"(?<!\w)(?P<eN>{_M})\.?\s+(?P<eD>\d{{1,2}}),?\s+(?P<eY>\d{{4}})", r",?\s+(?:at\s+)?", _HALF + "?", _BARE_HALF),
            _form("s", r"(?<![\d/])(?P<sM>\d{1,2})/(?P<sD>\d{1,2})/(?P<sY>\d{4}|\d\d)", r",?\s+(?:at\s+)?", _HALF + "?", _BARE_HALF),
            _form("d", r"(?<![\d.])(?P<dD>\d{1,2})\.(?P<dM>\d{1,2})\.(?P<dY>\d{4}|\d\d)", r",?\s+(?:um\s+)?", "", _BARE_UHR),
        ),
    )
)
_PATTERN = re.compile(_FORMS, re.IGNORECASE)
_PARTS = {t: [k[1:] for k in _PATTERN.groupindex if k[0] == t and len(k) > 1] for t in "icrfesd"}
_UNKNOWN_ZONE = re.compile(r"\s+\(?(?!UHR|HRS)[A-Z]{2,5}\)?\s*$")
_EPOCH_UNIT = {10: 1_000_000, 13: 1_000, 16: 1}
_DAY0 = date(1970, 1, 1).toordinal()


def _offset(text: str) -> int | None:
    if text in "Zz":
        return 0
    digits = text[1:].replace(":", "").ljust(4, "0")
    hours, minutes = int(digits[:2]), int(digits[2:])
    if hours > 18 or minutes > 59:
        return None
    return (hours * 60 + minutes) * (-60 if text[0] == "-" else 60)


def read_instant(text: str, whole: bool) -> tuple[int, int | None, str | None] | None:
    """(local microseconds since 1970, offset in seconds or None, zone named or None), or None.

    whole: the text is nothing but the date, so a bare number counts from 1970. Otherwise
    the first date with a time of day in the text is read.
    """
    if whole:
        text = text.strip()
        if text.isascii() and text.lstrip("-").isdigit():
            unit = _EPOCH_UNIT.get(len(text.lstrip("-")))
            if unit is None and len(text) < 10:
                unit = 1_000_000
            if unit is None:
                return (int(text[:-3]), 0, None) if len(text) == 19 else None
            return int(text) * unit, 0, None
    for m in _PATTERN.finditer(text):
        t = m.lastgroup
        g = {k: m[t + k] for k in _PARTS[t]}
        if whole and text[: m.start()].strip(" ,") and not re.fullmatch(r"[^\W\d]+\.?,?\s*", text[: m.start()]):
            continue
        year, day = int(g["Y"]), int(g["D"])
        if len(g["Y"]) == 2:
            year += 2000 if year < 70 else 1900
        month = MONTHS[g["N"].lower()] if t in "rfe" else int(g["M"])
        hour, minute, second = int(g["h"] or g.get("H") or g.get("U")), int(g["m"] or g.get("u") or 0), int(g.get("s") or 0)
        half = g.get("p") or g.get("P")
        if half:
            if not 1 <= hour <= 12:
                continue
            hour = hour % 12 + (12 if half in "pP" else 0)
        if hour > 23 or minute > 59 or second > 59:
            continue
        try:
            days = date(year, month, day).toordinal() - _DAY0
        except ValueError:
            continue
        offset, stated = None, g.get("o")
        if stated:
            offset = _offset(stated)
            if offset is None:
                continue
        elif g.get("a"):
            offset = _ABBREVIATIONS[g["a"]] * 60
        elif whole and _UNKNOWN_ZONE.match(text, m.end()):
            continue  # a zone that nobody knows is stated, so the time isn't local
        micros = int((g.get("f") or "0")[:6].ljust(6, "0"))
        return ((days * 24 + hour) * 60 + minute) * 60_000_000 + second * 1_000_000 + micros, offset, g.get("z") or g.get("y")
    return None


def read_many(texts: pd.Series, whole: bool) -> pd.DataFrame:
    rows = [read_instant(x, whole) if isinstance(x, str) else None for x in texts]
    none = (None, None, None)
    local, offset, zone = zip(*(r or none for r in rows)) if rows else ((), (), ())
    return pd.DataFrame({"local": pd.array(local, dtype="Int64"), "offset": pd.array(offset, dtype="Int32"), "zone": pd.Series(zone, dtype=object)})


def zone_segments(zone: str, first_year: int, last_year: int) -> list[tuple[int, int, int, int]]:
    """(local from, local until, offsets that match, offset in seconds) over the local time line of a zone.

    Two matches are a repeated local time and carry the earlier offset, none is a skipped
    one and carries the offset in force before the change. Times are microseconds.
    """
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    tz = ZoneInfo(zone)

    def at(s: int) -> int:
        return int(datetime.fromtimestamp(s, timezone.utc).astimezone(tz).utcoffset().total_seconds())

    start, end = ((date(y, 1, 1).toordinal() - _DAY0) * 86400 for y in (first_year, last_year + 1))
    changes, s, now = [], start, at(start)
    while s < end:
        nxt = s + 5 * 86400
        if at(nxt) != now:
            lo, hi = s, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
            after = at(hi)
            changes.append((hi, now, after))
            now, nxt = after, hi
        s = nxt
    big = 1 << 62
    out, since = [], -big
    for when, before, after in changes:
        a, b = (when + before) * 1_000_000, (when + after) * 1_000_000
        if after > before:  # skipped
            out += [(since, a, 1, before), (a, b, 0, before)]
        else:  # repeated
            out += [(since, b, 1, before), (b, a, 2, before)]
        since = max(a, b)
    out.append((since, big, 1, changes[-1][2] if changes else now))
    return [x for x in out if x[0] < x[1]]


def segments_by_year(zones: list[str], first_year: int, last_year: int) -> pd.DataFrame:
    """The segments of the zones, once for each local year that they touch."""
    years = np.array([(date(y, 1, 1).toordinal() - _DAY0) * 86_400_000_000 for y in range(first_year, last_year + 2)])
    rows = []
    for z in zones:
        for lo, hi, n, offset in zone_segments(z, first_year, last_year):
            a = max(0, int(np.searchsorted(years, lo, "right")) - 1)
            b = min(last_year - first_year, int(np.searchsorted(years, hi - 1, "right")) - 1)
            rows += [(z, first_year + y, lo, hi, n, offset) for y in range(a, b + 1)]
    return pd.DataFrame(rows, columns=["_zone", "_year", "_lo", "_hi", "_matches", "_shift"])
