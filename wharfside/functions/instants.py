"""One UTC instant from one written time (plain Python, used inside an Arrow function)."""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

#: Raised whenever ``utc_micros`` reads a text in another way than before, so that kept dictionaries are begun anew.
RULES = 2
#: Years between which a bare number must lie; they tell its unit. Written dates may lie in any year. Fixed values.
FIRST_YEAR, LAST_YEAR = 1980, 2100

#: Zone abbreviations with one meaning wherever they are written, in minutes east of UTC; used where the host's own zone doesn't know the name. Fixed values.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "BRST": -120, "NPT": 345, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_TIME = r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2})(?:[.,](?P<fraction>\d+))?)?(?:\s?(?P<half>[ap])\.?m\b\.?)?"
_BASIC = r"(?P<hour>\d{2})(?P<minute>\d{2})(?P<second>\d{2})?(?:[.,](?P<fraction>\d+))?"
_ZONE = r"\s*(?P<zone>(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?\s*(?:\[(?P<named>[a-z][a-z0-9_+/-]*)\])?"
_GAP = r"(?:t|,?\s+(?:at\s+)?)"
_NAME = r"(?:[a-z]{3,9}\.?,?\s+)?"
#: Ordered alternatives; the first that fits the whole value decides.
_FORMS = [
    re.compile(p + _ZONE)
    for p in (
        rf"(?P<year>\d{{4}})(?P<mark>[-/.])(?P<month>\d{{1,2}})(?P=mark)(?P<day>\d{{1,2}}){_GAP}{_TIME}",
        rf"(?P<year>\d{{4}})(?P<month>\d{{2}})(?P<day>\d{{2}}){_GAP}{_BASIC}",
        rf"(?P<year>\d{{4}})(?P<month>\d{{2}})(?P<day>\d{{2}}){_GAP}{_TIME}",
        rf"(?P<year>\d{{4}})-?w(?P<week>\d{{2}})-?(?P<weekday>\d){_GAP}(?:{_TIME})",
        rf"(?P<year>\d{{4}})-?(?P<ordinal>\d{{3}}){_GAP}{_TIME}",
        rf"(?P<one>\d{{1,2}})(?P<mark>[-/.])(?P<two>\d{{1,2}})(?P=mark)(?P<three>\d{{4}}|\d{{2}}){_GAP}{_TIME}",
        rf"{_NAME}(?P<day>\d{{1,2}})(?:st|nd|rd|th)?[\s-](?P<name>[a-z]{{3,9}})\.?,?[\s-](?P<year>\d{{4}}){_GAP}{_TIME}",
        rf"{_NAME}(?P<name>[a-z]{{3,9}})\.?\s+(?P<day>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<year>\d{{4}}){_GAP}{_TIME}",
    )
]
_NUMBER = re.compile(r"(\d{9,20})(?:[.,](\d+))?")


@lru_cache(1)
def _zone_names() -> dict[str, str]:
    return {name.lower(): name for name in sorted(available_timezones())}


@lru_cache(4096)
def zone_of(name: str) -> ZoneInfo | None:
    """The zone of an IANA name in any letter case, None when there is none."""
    known = _zone_names().get(name.lower())
    return ZoneInfo(known) if known else None


@lru_cache(4096)
def own_abbreviations(name: str, year: int) -> dict[str, int]:
    """The abbreviations that a zone uses in a year, in minutes east of UTC."""
    out: dict[str, int] = {}
    if zone := zone_of(name):
        for days in range(0, 365, 7):
            at = datetime(year, 1, 1, 12, tzinfo=zone) + timedelta(days=days)
            if (label := at.tzname() or "").isalpha():
                out[label.upper()] = int((at.utcoffset() or timedelta()).total_seconds()) // 60
    return out


def _micros(at: datetime, fraction: int) -> int:
    return (at - _EPOCH) // timedelta(microseconds=1) + fraction


def _of_local(wall: datetime, zone: ZoneInfo) -> datetime | None:
    """The instant at which a zone's clocks show ``wall``; None when they never do or do twice."""
    fits = set()
    for fold in (0, 1):
        at = wall.replace(tzinfo=zone, fold=fold).astimezone(UTC)
        if at.astimezone(zone).replace(tzinfo=None) == wall:
            fits.add(at)
    return fits.pop() if len(fits) == 1 else None


def _year(text: str) -> int:
    return 2000 + int(text) if len(text) == 2 else int(text)


def _numeric_day(one: int, two: int, three: str, order: str) -> date | None:
    """Day of numbers whose order the text may leave open; without an order only where one reading is possible."""
    if order == "ymd" and len(three) == 2:
        return date(2000 + one, two, int(three))
    year = _year(three)
    if one > 12 or two > 12 or one == two:
        day, month = (one, two) if one > 12 else (two, one)
    elif order:
        day, month = (one, two) if order == "dmy" else (two, one)
    else:
        return None
    return date(year, month, day)


def _day_of(g: dict[str, str | None], order: str) -> date | None:
    if g.get("week"):
        return date.fromisocalendar(int(g["year"] or 0), int(g["week"] or 0), int(g["weekday"] or 0))
    if g.get("ordinal"):
        first = date(int(g["year"] or 0), 1, 1)
        day = first + timedelta(days=int(g["ordinal"] or 0) - 1)
        return day if day.year == first.year else None
    if g.get("three"):
        return _numeric_day(int(g["one"] or 0), int(g["two"] or 0), g["three"] or "", order)
    if name := g.get("name"):
        months = [i for i, m in enumerate(MONTHS, 1) if m.startswith(name) or name == "sept" == m[:4]]
        if len(months) != 1:
            return None
        return date(int(g["year"] or 0), months[0], int(g["day"] or 0))
    return date(int(g["year"] or 0), int(g["month"] or 0), int(g["day"] or 0))


def _offset(text: str, tz_name: str, year: int) -> int | None:
    """Minutes east of UTC of a written zone; None when it has no meaning."""
    if m := re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", text):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 15 or minutes > 59:
            return None
        return (hours * 60 + minutes) * (-1 if m[1] == "-" else 1)
    label = text.upper()
    if label in ("Z", "UTC", "GMT"):
        return 0
    return own_abbreviations(tz_name, year).get(label, ABBREVIATIONS.get(label))


def utc_micros(raw: str | None, tz_name: str | None, order: str | None) -> int | None:
    """Microseconds since 1970 UTC of the one instant that ``raw`` names, else None.

    ``tz_name`` and ``order`` ('dmy', 'mdy', 'ymd') settle what the text
    leaves open. Digits finer than a microsecond are cut off; values without
    a time of day, impossible dates and times, and local times in a gap or fold
    of the zone's clocks give None. A written date may lie in any year; a bare
    number is read in the unit that puts it into FIRST_YEAR to LAST_YEAR.
    """
    if not raw:
        return None
    text = unicodedata.normalize("NFKC", raw).replace("−", "-").strip().lower()
    if m := _NUMBER.fullmatch(text):
        for digits in (0, 3, 6, 9):
            whole = int(m[1])
            seconds = whole // 10**digits
            if FIRST_YEAR <= 1970 + seconds / 31556952 <= LAST_YEAR + 1:
                scaled = int((m[1] + (m[2] or "") + "0" * 9)[: len(m[1]) + 9])  # nine more digits of the unit
                us = scaled * 1000 // 10 ** (digits + 6)
                return _micros(_EPOCH + timedelta(seconds=us // 10**6), us % 10**6)
        return None
    for form in _FORMS:
        if m := form.fullmatch(text):
            break
    else:
        return None
    g = m.groupdict()
    try:
        day = _day_of(g, order or "")
        if day is None:
            return None
        hour = int(g["hour"])
        if half := g.get("half"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if half == "p" else 0)
        wall = datetime(day.year, day.month, day.day, hour, int(g["minute"]), int(g["second"] or 0))
    except ValueError:
        return None
    fraction = int(((g["fraction"] or "") + "000000")[:6])
    try:
        if g["zone"]:
            minutes = _offset(g["zone"], tz_name or "", wall.year)
            if minutes is None:
                return None
            return _micros(wall.replace(tzinfo=timezone(timedelta(minutes=minutes))).astimezone(UTC), fraction)
        zone = zone_of(g["named"] or tz_name or "")
        at = _of_local(wall, zone) if zone else None
    except OverflowError:
        return None
    return None if at is None else _micros(at, fraction)
