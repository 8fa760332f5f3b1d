"""Dates and times in announcements: a bounded grammar, and the choice of one.

Understood: weekdays (this, next, on), today, tonight, tomorrow, `M/D[/Y]`,
`Mon D[, Y]`, `D Mon`, ISO dates; times `H[:MM] am|pm`, `H:MM`, `noon`,
`midnight`, ranges of times with `-`, `to`, `until`. A date and a time that
stand together, in either order, are one mention. Not understood: ordinals
without a month, week numbers, holidays, spelt-out numbers.

The clock is the campus wall clock of the time of sending; dates without a year
are the next that come.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

ZONE = ZoneInfo(fixed.TIME_ZONE)
_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAY = r"(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs?(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_CLOCK = r"(?:\d{1,2}(?::\d{2})?\s*(?:a\.?m\.?|p\.?m\.?)(?![a-z])|\d{1,2}:\d{2}(?!\d)|noon|midnight)"
_LATER = rf"(?:{_CLOCK}|\d{{1,2}}(?![\d/:]))"
_TIME = rf"(?P<time>(?:(?P<from>\d{{1,2}}(?::\d{{2}})?(?:\s*[ap]\.?m\.?(?![a-z]))?|noon|midnight)\s*(?:-|–|—|to|until)\s*(?P<to>{_CLOCK}))|(?:(?:@|\bat)\s*(?P<at>\d{{1,2}}(?::\d{{2}})?(?:\s*[ap]\.?m\.?(?![a-z]))?))(?:\s*(?:-|–|—|to|until)\s*(?P<atto>{_LATER}))?|(?P<plain>{_CLOCK})(?:\s*(?:-|–|—|to|until)\s*(?P<plainto>{_LATER}))?)"
_DATE = rf"(?P<date>(?P<iso>\d{{4}}-\d{{2}}-\d{{2}})|(?P<near>today|tonight|tomorrow|tmrw)\b|(?:(?P<which>this|next|on)\s+)?\b(?P<weekday>{_DAY})\b(?:,?\s+(?:(?P<wm>{_MONTH})\.?\s+(?P<wd>\d{{1,2}})(?:st|nd|rd|th)?|\(?(?P<wsm>\d{{1,2}})/(?P<wsd>\d{{1,2}})\)?))?|\b(?P<month>{_MONTH})\.?\s+(?P<day>\d{{1,2}})(?:st|nd|rd|th)?(?!\d|:)(?:,?\s+(?P<year>\d{{4}}))?|\b(?P<day2>\d{{1,2}})(?:st|nd|rd|th)?\s+(?P<month2>{_MONTH})\b|(?<![\d/])(?P<sm>\d{{1,2}})/(?P<sd>\d{{1,2}})(?:/(?P<sy>\d{{2,4}}))?(?![\d/]))"
DATE, TIME = re.compile(_DATE, re.I), re.compile(_TIME, re.I)
#: What may stand between a date and its time.
_JOINT = re.compile(r"[\s,;|()@–—-]*(?:at|from|@)?[\s(]*", re.I)
_RELATIVE, _DEADLINE = (re.compile(p, re.I | re.A) for p in (fixed.RELATIVE, fixed.DEADLINE_TIME))


@dataclass
class Mention:
    text: str
    at: int
    day: datetime | None  # midnight of a local day
    start: tuple[int, int, bool] | None  # hour, minute, whether am or pm was said
    end: tuple[int, int, bool] | None


def _clock(text: str | None) -> tuple[int, int, bool] | None:
    if not text:
        return None
    text = text.lower().strip()
    if text in ("noon", "midnight"):
        return (12 if text == "noon" else 0), 0, True
    m = re.match(r"(\d{1,2})(?::(\d{2}))?\s*([ap])?", text)
    hour, minute, half = int(m.group(1)), int(m.group(2) or 0), m.group(3)
    if hour > 23 or minute > 59 or half and not 1 <= hour <= 12:
        return None
    if half:
        hour = hour % 12 + (12 if half == "p" else 0)
    return hour, minute, bool(half) or hour > 12


def _civil(year: int, month: int, day: int) -> datetime | None:
    try:
        return datetime(year, month, day)
    except ValueError:
        return None


def _next(month: int, day: int, today: datetime) -> datetime | None:
    """The day of this or the next year that isn't past."""
    found = _civil(today.year, month, day)
    return _civil(today.year + 1, month, day) if found and found < today else found


def _day(m: re.Match, now: datetime) -> datetime | None:
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    g = m.groupdict()
    month = lambda s: _MONTHS.index(s[:3].lower()) + 1
    if g["iso"]:
        return _civil(*map(int, g["iso"].split("-")))
    if g["near"]:
        return today + timedelta(days=g["near"].lower() in ("tomorrow", "tmrw"))
    if g["weekday"]:
        if g["wm"]:
            return _next(month(g["wm"]), int(g["wd"]), today)
        if g["wsm"]:
            return _next(int(g["wsm"]), int(g["wsd"]), today)
        ahead = (_DAYS.index(g["weekday"][:3].lower()) - today.weekday()) % 7
        if (g["which"] or "").lower() == "next":
            ahead += 7 if ahead == 0 or today.weekday() < 5 and ahead < 7 - today.weekday() else 0
        return today + timedelta(days=ahead)
    if g["month"]:
        return _civil(int(g["year"]), month(g["month"]), int(g["day"])) if g["year"] else _next(month(g["month"]), int(g["day"]), today)
    if g["month2"]:
        return _next(month(g["month2"]), int(g["day2"]), today)
    if g["sy"]:
        year = int(g["sy"])
        return _civil(year + 2000 if year < 100 else year, int(g["sm"]), int(g["sd"]))
    return _next(int(g["sm"]), int(g["sd"]), today)


def mentions(text: str, now: datetime) -> list[Mention]:
    """Dates and times in order of place, joined where they stand together."""
    dates = [(m.start(), m.end(), d) for m in DATE.finditer(text) if (d := _day(m, now))]
    times = []
    for m in TIME.finditer(text):
        g = m.groupdict()
        start, end = _clock(g["from"] or g["at"] or g["plain"]), _clock(g["to"] or g["atto"] or g["plainto"])
        if start and end and end[2] and not start[2] and g["from"]:
            # "4:30-6pm": the first takes the half of the day that puts it before the second.
            hour = start[0] % 12 + (12 if end[0] >= 12 else 0)
            start = (hour if (hour, start[1]) < end[:2] else start[0], start[1], True)
        if start and not any(a < m.end() and m.start() < b for a, b, _ in dates):
            times.append((m.start(), m.end(), start, end))
    out, used = [], set()
    for a, b, day in dates:
        near = None
        for k, (x, y, *_) in enumerate(times):
            if k not in used and (x >= b and _JOINT.fullmatch(text[b:x]) or y <= a and re.fullmatch(r"[\s,;|(]*(?:on)?[\s(]*", text[y:a], re.I)):
                near = k
                break
        if near is None:
            out.append(Mention(text[a:b], a, day, None, None))
        else:
            used.add(near)
            x, y, start, end = times[near]
            out.append(Mention(text[min(a, x) : max(b, y)], min(a, x), day, start, end))
    out += [Mention(text[x:y], x, None, start, end) for k, (x, y, start, end) in enumerate(times) if k not in used]
    return sorted(out, key=lambda m: m.at)


def _instant(day: datetime, hour: int, minute: int) -> datetime:
    """UTC of a local time; hours past midnight add absolute time."""
    over, hour = divmod(hour, 24)
    local = day.replace(hour=hour, minute=minute)
    guess = local.replace(tzinfo=timezone.utc)
    first = guess - guess.astimezone(ZONE).utcoffset()
    return guess - first.astimezone(ZONE).utcoffset() + timedelta(days=over)


def pick(subject: str, body: str, sent_at: datetime) -> tuple[datetime, datetime | None, bool, bool] | None:
    """(start, end, exact, in subject) in UTC of the mention that is the event's, or None."""
    sent = sent_at.replace(tzinfo=timezone.utc) if sent_at.tzinfo is None else sent_at.astimezone(timezone.utc)
    now = sent.astimezone(ZONE).replace(tzinfo=None)
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    found = []
    for text, in_subject in ((subject or "", True), ((body or "")[:6000], False)):
        for m in mentions(text, now):
            if _RELATIVE.search(m.text) or _DEADLINE.search(m.text):
                continue
            # A bare hour from one to seven is in the afternoon or evening.
            shift = 12 if m.start and not m.start[2] and 1 <= m.start[0] <= 7 else 0
            day = m.day or today
            if m.start:
                start = _instant(day, m.start[0] + shift, m.start[1])
                if not m.day and start < sent:
                    start = _instant(day + timedelta(days=1), m.start[0] + shift, m.start[1])
            else:
                start = _instant(day, 12, 0)
            if not sent - timedelta(hours=6) <= start <= sent + timedelta(days=180):
                continue
            end = None
            if m.end:
                clock = m.end[0] + (0 if m.end[2] else 12 if shift and m.end[0] <= 11 else 0), m.end[1]
                end = _instant(day, *clock)
                if end < start:  # "9pm - 1am" ends on the next day
                    end = _instant(day + timedelta(days=1), *clock)
                end = end if end > start else None
            found.append((start, end, bool(m.start), in_subject))
    if not found:
        return None
    exact = [f for f in found if f[2]]
    titled = next((f for f in found if f[3]), None)
    if titled and not titled[2]:
        day = titled[0].astimezone(ZONE).date()
        same = next((f for f in exact if f[0].astimezone(ZONE).date() == day), None)
        if same:
            return same
    return exact[0] if exact else found[0]


PICK = T.StructType([T.StructField("starts_at", T.TimestampType()), T.StructField("ends_at", T.TimestampType()), T.StructField("exact", T.BooleanType()), T.StructField("in_subject", T.BooleanType())])


def pick_column(subject, body, sent_at):
    """struct as PICK, its fields null where no mention is found."""

    @F.pandas_udf(PICK)
    def run(subjects: pd.Series, bodies: pd.Series, times: pd.Series) -> pd.DataFrame:
        rows = [pick(s or "", b or "", t.to_pydatetime()) if not pd.isna(t) else None for s, b, t in zip(subjects, bodies, times)]
        plain = lambda t: None if t is None else pd.Timestamp(t).tz_convert("UTC")
        return pd.DataFrame({
            "starts_at": pd.Series([plain(r[0]) if r else None for r in rows], dtype="datetime64[us, UTC]"),
            "ends_at": pd.Series([plain(r[1]) if r else None for r in rows], dtype="datetime64[us, UTC]"),
            "exact": pd.Series([r[2] if r else None for r in rows], dtype=object), "in_subject": pd.Series([r[3] if r else None for r in rows], dtype=object),
        })

    return run(subject, body, sent_at)
