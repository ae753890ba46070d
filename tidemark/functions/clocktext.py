"""Clock texts of many formats, precisions and zones, read as UTC instants in microseconds."""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_S = 86_400
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_MONTH = r"(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_TEXT = re.compile(
    r"""(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?
    (?: (?P<y1>[0-9]{4})-(?P<m1>[0-9]{1,2})-(?P<d1>[0-9]{1,2})
      | (?P<m2>[0-9]{1,2})/(?P<d2>[0-9]{1,2})/(?P<y2>[0-9]{4})
      | (?P<d3>[0-9]{1,2})\.(?P<m3>[0-9]{1,2})\.(?P<y3>[0-9]{4})
      | (?P<d4>[0-9]{1,2})[-\s]"""
    + _MONTH
    + r"""\.?[-\s](?P<y4>[0-9]{4})
    )(?:t|,?\s+)
    (?P<H>[0-9]{1,2}):(?P<M>[0-9]{2})(?::(?P<S>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?
    (?:\s*(?P<half>[ap])\.?m\.?(?![a-z]))?
    \s*(?P<zone>.*)""",
    re.IGNORECASE | re.VERBOSE | re.DOTALL,
)
_PLAIN = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?(Z?)")
_COMPACT = re.compile(r"([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})(?:[.,]([0-9]+))?\s*(.*)", re.IGNORECASE | re.DOTALL)
_OFFSET = re.compile(r"([+\-−])([0-9]{2})(?::?([0-9]{2}))?")
_NAME = re.compile(r"\[([^\[\]]+)\]|([A-Za-z][A-Za-z0-9_+\-/]*)")
_UNIVERSAL = {"Z", "UTC", "GMT", "UT"}
_EPOCH = dt.date(1970, 1, 1).toordinal()

Instants = tuple[int | None, int | None]
NONE: Instants = (None, None)


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ValueError, OSError, KeyError):
        return None


def _offset_at(zone: ZoneInfo, utc_s: int) -> int:
    at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=utc_s)
    return int(at.astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=65_536)
def _offsets_around(name: str, day: int) -> tuple[int, ...]:
    """Offsets in seconds that a zone has from the day before to two days after, found hour by hour."""
    zone = _zone(name)
    try:
        return tuple(sorted({_offset_at(zone, day * DAY_S + h * 3600) for h in range(-24, 49)}))
    except (OverflowError, ValueError):
        return ()


def local_instants(local_s: int, name: str) -> Instants:
    """UTC seconds of a local reading: (instant, None), (earlier, later) where it occurs twice, NONE where it never does."""
    offsets = _offsets_around(name, local_s // DAY_S)
    if len(offsets) == 1:
        return local_s - offsets[0], None
    zone = _zone(name)
    found = sorted({local_s - o for o in offsets if _offset_at(zone, local_s - o) == o})
    if not found:
        return NONE
    return found[0], found[-1] if len(found) > 1 else None


@lru_cache(maxsize=16_384)
def _abbreviations(name: str, year: int) -> dict[str, int]:
    """Abbreviations in use in a zone in a year or beside it, with their offsets in seconds; the nearest year holds."""
    zone, out = _zone(name), {}
    for y in (year, year - 1, year + 1, year - 2, year + 2):
        if 1 < y < 9999:
            for m in range(1, 13):
                at = dt.datetime(y, m, 15, 12, tzinfo=zone)
                out.setdefault(at.tzname().upper(), int(at.utcoffset().total_seconds()))
    return out


@lru_cache(maxsize=65_536)
def _day(y: int, m: int, d: int) -> int | None:
    try:
        return dt.date(y, m, d).toordinal() - _EPOCH
    except ValueError:
        return None


@lru_cache(maxsize=65_536)
def _iso_day(text: str) -> int | None:
    return _day(int(text[:4]), int(text[5:7]), int(text[8:]))


def _micros(fraction: str | None) -> int:
    return int((fraction + "00000")[:6]) if fraction else 0


def read_clock(text: str, feed_zone: str | None) -> Instants:
    """Reads a clock text; feed_zone is the IANA zone of the feed's clock or None.

    Gives (instant, None), (earlier, later) for a local time that occurs twice, or NONE. An offset, zone name or
    abbreviation in the text decides (abbreviations are those of feed_zone; UTC, GMT and Z are universal); 14 digits are
    UTC, 10, 13 and 16 digits seconds, milliseconds and microseconds since 1970. Slashed dates are month first, dotted
    ones day first; missing seconds are 0, digits finer than microseconds are cut. Impossible or missing dates or times,
    local times that never occur and local times without a zone denote nothing.
    """
    m = _PLAIN.fullmatch(text)
    if m is None:
        text = text.strip()
        m = _PLAIN.fullmatch(text)
    if m is not None:
        date, hh, mi, ss, f, z = m.groups()
        day, h, i, s = _iso_day(date), int(hh), int(mi), int(ss)
        if day is None or h > 23 or i > 59 or s > 59:
            return NONE
        local = day * DAY_S + h * 3600 + i * 60 + s
        if z:
            return local * 1_000_000 + _micros(f), None
        return _scaled(local_instants(local, feed_zone) if feed_zone and _zone(feed_zone) else NONE, _micros(f))
    if text.isascii() and text.isdigit():
        if len(text) == 14:
            day, h, i, s = _day(int(text[:4]), int(text[4:6]), int(text[6:8])), int(text[8:10]), int(text[10:12]), int(text[12:])
            return NONE if day is None or h > 23 or i > 59 or s > 59 else ((day * DAY_S + h * 3600 + i * 60 + s) * 1_000_000, None)
        scale = {10: 1_000_000, 13: 1000, 16: 1}.get(len(text))
        return (int(text) * scale, None) if scale else NONE
    half = None
    if m := _TEXT.fullmatch(text):
        g = m.groupdict()
        if g["y1"]:
            y, mo, d = g["y1"], g["m1"], g["d1"]
        elif g["y2"]:
            y, mo, d = g["y2"], g["m2"], g["d2"]
        elif g["y3"]:
            y, mo, d = g["y3"], g["m3"], g["d3"]
        else:
            y, mo, d = g["y4"], _MONTHS[g["mon"].lower()], g["d4"]
        hh, mi, ss, f, zone, half = g["H"], g["M"], g["S"], g["f"], g["zone"], g["half"]
    elif m := _COMPACT.fullmatch(text):
        y, mo, d, hh, mi, ss, f, zone = m.groups()
    else:
        return NONE
    day, h, i, s = _day(int(y), int(mo), int(d)), int(hh), int(mi), int(ss or 0)
    if half:
        if not 1 <= h <= 12:
            return NONE
        h = h % 12 + (12 if half in "pP" else 0)
    if day is None or h > 23 or i > 59 or s > 59:
        return NONE
    local = day * DAY_S + h * 3600 + i * 60 + s
    return _scaled(_zoned(local, zone.strip(), feed_zone, int(y)), _micros(f))


def _scaled(at: Instants, micros: int) -> Instants:
    return tuple(None if x is None else x * 1_000_000 + micros for x in at)


def _zoned(local: int, zone: str, feed_zone: str | None, year: int) -> Instants:
    feed = feed_zone if feed_zone and _zone(feed_zone) else None
    if not zone:
        return local_instants(local, feed) if feed else NONE
    if zone.upper() in _UNIVERSAL:
        return local, None
    if m := _OFFSET.fullmatch(zone):
        h, i = int(m[2]), int(m[3] or 0)
        if h > 18 or i > 59:
            return NONE
        return local - (1 if m[1] == "+" else -1) * (h * 3600 + i * 60), None
    if m := _NAME.fullmatch(zone):
        name = m[1] or m[2]
        if feed and (offset := _abbreviations(feed, year).get(name.upper())) is not None:
            return local - offset, None
        if ("/" in name or m[1]) and _zone(name):
            return local_instants(local, name)
    return NONE


def choose(early: int | None, late: int | None, seen: int | None) -> int | None:
    """Of a local time that occurs twice the later instant not after the row's first_seen_at, else the earlier."""
    return late if late is not None and seen is not None and late <= seen else early


INSTANTS = T.StructType([T.StructField("early", T.LongType()), T.StructField("late", T.LongType())])


@F.pandas_udf(INSTANTS)
def _instants(text: pd.Series, zone: pd.Series) -> pd.DataFrame:
    out = [NONE if t is None else read_clock(t, z) for t, z in zip(text, zone)]
    return pd.DataFrame(
        {
            "early": pd.array([a for a, _ in out], dtype="Int64"),
            "late": pd.array([b for _, b in out], dtype="Int64"),
        }
    )


def clock_instants(text: Column, zone: Column) -> Column:
    """struct(early, late) of clock texts; see read_clock. A filter on the result isn't pushed below it, so that each
    text is read once."""
    return _instants.asNondeterministic()(text, zone)


@F.pandas_udf(T.LongType())
def _instant(text: pd.Series, zone: pd.Series, seen: pd.Series) -> pd.Series:
    out = []
    known = seen.notna().to_numpy()
    times = seen.fillna(0).to_numpy(np.int64)
    for k, (t, z) in enumerate(zip(text, zone)):
        a, b = NONE if t is None else read_clock(t, z)
        out.append(b if b is not None and known[k] and b <= times[k] else a)
    return pd.Series(pd.array(out, dtype="Int64"))


def clock_instant(text: Column, zone: Column, seen_us: Column) -> Column:
    """The row's instant in microseconds, read without a dictionary (for tables whose texts hardly repeat), once a row as
    above."""
    return _instant.asNondeterministic()(text, zone, seen_us)
