"""What a run may ask a provider for, read from files that hold no credentials, and the pace of its requests."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from tidemark.functions.calendar import US_EQUITY

# fixed values: bounds of a request, and names that belong into the environment
MOST_MINUTE_DAYS, MOST_DAILY_DAYS, MOST_SECURITIES, MOST_DATES, MOST_CACHE_HOURS = 31, 90, 10, 23, 168
LEAST_LAG_MINUTES, MOST_LAG_MINUTES = 15, 1_440
SECRET_NAMES = ("api_key", "api_secret", "key_id", "secret_key", "token", "password")
_TICKER, _NAME = re.compile(r"[A-Z][A-Z0-9.]{0,9}"), re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class SettingsError(ValueError):
    """Settings that a run refuses, with every reason."""


@dataclass(frozen=True)
class Request:
    """Ranges are half open; securities are (security_id, ticker)."""

    minute: tuple[datetime, datetime]
    daily: tuple[datetime, datetime]
    securities: tuple[tuple[str, str], ...]
    dates: tuple[date, ...]
    feed: str = "iex"
    adjustment: str = "raw"
    sessions: tuple[str, ...] = ("premarket", "regular")
    lag_minutes: int = 15
    pages: int = 100
    page_rows: int = 10_000
    cache_hours: float = 24

    def problems(self, now: datetime) -> list[str]:
        """Every reason against the request; empty for a sound one."""
        out = []
        at = [now, *self.minute, *self.daily]
        if any(t.tzinfo is None or t.utcoffset() != timedelta(0) for t in at):
            return ["times must be UTC"]
        (a, z), (p, q) = self.minute, self.daily
        out += ["an empty range"] * (not a < z or not p < q)
        out += ["the minute range is too long"] * (z - a > timedelta(days=MOST_MINUTE_DAYS))
        out += ["the daily range is too long"] * (q - p > timedelta(days=MOST_DAILY_DAYS))
        out += ["the daily range must hold the minute range"] * (not (p <= a and z <= q))
        out += ["the lag is out of bounds"] * (not LEAST_LAG_MINUTES <= self.lag_minutes <= MOST_LAG_MINUTES)
        out += ["the end isn't public yet"] * (max(z, q) > now - timedelta(minutes=self.lag_minutes))
        ids, tickers = [s for s, _ in self.securities], [t for _, t in self.securities]
        out += [f"from 1 to {MOST_SECURITIES} securities"] * (not 1 <= len(ids) <= MOST_SECURITIES)
        out += ["a security twice"] * (len(set(ids)) < len(ids) or len(set(tickers)) < len(tickers))
        out += ["a security without id"] * any(not s.strip() for s in ids)
        out += [f"no ticker: {t!r}" for t in tickers if not _TICKER.fullmatch(t)]
        out += ["feed must be iex or sip"] * (self.feed not in ("iex", "sip"))
        out += ["adjustment must be raw or split"] * (self.adjustment not in ("raw", "split"))
        out += ["no such sessions"] * (not self.sessions or len(set(self.sessions)) < len(self.sessions) or not set(self.sessions) <= {"premarket", "regular"})
        out += [f"from 1 to {MOST_DATES} dates"] * (not 1 <= len(self.dates) <= MOST_DATES)
        out += ["a date twice"] * (len(set(self.dates)) < len(self.dates))
        out += [f"no session on {d}" for d in self.dates if d.weekday() > 4 or d.isoformat() in US_EQUITY.holidays]
        out += [f"{d} is out of range" for d in self.dates if not a.date() <= d <= (z - timedelta(microseconds=1)).date()]
        out += ["page bounds"] * (not 1 <= self.pages <= 100 or not 1 <= self.page_rows <= 10_000)
        out += ["the cache's age is out of bounds"] * (not 0 < self.cache_hours <= MOST_CACHE_HOURS)
        return out

    def validate(self, now: datetime) -> None:
        if problems := self.problems(now):
            raise SettingsError("; ".join(problems))


def environment(path: Path, process: Mapping[str, str]) -> dict[str, str]:
    """Variables of a dotenv file beside those of the process, which win. Values are taken as they stand."""
    out: dict[str, str] = {}
    for k, line in enumerate(path.read_text("utf-8-sig").splitlines() if path.exists() else [], 1):
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#"):
            continue
        name, eq, value = line.partition("=")
        name, value = name.strip(), value.strip()
        if not eq or not _NAME.fullmatch(name):
            raise SettingsError(f"line {k} is no assignment")
        if name in out:
            raise SettingsError(f"line {k} sets {name} again")
        if value[:1] in ("'", '"'):
            if len(value) < 2 or value[-1] != value[0]:
                raise SettingsError(f"line {k} has an open quote")
            value = value[1:-1]
        if "\0" in value:
            raise SettingsError(f"line {k} has a null character")
        out[name] = value
    return out | dict(process)


def read_settings(path: Path) -> dict:
    """A JSON object without credentials, at any depth."""
    value = json.loads(path.read_text("utf-8"))
    if not isinstance(value, dict):
        raise SettingsError("settings must be an object")
    waiting, found = [value], set()
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            found |= {k for k in x if any(k.lower() == s or k.lower().endswith("_" + s) for s in SECRET_NAMES)}
            waiting += x.values()
        elif isinstance(x, list):
            waiting += x
    if found:
        raise SettingsError(f"credentials belong into the environment: {sorted(found)}")
    return value


def inside(root: Path, path: str) -> Path:
    """path below root; a path that leads out of it is refused."""
    out = (root / path).resolve()
    if not out.is_relative_to(root.resolve()):
        raise SettingsError(f"{path} leads out of {root}")
    return out


def as_of_guard(as_of: datetime, fetched_at: datetime) -> None:
    """A point in time later than the batch was fetched can't be answered from it."""
    if as_of > fetched_at:
        raise SettingsError("as_of is later than the batch was fetched")


class Pace:
    """Keeps a least interval between requests of one process."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, least: float = 0.1):
        if seconds < least:
            raise SettingsError(f"at least {least} seconds between requests")
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            self.sleep(self.seconds - (now - self.last))
        self.last = self.clock()

    def around(self, transport):
        """The transport, at this pace."""

        def get(url: str):
            self.wait()
            return transport(url)

        return get


def utc_now() -> datetime:
    return datetime.now(UTC)
