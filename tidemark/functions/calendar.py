"""Session calendar as column functions: exchange-local clock, session classes, bounds and expected minutes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SessionCalendar:
    """Half-open sessions in exchange-local minutes of the day, on weekdays that aren't holidays.

    holidays: ``yyyy-MM-dd``; early_closes: date to the minute the regular session ends. Both are short literal lists.
    """

    zone: str = "America/New_York"
    premarket: int = 4 * 60
    regular: int = 9 * 60 + 30
    close: int = 16 * 60
    holidays: tuple[str, ...] = ()
    early_closes: dict[str, int] = field(default_factory=dict)

    def local(self, ts: Column) -> Column:
        """Exchange-local wall clock of an instant."""
        return F.from_utc_timestamp(ts, self.zone)

    def local_date(self, ts: Column) -> Column:
        return F.to_date(self.local(ts))

    def minute_of_day(self, ts: Column) -> Column:
        t = self.local(ts)
        return F.hour(t) * 60 + F.minute(t)

    def is_session_date(self, date: Column) -> Column:
        weekday = ~F.dayofweek(date).isin(1, 7)
        return weekday & ~F.date_format(date, "yyyy-MM-dd").isin(*self.holidays) if self.holidays else weekday

    def close_minute(self, date: Column) -> Column:
        out = F.lit(self.close)
        for day, minute in sorted(self.early_closes.items()):
            out = F.when(F.date_format(date, "yyyy-MM-dd") == day, minute).otherwise(out)
        return out

    def classify(self, ts: Column) -> Column:
        """premarket, regular or outside; null for null."""
        date, minute = self.local_date(ts), self.minute_of_day(ts)
        return (
            F.when(ts.isNull(), None)
            .when(~self.is_session_date(date), "outside")
            .when((minute >= self.premarket) & (minute < F.least(F.lit(self.regular), self.close_minute(date))), "premarket")
            .when((minute >= self.regular) & (minute < self.close_minute(date)), "regular")
            .otherwise("outside")
        )

    def start(self, date: Column, session: Column) -> Column:
        """UTC instant at which a session begins; null where the date has none or the session is outside."""
        minute = F.when(session == "premarket", self.premarket).when(session == "regular", self.regular)
        return F.when(self.is_session_date(date), self._at(date, minute))

    def end(self, date: Column, session: Column) -> Column:
        minute = F.when(session == "premarket", F.least(F.lit(self.regular), self.close_minute(date))).when(session == "regular", self.close_minute(date))
        return F.when(self.is_session_date(date), self._at(date, minute))

    def _at(self, date: Column, minute: Column) -> Column:
        return F.to_utc_timestamp(date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minute), self.zone)

    def expected_minutes(self, date: Column, session: Column) -> Column:
        """Array of the UTC starts of all minutes of a session, empty where there is none."""
        a, z = F.unix_seconds(self.start(date, session)), F.unix_seconds(self.end(date, session))
        return F.coalesce(F.transform(F.when(z > a, F.sequence(a, z - 60, F.lit(60))), F.timestamp_seconds), F.array().cast("array<timestamp>"))


US_EQUITY = SessionCalendar()
