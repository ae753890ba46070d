"""Bars: cleaning, daily roll-up, split-adjusted view and intraday features as known at each bar."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from math import fsum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.calendar import US_EQUITY, SessionCalendar
from tidemark.operators.asof import asof_last, latest
from tidemark.operators.attention import two_clock_last
from tidemark.operators.streams import whole_groups

MINUTE_US = 60_000_000
DAY_US = 1440 * MINUTE_US
MOMENTUM_MINUTES = (1, 5, 15, 30, 60)
#: The calendar of the queries: the exchange's full holidays and early closes over the tables' dates.
NYSE = SessionCalendar(
    # fixed values: days without trading and minutes of early closes
    holidays=("2025-09-01", "2025-11-27", "2025-12-25", "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25"),
    early_closes={"2025-11-28": 780, "2025-12-24": 780},
)
_VALUES = ["open", "high", "low", "close", "volume", "vwap", "bid", "ask", "trade_count", "session", "source", "source_url", "feed", "adjustment"]


def clean_bars(bars: DataFrame, timeframe: str, calendar: SessionCalendar = US_EQUITY) -> DataFrame:
    """One row per security and instant of a timeframe: the latest revision (available_at, then the values).

    Rows with a null or NaN close, a null or negative volume, or no security don't count. Adds us, available_us and
    local_date.
    """
    b = bars.filter(F.col("timeframe") == timeframe).filter("security_id is not null and timestamp is not null and close is not null and not isnan(close) and volume is not null and volume >= 0")
    b = b.withColumns({"us": F.unix_micros("timestamp"), "available_us": F.unix_micros("available_at")})
    one = latest(b, ["security_id", "us"], ["available_us"], [c for c in _VALUES if c in b.columns])
    return one.withColumn("local_date", calendar.local_date(F.timestamp_micros("us")))


def daily_rollup(minute: DataFrame) -> DataFrame:
    """Regular-session minutes to a row per security and local date, with the volume-weighted price of bar vwaps, the
    first bar's source and the last bar's quotes, as far as minute has them."""
    r = minute.filter("session = 'regular'")
    price = F.coalesce("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return r.groupBy("security_id", "local_date").agg(
        F.min_by("open", "us").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "us").alias("close"),
        F.sum("volume").alias("volume"),
        F.try_divide(F.sum(price * F.col("volume")), F.sum("volume")).alias("vwap"),
        F.max("available_us").alias("available_us"),
        F.sum(F.coalesce("trade_count", F.lit(0))).alias("trade_count"),
        F.count("*").alias("minutes"),
        *[F.min_by(c, "us").alias(c) for c in ("source_url", "feed", "adjustment") if c in minute.columns],
        *[F.max_by(c, "us").alias(c) for c in ("bid", "ask") if c in minute.columns],
    )


def split_factors(bars: DataFrame, actions: DataFrame, known_us: int) -> DataFrame:
    """bars with ``factor``: the product of the ratios of splits known by known_us that take effect after the bar.

    A security's splits are one array beside its bars, so each bar folds the few that apply; no bar-by-split join.
    """
    a = actions.filter((F.col("effective_us") <= known_us) & (F.col("available_us") <= known_us) & (F.col("ratio") > 0))
    per = a.groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("effective_us", "ratio"))).alias("_splits"))
    later = F.filter("_splits", lambda s: F.col("us") < s["effective_us"])
    factor = F.aggregate(later, F.lit(1.0), lambda acc, s: acc * s["ratio"])
    return bars.join(per, "security_id", "left").withColumn("factor", F.coalesce(factor, F.lit(1.0))).drop("_splits")


def split_adjusted(bars: DataFrame, actions: DataFrame, known_us: int) -> DataFrame:
    """Prices divided by, volumes multiplied by the factor of known splits."""
    f = split_factors(bars, actions, known_us)
    prices = {c: F.col(c) / F.col("factor") for c in ("open", "high", "low", "close", "vwap", "bid", "ask") if c in bars.columns}
    return f.withColumns(prices | {"volume": F.bround(F.col("volume") * F.col("factor"), 0).cast("long"), "adjustment": F.lit("split_adjusted")})


def day_window():
    """All bars of a security and local date."""
    return Window.partitionBy("security_id", "local_date")


def _day(*more: str):
    return Window.partitionBy("security_id", "local_date", *more).orderBy("us")


def momentum(minute: DataFrame, windows: tuple[int, ...] = MOMENTUM_MINUTES) -> DataFrame:
    """Per cent change against the last bar of the same local date that is at least w minutes older; null without one."""
    out = {}
    for w in windows:
        prior = F.last("close").over(_day().rangeBetween(Window.unboundedPreceding, -w * MINUTE_US))
        out[f"momentum_{w}m"] = (F.try_divide(F.col("close"), prior) - 1) * 100
    return minute.withColumns(out)


def cumulative(minute: DataFrame) -> DataFrame:
    """Running volume, notional and VWAP of the session, and volume and notional of the day."""
    s, d = _day("session").rowsBetween(Window.unboundedPreceding, 0), _day().rowsBetween(Window.unboundedPreceding, 0)
    price = F.coalesce("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    m = minute.withColumns(
        {
            "session_volume": F.sum("volume").over(s),
            "session_notional": F.sum(F.col("close") * F.col("volume")).over(s),
            "session_vwap": F.try_divide(F.sum(price * F.col("volume")).over(s), F.sum("volume").over(s)),
            "day_volume": F.sum("volume").over(d),
            "day_notional": F.sum(F.col("close") * F.col("volume")).over(d),
        }
    )
    return m.withColumn("vwap_distance", F.when(F.col("session_vwap") > 0, (F.col("close") / F.col("session_vwap") - 1) * 100))


def minute_offset(calendar: SessionCalendar = US_EQUITY) -> Column:
    """Whole minutes since the session began; null outside sessions."""
    start = calendar.start(F.col("local_date"), F.col("session"))
    return F.floor((F.col("us") - F.unix_micros(start)) / MINUTE_US)


def relative_volume(cumulated: DataFrame) -> DataFrame:
    """Session volume so far against its mean at the same minute of the session on strictly earlier dates that have it.

    Of several bars in one minute of a date the last counts for later dates.
    """
    c = cumulated.withColumn("minute_offset", minute_offset()).filter("minute_offset is not null")
    key = ["security_id", "session", "minute_offset"]
    per_day = c.groupBy(*key, "local_date").agg(F.max_by("session_volume", "us").alias("_v"))
    w = Window.partitionBy(*key).orderBy("local_date").rowsBetween(Window.unboundedPreceding, -1)
    base = per_day.withColumn("base_volume", F.avg("_v").over(w)).drop("_v")
    out = c.join(base, [*key, "local_date"])
    return out.withColumn("relative_volume", F.when(F.col("base_volume") > 0, F.col("session_volume") / F.col("base_volume")))


def volume_acceleration(minute: DataFrame) -> DataFrame:
    """Volume of the last five against the five bars before, if all ten are a minute apart in one session."""
    w = _day("session")
    last, prev = F.sum("volume").over(w.rowsBetween(-4, 0)), F.sum("volume").over(w.rowsBetween(-9, -5))
    tight = (F.col("us") - F.lag("us", 9).over(w)) == 9 * MINUTE_US
    return minute.withColumn("volume_acceleration", F.when(tight & (prev > 0), last / F.nullif(prev, F.lit(0)) - 1))


def realised_volatility(minute: DataFrame, window: int = 30) -> DataFrame:
    """Root of the summed squares of the last log returns of an unbroken run of minutes of a local date, in per cent."""
    prev_us, prev = F.lag("us").over(_day()), F.lag("close").over(_day())
    joined = F.coalesce(F.col("us") - prev_us == MINUTE_US, F.lit(False)) & (prev > 0) & (F.col("close") > 0)
    m = minute.withColumns({"_break": F.when(joined, 0).otherwise(1), "_ret": F.when(joined, F.log(F.col("close") / F.nullif(prev, F.lit(0.0))))})
    m = m.withColumn("_run", F.sum("_break").over(_day().rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("security_id", "local_date", "_run").orderBy("us").rowsBetween(-(window - 1), 0)
    enough = F.count("_ret").over(w) >= window
    return m.withColumn("realised_volatility", F.when(enough, F.sqrt(F.sum(F.col("_ret") * F.col("_ret")).over(w)) * 100)).drop("_break", "_ret", "_run")


def comparable_prior(bars: DataFrame, actions: DataFrame, prior: str, prior_us: str, name: str) -> DataFrame:
    """bars with ``name``: the price prior of time prior_us, divided by the ratios of the splits that took effect after
    it and by the bar (us) and were known by the bar's own availability. A security's splits are one array, as above."""
    per = actions.filter("ratio > 0").groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("effective_us", "available_us", "ratio"))).alias("_splits"))
    between = F.filter("_splits", lambda s: (F.col(prior_us) < s["effective_us"]) & (s["effective_us"] <= F.col("us")) & (s["available_us"] <= F.col("available_us")))
    factor = F.coalesce(F.aggregate(between, F.lit(1.0), lambda acc, s: acc * s["ratio"]), F.lit(1.0))
    return bars.join(per, "security_id", "left").withColumn(name, F.col(prior) / factor).drop("_splits")


def true_range(daily: DataFrame, actions: DataFrame) -> DataFrame:
    """True range of daily bars against the previous close, made comparable over splits; the first bar's own range."""
    w = Window.partitionBy("security_id").orderBy("us")
    d = comparable_prior(daily.withColumns({"_prev": F.lag("close").over(w), "_prev_us": F.lag("us").over(w)}), actions, "_prev", "_prev_us", "_comparable")
    prev = F.coalesce("_comparable", "close")
    return d.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))).drop("_prev", "_prev_us", "_comparable")


def _last_known(period: int):
    """Mean true range of the last period days known, at each instant at which a security's daily bars become available."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(batches, ["security_id"]):
            out: list[tuple] = []
            owner, days, ranges = None, [], []
            for security, known, day, tr in zip(g["security_id"], g["available_us"].to_numpy(), g["us"].to_numpy(), g["true_range"].to_numpy()):
                if security != owner:
                    owner, days, ranges = security, [], []
                k = bisect(days, day)
                days.insert(k, day)
                ranges.insert(k, tr)
                if len(days) > period:  # days before these can't come back: what is known stays known
                    del days[0], ranges[0]
                if out and out[-1][:2] == (security, known):
                    out.pop()  # of days that become available together the last step knows them all
                out.append((security, known, fsum(ranges) / period if len(days) == period else None))
            yield pd.DataFrame(out, columns=["security_id", "_known", "atr"]).astype({"atr": float})

    return run


def atr_events(daily: DataFrame, actions: DataFrame, period: int = 14) -> DataFrame:
    """(security_id, _known, atr): mean true range of the last period daily bars, by day, of those available by then, at
    each instant at which daily bars become available; null with fewer. A daily bar counts from its own availability, in
    whatever order they arrive.

    The sweep sees a row per security and day, not the minutes; it holds one security's days and passes each once.
    """
    tr = true_range(daily, actions).filter("available_us is not null").select("security_id", "available_us", "us", "true_range")
    swept = tr.repartition("security_id").sortWithinPartitions("security_id", "available_us", "us").mapInPandas(_last_known(period), "security_id string, _known long, atr double")
    return swept.withColumn("atr", F.nanvl("atr", F.lit(None).cast("double")))


def atr_known_at(minute: DataFrame, daily: DataFrame, actions: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    """minute with ``atr`` as known by each bar's own availability; see atr_events."""
    known = atr_events(daily, actions, period).withColumnRenamed("atr", name)
    return asof_last(minute, known, ["security_id"], "available_us", "_known", [name], DAY_US)


def previous_daily(minute: DataFrame, daily: DataFrame, calendar: SessionCalendar = US_EQUITY) -> DataFrame:
    """minute with ``prior_close``, the close of the latest daily bar of an earlier local date that was available by
    then, and ``prior_us``, that bar's own time; null without one.

    Each daily bar counts from its own availability, in whatever order they become available: a lookup by two clocks,
    the date and the availability, once per distinct security, date and availability.
    """
    day = lambda c: F.unix_date(c).cast("long")
    key = ["security_id", "local_date", "available_us"]
    asked = minute.select(*key).distinct().select("security_id", F.struct(*key).alias("id"), (day(F.col("local_date")) - 1).alias("event_us"), F.col("available_us").alias("known_us"))
    d = daily.select("security_id", day(calendar.local_date(F.timestamp_micros("us"))).alias("observed_us"), "available_us", F.struct("us", "close").alias("value"))
    # both clocks are only compared: the first counts days here, in cells of a week
    found = two_clock_last(asked, d, ["security_id"], 7).select(*[F.col(f"id.{c}").alias(c) for c in key], F.col("value.close").alias("prior_close"), F.col("value.us").alias("prior_us"))
    return minute.join(found, key, "left")


def gap_percent(with_prior: DataFrame, actions: DataFrame) -> DataFrame:
    """Premarket: close against the prior close; later: the day's first regular open against it. The prior close is made
    comparable over the splits since its day; prior_close itself stays as it was traded."""
    day = Window.partitionBy("security_id", "local_date")
    first = F.min_by(F.when(F.col("session") == "regular", F.col("open")), F.when(F.col("session") == "regular", F.col("us"))).over(day)
    now = F.when(F.col("session") == "premarket", F.col("close")).otherwise(first)
    p = comparable_prior(with_prior, actions, "prior_close", "prior_us", "_comparable")
    return p.withColumn("gap_percent", (F.try_divide(now, F.when(F.col("_comparable") > 0, F.col("_comparable"))) - 1) * 100).drop("_comparable")


def missing_runs(minute: DataFrame, halts: DataFrame, securities: DataFrame, calendar: SessionCalendar = US_EQUITY, sessions: tuple[str, ...] = ("premarket", "regular")) -> DataFrame:
    """(security_id, first_us, last_us, minutes): runs of expected minutes of a session without bar and without halt.

    Expected are all minutes of the given sessions on every date with a minute bar of any security, for every one of
    securities (security_id), also where it has no bar at all; runs end with their session. A bar counts for the session
    it is labelled with. halts: security_id, start_us, end_us (-1: open), disjoint per security, as halt_periods gives
    them; they cover the minutes that begin in them. The grid isn't laid out by minutes: bars and halts are spans within
    a security's session, and what lies between the spans is missing.
    """
    slot = lambda c: F.floor(c / MINUTE_US)
    key = ["security_id", "local_date", "session"]
    days = minute.select("local_date").distinct().crossJoin(minute.sparkSession.createDataFrame([(x,) for x in sessions], "session string"))
    bounds = {"a": slot(F.unix_micros(calendar.start(F.col("local_date"), F.col("session")))), "z": slot(F.unix_micros(calendar.end(F.col("local_date"), F.col("session"))))}
    days = F.broadcast(days.withColumns(bounds).filter("a < z"))
    cells = securities.select("security_id").filter("security_id is not null").distinct().crossJoin(days)
    bars = minute.select(*key, slot(F.col("us")).alias("s")).distinct().withColumn("e", F.col("s") + 1)
    bars = bars.join(days, ["local_date", "session"]).filter("s >= a and s < z").select(*key, "s", "e")
    on = lambda c: calendar.local_date(F.timestamp_micros(c))
    ends = minute.agg(F.min("local_date").alias("_lo"), F.max("local_date").alias("_hi"))
    h = halts.crossJoin(F.broadcast(ends)).withColumn("_from", F.greatest(on(F.col("start_us")), "_lo")).withColumn("_to", F.least(F.when(F.col("end_us") == -1, F.col("_hi")).otherwise(on(F.col("end_us"))), "_hi"))
    # minutes that begin in the halt: both ends rounded up
    up = lambda c: F.ceil(F.col(c) / MINUTE_US)
    h = h.filter("_from <= _to").select("security_id", F.explode(F.sequence("_from", "_to")).alias("local_date"), up("start_us").alias("hs"), F.when(F.col("end_us") != -1, up("end_us")).alias("he"))
    h = h.join(securities.select("security_id").distinct(), "security_id", "left_semi").join(days, "local_date")
    h = h.select(*key, F.greatest("hs", "a").alias("s"), F.least("he", "z").alias("e")).filter("s < e")
    first, last = cells.select(*key, F.col("a").alias("s"), F.col("a").alias("e")), cells.select(*key, F.col("z").alias("s"), F.col("z").alias("e"))
    known = bars.join(securities.select("security_id").distinct(), "security_id", "left_semi").select(*key, "s", "e")
    w = Window.partitionBy(*key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = first.unionByName(known).unionByName(h).unionByName(last).withColumn("_until", F.max("e").over(w)).filter("s > _until")
    return gaps.select("security_id", (F.col("_until") * MINUTE_US).alias("first_us"), ((F.col("s") - 1) * MINUTE_US).alias("last_us"), (F.col("s") - F.col("_until")).alias("minutes"))


def known_attribute(value: str, known: str, at: str = "available_us") -> Column:
    """A value as far as it was known at a row's availability."""
    return F.when(F.col(known) <= F.col(at), F.col(value))


def relative_return(with_momentum: DataFrame, benchmark: str, window: int = 5) -> DataFrame:
    """Own momentum less the benchmark's at the identical instant; null where the benchmark has no bar then.

    The benchmark is one security, its bars are joined by instant.
    """
    m = f"momentum_{window}m"
    b = with_momentum.filter(F.col("security_id") == benchmark).select("us", F.col(m).alias("_b"))
    return with_momentum.join(b, "us", "left").withColumn("relative_return", F.col(m) - F.col("_b")).drop("_b")
