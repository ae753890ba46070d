"""All intraday features of minute bars in one plan, each as known at its bar, and the guards in front of it.

Every minute bar is exchanged once, by (security, local date): all windows of a day and what is known about the day
(daily bars, true ranges, splits, the instrument) meet there. What is known about a day is prepared at the size of the
daily bars, as short lists: the value known when the day's first bar became available and the changes until its last. Two
exchanges more carry the volume profile over dates and back, a fourth the benchmarks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import US_EQUITY, SessionCalendar
from tidemark.operators import bars as B
from tidemark.operators.asof import asof_last
from tidemark.operators.attention import two_clock_last

DAY_US = B.DAY_US
#: Window of the returns against benchmarks; one of MOMENTUM_MINUTES.
RELATIVE_MINUTES = 5


def last_instruments(instruments: DataFrame) -> DataFrame:
    """One row per security, the greatest version: later rows replace earlier ones, whatever their validity."""
    kept = ["ticker", "available_at", "sector", "sector_available_at", "shares_outstanding", "shares_outstanding_available_at", "free_float", "free_float_available_at"]
    one = instruments.filter("security_id is not null and version_id is not null").groupBy("security_id").agg(F.max(F.struct("version_id", *kept)).alias("m"))
    us = lambda c: F.unix_micros(f"m.{c}").alias(c)
    return one.select("security_id", "m.ticker", us("available_at").alias("_identity_us"), "m.sector", us("sector_available_at"), "m.shares_outstanding", us("shares_outstanding_available_at"), "m.free_float", us("free_float_available_at"))


def guards(minute: DataFrame, instruments: DataFrame, calendar: SessionCalendar = US_EQUITY) -> DataFrame:
    """(code, security_id, us) of minute bars that the feature pass refuses: UNKNOWN_INSTRUMENT, INSTRUMENT_NOT_AVAILABLE
    (its identity became available after the bar) and OUTSIDE_SESSION. A bar may have several."""
    return _guarded(minute, last_instruments(instruments), calendar).select(F.explode("_codes").alias("code"), "security_id", "us")


def _guarded(minute: DataFrame, last: DataFrame, calendar: SessionCalendar) -> DataFrame:
    m = minute.join(last, "security_id", "left")
    start = calendar.start(F.col("local_date"), F.col("session"))
    unknown = F.col("ticker").isNull() & F.col("_identity_us").isNull()
    codes = F.array(
        F.when(unknown, "UNKNOWN_INSTRUMENT"),
        F.when(F.col("_identity_us") > F.col("available_us"), "INSTRUMENT_NOT_AVAILABLE"),
        F.when(start.isNull(), "OUTSIDE_SESSION"),
    )
    return m.withColumn("_codes", F.array_compact(codes))


def _days(minute: DataFrame, daily: DataFrame, actions: DataFrame, period: int, calendar: SessionCalendar) -> DataFrame:
    """(security_id, local_date, _atr, _prior, _splits): what bars of a day may know, as short lists.

    _atr: (known, atr); _prior: (us, close, known) of daily bars of earlier dates. Each has the entry that holds when the
    day's first bar becomes available and those that become available until its last one does.
    """
    key = ["security_id", "local_date"]
    days = minute.groupBy(*key).agg(F.min("available_us").alias("_lo"), F.max("available_us").alias("_hi"))
    known = B.atr_events(daily, actions, period).withColumnRenamed("atr", "_a")
    first = asof_last(days, known.withColumn("_k", F.col("_known")), ["security_id"], "_lo", "_known", ["_k", "_a"], DAY_US)
    cell = lambda c: F.floor(F.col(c) / DAY_US).cast("long")
    cells = days.select(*key, "_lo", "_hi", F.explode(F.sequence(cell("_lo"), cell("_hi"))).alias("_c"))
    inside = (F.col("_known") > F.col("_lo")) & (F.col("_known") <= F.col("_hi"))
    later = cells.join(known.withColumn("_c", cell("_known")), ["security_id", "_c"]).filter(inside).groupBy(*key).agg(F.collect_list(F.struct("_known", "_a")).alias("_al"))
    day = lambda c: F.unix_date(c).cast("long")
    d = daily.select("security_id", calendar.local_date(F.timestamp_micros("us")).alias("_d"), F.col("available_us").alias("_known"), "us", "close").filter("_known is not null")
    asked = days.select("security_id", F.struct(*key).alias("id"), (day(F.col("local_date")) - 1).alias("event_us"), F.col("_lo").alias("known_us"))
    held = d.select("security_id", day(F.col("_d")).alias("observed_us"), F.col("_known").alias("available_us"), F.struct("us", "close", "_known").alias("value"))
    prior = two_clock_last(asked, held, ["security_id"], 7).select("id.*", F.col("value").alias("_p"))
    late = cells.join(d.withColumn("_c", cell("_known")), ["security_id", "_c"]).filter(inside & (F.col("_d") < F.col("local_date"))).groupBy(*key).agg(F.collect_list(F.struct("us", "close", "_known")).alias("_pl"))
    splits = actions.filter("ratio > 0").groupBy("security_id").agg(F.array_sort(F.collect_list(F.struct("effective_us", "available_us", "ratio"))).alias("_splits"))
    out = first.join(later, key, "left").join(prior, key, "left").join(late, key, "left").join(splits, "security_id", "left")
    some = lambda x, xs: F.concat(F.array_compact(F.array(x)), F.coalesce(xs, F.array().cast(out.schema[xs].dataType)))
    return out.select(*key, some(F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").alias("_known"), "_a")), "_al").alias("_atr"), some(F.col("_p"), "_pl").alias("_prior"), "_splits")


def _latest(entries: str, by: str) -> Column:
    """Of the entries known at the bar's availability the one greatest in by."""
    ok = F.filter(entries, lambda e: e["_known"] <= F.col("available_us"))
    return F.aggregate(ok, F.lit(None).cast(_element(entries)), lambda a, e: F.when(a.isNull() | (e[by] > a[by]), e).otherwise(a))


def _element(entries: str) -> str:
    return {"_atr": "struct<_known:bigint,_a:double>", "_prior": "struct<us:bigint,close:double,_known:bigint>"}[entries]


def compute_features(
    minute: DataFrame, daily: DataFrame, instruments: DataFrame, actions: DataFrame, sector_benchmarks: dict[str, str], index_benchmark: str | None,
    calendar: SessionCalendar = US_EQUITY, atr_period: int = 14, volatility_window: int = 30, strict: bool = True,
) -> DataFrame:
    """A row per minute bar with its 21 features, in no particular order (the sink orders by (us, security_id)).

    minute, daily: see bars.clean_bars; actions: security_id, effective_us, available_us, ratio. sector_benchmarks: sector
    to the security its return is held against; index_benchmark: one security. strict: a bar that a guard refuses is an
    error, as it would be in a run; otherwise such bars are left out, before anything is computed.
    """
    key = ["security_id", "local_date"]
    m = _guarded(minute, last_instruments(instruments), calendar)
    if strict:
        code = F.when(F.size("_codes") > 0, F.raise_error(F.concat_ws(" ", F.col("_codes")[0], "security_id", "us")).cast("boolean")).otherwise(True)
        m = m.filter(code)
    else:
        m = m.filter(F.size("_codes") == 0)
    m = m.drop("_codes").repartition(*key)
    m = B.realised_volatility(B.volume_acceleration(B.cumulative(B.momentum(m))), volatility_window)
    days = _days(minute, daily, actions, atr_period, calendar)
    m = m.join(days, key, "left").withColumns({"atr": _latest("_atr", "_known")["_a"], "_p": _latest("_prior", "us")})
    between = F.filter("_splits", lambda s: (F.col("_p.us") < s["effective_us"]) & (s["effective_us"] <= F.col("us")) & (s["available_us"] <= F.col("available_us")))
    prior = F.col("_p.close") / F.coalesce(F.aggregate(between, F.lit(1.0), lambda acc, s: acc * s["ratio"]), F.lit(1.0))
    regular = F.col("session") == "regular"
    opened = F.min_by(F.when(regular, F.col("open")), F.when(regular, F.col("us"))).over(B.day_window())
    mid, usable = (F.col("bid") + F.col("ask")) / 2, F.when(prior > 0, prior)
    m = m.withColumns(
        {
            "gap_pct": (F.try_divide(F.when(regular, opened).otherwise(F.col("close")), usable) - 1) * 100,
            "dollar_volume": F.col("close") * F.col("volume"),
            "float_rotation": F.when(F.col("free_float") > 0, F.col("day_volume") / B.known_attribute("free_float", "free_float_available_at")),
            "market_cap": F.col("close") * B.known_attribute("shares_outstanding", "shares_outstanding_available_at"),
            "spread_pct": F.try_divide(F.col("ask") - F.col("bid"), F.when(mid > 0, mid)) * 100,
        }
    )
    m = B.relative_volume(m).drop("_atr", "_prior", "_p", "_splits")
    own = F.col(f"momentum_{RELATIVE_MINUTES}m")
    sector = F.create_map(*[F.lit(x) for kv in sorted(sector_benchmarks.items()) for x in kv]) if sector_benchmarks else F.lit(None).cast("map<string,string>")
    m = m.withColumn("_sector_id", F.when(F.col("sector_available_at") <= F.col("available_us"), F.try_element_at(sector, F.col("sector"))))
    wanted = sorted({*sector_benchmarks.values(), *([index_benchmark] if index_benchmark else [])})
    marks = m.filter(F.col("security_id").isin(*wanted)).groupBy("us").agg(F.map_from_entries(F.collect_list(F.struct("security_id", own))).alias("_marks"))
    m = m.join(marks, "us", "left")
    against = lambda ident: own - F.try_element_at("_marks", ident)
    m = m.withColumns({"sector_relative": F.when(F.col("_sector_id").isNotNull(), against(F.col("_sector_id"))), "index_relative": against(F.lit(index_benchmark))})
    return m.select(
        "security_id", "ticker", "us", "available_us", "session", "gap_pct", "relative_volume", "dollar_volume", F.col("day_notional").alias("cumulative_dollar_volume"), "float_rotation", "market_cap",
        F.col("session_vwap").alias("vwap"), "vwap_distance", *[f"momentum_{w}m" for w in B.MOMENTUM_MINUTES], "volume_acceleration", "atr", "realised_volatility", "sector_relative", "index_relative", "bid", "ask", "spread_pct",
    )
