"""Queries over bars: roll-up, features as known at each bar, grids and gaps, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import features, intervals
from tidemark.plans.tables import table

KNOWN_US = 1_767_225_600_000_000  # 2026-01-01: what the split view knows


def _minute(spark: SparkSession, d: str) -> DataFrame:
    return B.clean_bars(table(spark, d, "bars"), "1m")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return B.clean_bars(table(spark, d, "bars"), "1d")


def _r(c: str, n: int = 4):
    return F.round(F.col(c), n).alias(c)


KEY = ["security_id", "us"]


def bar_rollup(spark, d):
    r = B.daily_rollup(_minute(spark, d))
    return r.select("security_id", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"), "open", "high", "low", "close", "volume", _r("vwap"), "available_us", "trade_count", "minutes", "source_url", "feed", "adjustment", "bid", "ask")


def session_classify(spark, d):
    b = table(spark, d, "bars").filter("timeframe = '1m'")
    return b.select("session", B.NYSE.classify(F.col("timestamp")).alias("computed"), B.NYSE.minute_of_day(F.col("timestamp")).alias("minute")).groupBy("session", "computed", "minute").agg(F.count("*").alias("n"))


def cum_vwap(spark, d):
    return B.cumulative(_minute(spark, d)).select(*KEY, "session_volume", _r("session_notional", 2), _r("session_vwap"), "day_volume", _r("day_notional", 2), _r("vwap_distance"))


def momentum_asof(spark, d):
    return B.momentum(_minute(spark, d)).select(*KEY, *[_r(f"momentum_{w}m") for w in B.MOMENTUM_MINUTES])


def rvol_tod(spark, d):
    return B.relative_volume(B.cumulative(_minute(spark, d))).select(*KEY, "minute_offset", _r("relative_volume"))


def volume_accel(spark, d):
    return B.volume_acceleration(_minute(spark, d)).select(*KEY, _r("volume_acceleration")).filter("volume_acceleration is not null")


def realised_vol(spark, d):
    """Over the default window of 30 returns, and over 10, of which there are more rows."""
    m = B.realised_volatility(B.realised_volatility(_minute(spark, d), 10).withColumnRenamed("realised_volatility", "realised_volatility_10"))
    return m.select(*KEY, _r("realised_volatility"), _r("realised_volatility_10")).filter("realised_volatility_10 is not null")


def true_range_atr(spark, d):
    """Over the default period of 14 daily bars, and over 3."""
    m, daily, actions = _minute(spark, d), _daily(spark, d), _actions(spark, d)
    return B.atr_known_at(B.atr_known_at(m, daily, actions), daily, actions, 3, "atr_3").select(*KEY, _r("atr"), _r("atr_3"))


def prev_daily_asof(spark, d):
    m = B.gap_percent(B.previous_daily(_minute(spark, d), _daily(spark, d)), _actions(spark, d))
    return m.select(*KEY, "prior_close", _r("gap_percent"))


def float_rotation(spark, d):
    i = table(spark, d, "instruments").filter("version_id is not null")
    # the reference's rule: of several rows of an instrument the last (here: the greatest version) holds, no validity join
    i = i.groupBy("security_id").agg(F.max(F.struct("version_id", "free_float", F.unix_micros("free_float_available_at").alias("f_us"), "shares_outstanding", F.unix_micros("shares_outstanding_available_at").alias("s_us"))).alias("m")).select("security_id", "m.*")
    m = B.cumulative(_minute(spark, d)).join(i, "security_id")
    rot = F.when(F.col("free_float") > 0, F.col("day_volume") / B.known_attribute("free_float", "f_us"))
    cap = F.col("close") * B.known_attribute("shares_outstanding", "s_us")
    return m.select(*KEY, F.round(rot, 8).alias("float_rotation"), F.round(cap, 0).alias("market_cap"))


def relative_return(spark, d):
    m = B.momentum(_minute(spark, d), (5,))
    benchmark = m.agg(F.min("security_id")).first()[0]  # one scalar
    return B.relative_return(m, benchmark).select(*KEY, _r("relative_return")).filter("relative_return is not null")


def _actions(spark, d):
    i = table(spark, d, "instruments")
    return i.select("security_id", F.unix_micros("effective_from").alias("effective_us"), F.unix_micros("available_at").alias("available_us"), (1.0 + F.col("version_id") % 3).alias("ratio"))


def split_adjust(spark, d):
    return B.split_adjusted(_minute(spark, d), _actions(spark, d), KNOWN_US).select(*KEY, _r("close", 6), "volume", "factor")


def expected_grid_gaps(spark, d):
    """Expected are the securities of instruments and of bars; the tables hold no list of their own."""
    minute = _minute(spark, d)
    securities = table(spark, d, "instruments").select("security_id").unionByName(minute.select("security_id"))
    return B.missing_runs(minute, intervals.halt_periods(table(spark, d, "halt_observations")).filter("kind = 'period'"), securities, B.NYSE)


def _benchmarks(instruments: DataFrame) -> dict[str, str]:
    """Of each sector the smallest security id: a row per sector."""
    rows = instruments.filter("sector is not null").groupBy("sector").agg(F.min("security_id").alias("b")).collect()
    return {r["sector"]: r["b"] for r in rows}


def feature_pass(spark, d):
    m, i = _minute(spark, d), table(spark, d, "instruments")
    index = m.agg(F.min("security_id")).first()[0]  # one scalar
    f = features.compute_features(m, _daily(spark, d), i, _actions(spark, d), _benchmarks(i), index, strict=False)
    small = ["float_rotation"]
    plain = ["security_id", "ticker", "us", "available_us", "session", "bid", "ask"]
    return f.select(*plain, *[_r(c, 8 if c in small else 2 if c in ("market_cap", "dollar_volume", "cumulative_dollar_volume") else 4) for c in f.columns if c not in plain])


def feature_guards(spark, d):
    return features.guards(_minute(spark, d), table(spark, d, "instruments")).groupBy("code", "security_id").agg(F.count("*").alias("n"))


def dup_bars(spark, d):
    b = table(spark, d, "bars")
    n = b.groupBy("security_id", "timeframe", F.unix_micros("timestamp").alias("us")).agg(F.count("*").alias("n"))
    return n.filter("n > 1").select("security_id", "timeframe", "us", (F.col("n") - 1).alias("repeats"))


def latest_per_security(spark, d):
    m = _minute(spark, d)
    return m.groupBy("security_id").agg(F.max(F.struct("us", "close", "volume")).alias("m")).select("security_id", "m.us", "m.close", "m.volume")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (bar_rollup, session_classify, cum_vwap, momentum_asof, rvol_tod, volume_accel, realised_vol, true_range_atr, prev_daily_asof, float_rotation, relative_return, split_adjust, feature_pass, feature_guards, expected_grid_gaps, dup_bars, latest_per_security)
}

_CLEAN = """c0 AS (SELECT security_id, timeframe, epoch_us(timestamp) AS us, epoch_us(available_at) AS available_us, open, high, low, close, volume, vwap, bid, ask, trade_count, session, source_url, feed, adjustment,
  row_number() OVER (PARTITION BY security_id, timeframe, timestamp ORDER BY available_at DESC NULLS LAST, open DESC NULLS LAST, high DESC NULLS LAST, low DESC NULLS LAST, close DESC, volume DESC, vwap DESC NULLS LAST, bid DESC NULLS LAST, ask DESC NULLS LAST, trade_count DESC NULLS LAST, session DESC, source DESC, source_url DESC, feed DESC, adjustment DESC) rn
  FROM bars WHERE security_id IS NOT NULL AND timestamp IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) AND volume IS NOT NULL AND volume >= 0),
c1 AS (SELECT *, CAST(timezone('America/New_York', make_timestamptz(us)) AS DATE) AS local_date FROM c0 WHERE rn = 1),
m AS (SELECT * FROM c1 WHERE timeframe = '1m'), dly AS (SELECT * FROM c1 WHERE timeframe = '1d')"""
_START = "epoch_us(timezone('America/New_York', CAST(local_date AS TIMESTAMP) + to_minutes(CASE session WHEN 'premarket' THEN 240 WHEN 'regular' THEN 570 END)))"
_PRICE = "coalesce(vwap, (high + low + close) / 3)"
_CUM = f"""cum AS (SELECT *, sum(volume) OVER s AS session_volume, sum(close * volume) OVER s AS session_notional, sum({_PRICE} * volume) OVER s / nullif(sum(volume) OVER s, 0) AS session_vwap,
  sum(volume) OVER d AS day_volume, sum(close * volume) OVER d AS day_notional FROM m
  WINDOW s AS (PARTITION BY security_id, local_date, session ORDER BY us ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY security_id, local_date ORDER BY us ROWS UNBOUNDED PRECEDING))"""


def _mom(w: int) -> str:
    return f"round((close / nullif(last_value(close) OVER (PARTITION BY security_id, local_date ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {w * B.MINUTE_US} PRECEDING), 0) - 1) * 100, 4)"


_HALTS = """o AS (SELECT *, row_number() OVER (PARTITION BY halt_id ORDER BY first_seen_at DESC) rn FROM halt_observations),
hi AS (SELECT security_id, epoch_us(halt_at) s, coalesce(epoch_us(resumption_trade_at), 9000000000000000000) e FROM o WHERE rn = 1 AND security_id IS NOT NULL AND (resumption_trade_at IS NULL OR resumption_trade_at > halt_at))"""

_HOLIDAYS = ", ".join(f"'{h}'" for h in B.NYSE.holidays)
_CLOSE = "CASE dt " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.NYSE.early_closes.items()) + " ELSE 960 END"
_LAST = "li AS (SELECT security_id, ticker, sector, epoch_us(available_at) id_us, epoch_us(sector_available_at) sector_us, shares_outstanding, epoch_us(shares_outstanding_available_at) shares_us, free_float, epoch_us(free_float_available_at) float_us FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY version_id DESC) rn FROM instruments) WHERE rn = 1)"
_SPLITS = "s AS (SELECT security_id, epoch_us(effective_from) e, epoch_us(available_at) k, 1.0::DOUBLE + version_id % 3 AS ratio FROM instruments)"

SQL: dict[str, str] = {
    "bar_rollup": f"""WITH {_CLEAN} SELECT security_id, strftime(local_date, '%Y-%m-%d') AS local_date, arg_min(open, us) AS open, max(high) AS high, min(low) AS low, arg_max(close, us) AS close, CAST(sum(volume) AS BIGINT) AS volume,
 round(sum({_PRICE} * volume) / nullif(sum(volume), 0), 4) AS vwap, max(available_us) AS available_us, CAST(sum(coalesce(trade_count, 0)) AS BIGINT) AS trade_count, count(*) AS minutes, arg_min(source_url, us) AS source_url, arg_min(feed, us) AS feed, arg_min(adjustment, us) AS adjustment, arg_max_null(bid, us) AS bid, arg_max_null(ask, us) AS ask FROM m WHERE session = 'regular' GROUP BY security_id, m.local_date""",
    "session_classify": f"""WITH l AS (SELECT session, timezone('America/New_York', timestamp) t FROM bars WHERE timeframe = '1m'), x AS (SELECT session, CAST(hour(t) * 60 + minute(t) AS INTEGER) AS minute, isodow(t) w, strftime(t, '%Y-%m-%d') dt FROM l)
SELECT session, CASE WHEN w > 5 OR dt IN ({_HOLIDAYS}) THEN 'outside' WHEN minute >= 240 AND minute < 570 THEN 'premarket' WHEN minute >= 570 AND minute < {_CLOSE} THEN 'regular' ELSE 'outside' END AS computed, minute, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "cum_vwap": f"WITH {_CLEAN}, {_CUM} SELECT security_id, us, CAST(session_volume AS BIGINT) AS session_volume, round(session_notional, 2) AS session_notional, round(session_vwap, 4) AS session_vwap, CAST(day_volume AS BIGINT) AS day_volume, round(day_notional, 2) AS day_notional, CASE WHEN session_vwap > 0 THEN round((close / session_vwap - 1) * 100, 4) END AS vwap_distance FROM cum",
    "momentum_asof": f"WITH {_CLEAN} SELECT security_id, us, " + ", ".join(f"{_mom(w)} AS momentum_{w}m" for w in B.MOMENTUM_MINUTES) + " FROM m",
    "rvol_tod": f"""WITH {_CLEAN}, {_CUM}, k AS (SELECT *, CAST(floor((us - {_START}) / 60000000) AS BIGINT) AS minute_offset FROM cum WHERE session IN ('premarket', 'regular') AND isodow(local_date) <= 5),
p AS (SELECT security_id, session, minute_offset, local_date, arg_max(session_volume, us) v FROM k GROUP BY ALL), b AS (SELECT *, avg(v) OVER (PARTITION BY security_id, session, minute_offset ORDER BY local_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) bv FROM p)
SELECT k.security_id, k.us, k.minute_offset, CASE WHEN bv > 0 THEN round(session_volume / bv, 4) END AS relative_volume FROM k JOIN b USING (security_id, session, minute_offset, local_date)""",
    "volume_accel": f"""WITH {_CLEAN}, x AS (SELECT security_id, us, sum(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) a, sum(volume) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) b, us - lag(us, 9) OVER w AS g FROM m WINDOW w AS (PARTITION BY security_id, local_date, session ORDER BY us))
SELECT security_id, us, round(a / b - 1, 4) AS volume_acceleration FROM x WHERE g = 540000000 AND b > 0""",
    "realised_vol": f"""WITH {_CLEAN}, x AS (SELECT *, lag(us) OVER w pu, lag(close) OVER w pc FROM m WINDOW w AS (PARTITION BY security_id, local_date ORDER BY us)),
y AS (SELECT *, CASE WHEN us - pu = 60000000 AND pc > 0 AND close > 0 THEN ln(close / pc) END r FROM x), z AS (SELECT *, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY security_id, local_date ORDER BY us ROWS UNBOUNDED PRECEDING) run FROM y),
v AS (SELECT security_id, us, count(r) OVER q n, sum(r * r) OVER q s, count(r) OVER q3 n3, sum(r * r) OVER q3 s3 FROM z WINDOW q AS (PARTITION BY security_id, local_date, run ORDER BY us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), q3 AS (PARTITION BY security_id, local_date, run ORDER BY us ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT security_id, us, CASE WHEN n3 >= 30 THEN round(sqrt(s3) * 100, 4) END AS realised_volatility, round(sqrt(s) * 100, 4) AS realised_volatility_10 FROM v WHERE n >= 10""",
    "true_range_atr": f"""WITH {_CLEAN}, {_SPLITS}, q AS (SELECT *, lag(close) OVER w pc, lag(us) OVER w pu FROM dly WINDOW w AS (PARTITION BY security_id ORDER BY us)),
f AS (SELECT q.security_id, q.us, product(s.ratio) factor FROM q JOIN s ON s.security_id = q.security_id AND q.pu < s.e AND s.e <= q.us AND s.k <= q.available_us GROUP BY 1, 2),
t AS (SELECT security_id, us, available_us, greatest(high - low, abs(high - coalesce(pc / coalesce(factor, 1), close)), abs(low - coalesce(pc / coalesce(factor, 1), close))) tr FROM q LEFT JOIN f USING (security_id, us)),
keys AS (SELECT DISTINCT security_id, available_us FROM m),
l AS (SELECT k.security_id, k.available_us, tr, row_number() OVER (PARTITION BY k.security_id, k.available_us ORDER BY t.us DESC) rn FROM keys k JOIN t ON t.security_id = k.security_id AND t.available_us <= k.available_us),
a AS (SELECT security_id, available_us, CASE WHEN count(*) FILTER (rn <= 14) = 14 THEN avg(tr) FILTER (rn <= 14) END atr, CASE WHEN count(*) FILTER (rn <= 3) = 3 THEN avg(tr) FILTER (rn <= 3) END atr_3 FROM l GROUP BY 1, 2)
SELECT m.security_id, m.us, round(atr, 4) AS atr, round(atr_3, 4) AS atr_3 FROM m LEFT JOIN a ON a.security_id = m.security_id AND a.available_us = m.available_us""",
    "prev_daily_asof": f"""WITH {_CLEAN}, {_SPLITS}, keys AS (SELECT DISTINCT security_id, local_date, available_us FROM m),
pc AS (SELECT k.security_id, k.local_date, k.available_us, arg_max(dly.close, dly.us) prior_close, max(dly.us) prior_us FROM keys k JOIN dly ON dly.security_id = k.security_id AND dly.local_date < k.local_date AND dly.available_us <= k.available_us GROUP BY ALL),
f AS (SELECT security_id, local_date, arg_min(open, us) fo FROM m WHERE session = 'regular' GROUP BY ALL),
x AS (SELECT m.security_id, m.us, m.session, m.close, fo, prior_close, prior_us, m.available_us FROM m LEFT JOIN pc ON pc.security_id = m.security_id AND pc.local_date = m.local_date AND pc.available_us = m.available_us LEFT JOIN f ON f.security_id = m.security_id AND f.local_date = m.local_date),
g AS (SELECT x.security_id, x.us, product(s.ratio) factor FROM x JOIN s ON s.security_id = x.security_id AND x.prior_us < s.e AND s.e <= x.us AND s.k <= x.available_us GROUP BY 1, 2)
SELECT x.security_id, x.us, prior_close, CASE WHEN prior_close > 0 THEN round((CASE WHEN session = 'premarket' THEN close ELSE fo END / (prior_close / coalesce(factor, 1)) - 1) * 100, 4) END AS gap_percent FROM x LEFT JOIN g ON g.security_id = x.security_id AND g.us = x.us""",
    "float_rotation": f"""WITH {_CLEAN}, {_CUM}, i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY version_id DESC) rn FROM instruments) WHERE rn = 1)
SELECT cum.security_id, us, CASE WHEN free_float > 0 AND epoch_us(free_float_available_at) <= cum.available_us THEN round(day_volume / free_float, 8) END AS float_rotation, CASE WHEN epoch_us(shares_outstanding_available_at) <= cum.available_us THEN round(close * shares_outstanding, 0) END AS market_cap FROM cum JOIN i ON i.security_id = cum.security_id""",
    "relative_return": f"""WITH {_CLEAN}, x AS (SELECT security_id, us, (close / nullif(last_value(close) OVER (PARTITION BY security_id, local_date ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 300000000 PRECEDING), 0) - 1) * 100 q FROM m), b AS (SELECT us, q bq FROM x WHERE security_id = (SELECT min(security_id) FROM m))
SELECT security_id, us, round(q - bq, 4) AS relative_return FROM x JOIN b USING (us) WHERE q - bq IS NOT NULL""",
    "split_adjust": f"""WITH {_CLEAN}, a AS (SELECT security_id, epoch_us(effective_from) e, 1.0::DOUBLE + version_id % 3 AS ratio FROM instruments WHERE epoch_us(effective_from) <= {KNOWN_US} AND epoch_us(available_at) <= {KNOWN_US}),
f AS (SELECT m.security_id, m.us, coalesce(product(ratio), 1.0) factor FROM m LEFT JOIN a ON a.security_id = m.security_id AND m.us < a.e GROUP BY ALL)
SELECT m.security_id, m.us, round(close / factor, 6) AS close, CAST(volume * factor AS BIGINT) AS volume, factor FROM m JOIN f ON f.security_id = m.security_id AND f.us = m.us""",
    "expected_grid_gaps": f"""WITH {_CLEAN}, {_HALTS}, sec AS (SELECT security_id FROM instruments WHERE security_id IS NOT NULL UNION SELECT security_id FROM m),
dd AS (SELECT DISTINCT local_date, strftime(local_date, '%Y-%m-%d') dt FROM m), dy AS (SELECT * FROM dd WHERE isodow(local_date) <= 5 AND dt NOT IN ({_HOLIDAYS})),
ss AS (SELECT local_date, 'premarket' AS session, 240 a, 570 z FROM dy UNION ALL SELECT local_date, 'regular', 570, {_CLOSE} FROM dy),
g AS (SELECT security_id, local_date, session, mi, CAST(epoch_us(timezone('America/New_York', CAST(local_date AS TIMESTAMP) + to_minutes(mi))) AS BIGINT) us FROM sec CROSS JOIN (SELECT local_date, session, CAST(unnest(range(a, z)) AS INTEGER) mi FROM ss)),
r AS (SELECT DISTINCT security_id, session, us // 60000000 * 60000000 us FROM m), hb AS (SELECT security_id, s, e FROM hi),
q AS (SELECT g.* FROM g ANTI JOIN r ON r.security_id = g.security_id AND r.session = g.session AND r.us = g.us),
hq AS (SELECT DISTINCT q.security_id, q.us FROM q JOIN hb ON hb.security_id = q.security_id AND q.us >= s AND q.us < e),
n AS (SELECT q.* FROM q ANTI JOIN hq ON hq.security_id = q.security_id AND hq.us = q.us),
u AS (SELECT *, mi - row_number() OVER (PARTITION BY security_id, local_date, session ORDER BY mi) k FROM n)
SELECT security_id, min(us) AS first_us, max(us) AS last_us, count(*) AS minutes FROM u GROUP BY security_id, local_date, session, k""",
    "feature_guards": f"""WITH {_CLEAN}, {_LAST}, x AS (SELECT m.*, li.security_id k, li.id_us FROM m LEFT JOIN li ON li.security_id = m.security_id)
SELECT code, security_id, count(*) AS n FROM (SELECT 'UNKNOWN_INSTRUMENT' AS code, security_id FROM x WHERE k IS NULL UNION ALL SELECT 'INSTRUMENT_NOT_AVAILABLE', security_id FROM x WHERE id_us > available_us UNION ALL SELECT 'OUTSIDE_SESSION', security_id FROM x WHERE session NOT IN ('premarket', 'regular') OR isodow(local_date) > 5) GROUP BY 1, 2""",
    "feature_pass": f"""WITH {_CLEAN.replace("m AS (", "m0 AS (")}, {_LAST}, {_SPLITS},
m AS (SELECT m0.*, li.ticker, li.sector, li.sector_us, li.shares_outstanding, li.shares_us, li.free_float, li.float_us FROM m0 JOIN li ON li.security_id = m0.security_id WHERE li.id_us <= m0.available_us AND session IN ('premarket', 'regular') AND isodow(local_date) <= 5),
{_CUM},
mo AS (SELECT security_id, us, {", ".join(f"(close / nullif(last_value(close) OVER (PARTITION BY security_id, local_date ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {w * B.MINUTE_US} PRECEDING), 0) - 1) * 100 AS mom{w}" for w in B.MOMENTUM_MINUTES)} FROM m),
k AS (SELECT *, CAST(floor((us - {_START}) / 60000000) AS BIGINT) AS mo_ FROM cum), pd AS (SELECT security_id, session, mo_, local_date, arg_max(session_volume, us) v FROM k GROUP BY ALL),
rb AS (SELECT *, avg(v) OVER (PARTITION BY security_id, session, mo_ ORDER BY local_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) bv FROM pd),
va AS (SELECT security_id, us, sum(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) a, sum(volume) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) b, us - lag(us, 9) OVER w AS g FROM m WINDOW w AS (PARTITION BY security_id, local_date, session ORDER BY us)),
v1 AS (SELECT *, lag(us) OVER w pu, lag(close) OVER w pc FROM m WINDOW w AS (PARTITION BY security_id, local_date ORDER BY us)), v2 AS (SELECT *, CASE WHEN us - pu = 60000000 AND pc > 0 AND close > 0 THEN ln(close / pc) END r FROM v1),
v3 AS (SELECT *, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY security_id, local_date ORDER BY us ROWS UNBOUNDED PRECEDING) run FROM v2), v4 AS (SELECT security_id, us, count(r) OVER q n, sum(r * r) OVER q sq FROM v3 WINDOW q AS (PARTITION BY security_id, local_date, run ORDER BY us ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, lag(close) OVER w pc, lag(us) OVER w pu FROM dly WINDOW w AS (PARTITION BY security_id ORDER BY us)), qf AS (SELECT q.security_id, q.us, product(s.ratio) factor FROM q JOIN s ON s.security_id = q.security_id AND q.pu < s.e AND s.e <= q.us AND s.k <= q.available_us GROUP BY 1, 2),
t AS (SELECT security_id, us, available_us, greatest(high - low, abs(high - coalesce(pc / coalesce(factor, 1), close)), abs(low - coalesce(pc / coalesce(factor, 1), close))) tr FROM q LEFT JOIN qf USING (security_id, us)),
ks AS (SELECT DISTINCT security_id, available_us FROM m), l AS (SELECT ks.security_id, ks.available_us, tr, row_number() OVER (PARTITION BY ks.security_id, ks.available_us ORDER BY t.us DESC) rn FROM ks JOIN t ON t.security_id = ks.security_id AND t.available_us <= ks.available_us),
atr_ AS (SELECT security_id, available_us, CASE WHEN count(*) FILTER (rn <= 14) = 14 THEN avg(tr) FILTER (rn <= 14) END atr FROM l GROUP BY 1, 2),
k3 AS (SELECT DISTINCT security_id, local_date, available_us FROM m), pc AS (SELECT k3.security_id, k3.local_date, k3.available_us, arg_max(dly.close, dly.us) p_close, max(dly.us) p_us FROM k3 JOIN dly ON dly.security_id = k3.security_id AND dly.local_date < k3.local_date AND dly.available_us <= k3.available_us GROUP BY ALL),
fo AS (SELECT security_id, local_date, arg_min(open, us) fo FROM m WHERE session = 'regular' GROUP BY ALL),
gp AS (SELECT m.security_id, m.us, any_value(p_close) / coalesce(product(s.ratio), 1) comp FROM m JOIN pc ON pc.security_id = m.security_id AND pc.local_date = m.local_date AND pc.available_us = m.available_us LEFT JOIN s ON s.security_id = m.security_id AND p_us < s.e AND s.e <= m.us AND s.k <= m.available_us GROUP BY 1, 2),
sb AS (SELECT sector, min(security_id) b FROM instruments WHERE sector IS NOT NULL GROUP BY 1), ix AS (SELECT min(security_id) b FROM m0),
j AS (SELECT c.*, mo.* EXCLUDE (security_id, us), rb.bv, va.a, va.b AS vb, va.g, v4.n vn, v4.sq, atr_.atr AS atr14, fo.fo, gp.comp, sm.mom5 s5, im.mom5 i5, (c.bid + c.ask) / 2 mid
 FROM k c JOIN mo ON mo.security_id = c.security_id AND mo.us = c.us JOIN rb ON rb.security_id = c.security_id AND rb.session = c.session AND rb.mo_ = c.mo_ AND rb.local_date = c.local_date JOIN va ON va.security_id = c.security_id AND va.us = c.us JOIN v4 ON v4.security_id = c.security_id AND v4.us = c.us
 LEFT JOIN atr_ ON atr_.security_id = c.security_id AND atr_.available_us = c.available_us LEFT JOIN fo ON fo.security_id = c.security_id AND fo.local_date = c.local_date LEFT JOIN gp ON gp.security_id = c.security_id AND gp.us = c.us
 LEFT JOIN sb ON sb.sector = c.sector AND c.sector_us <= c.available_us LEFT JOIN mo sm ON sm.security_id = sb.b AND sm.us = c.us LEFT JOIN mo im ON im.security_id = (SELECT b FROM ix) AND im.us = c.us)
SELECT security_id, ticker, us, available_us, session, bid, ask, CASE WHEN comp > 0 THEN round((CASE WHEN session = 'regular' THEN fo ELSE close END / comp - 1) * 100, 4) END AS gap_pct, CASE WHEN bv > 0 THEN round(session_volume / bv, 4) END AS relative_volume, round(close * volume, 2) AS dollar_volume, round(day_notional, 2) AS cumulative_dollar_volume,
 CASE WHEN free_float > 0 AND float_us <= available_us THEN round(day_volume / free_float, 8) END AS float_rotation, CASE WHEN shares_us <= available_us THEN round(close * shares_outstanding, 2) END AS market_cap, round(session_vwap, 4) AS vwap, CASE WHEN session_vwap > 0 THEN round((close / session_vwap - 1) * 100, 4) END AS vwap_distance,
 {", ".join(f"round(mom{w}, 4) AS momentum_{w}m" for w in B.MOMENTUM_MINUTES)}, CASE WHEN g = 540000000 AND vb > 0 THEN round(a / vb - 1, 4) END AS volume_acceleration, round(atr14, 4) AS atr, CASE WHEN vn >= 30 THEN round(sqrt(sq) * 100, 4) END AS realised_volatility,
 round(mom5 - s5, 4) AS sector_relative, round(mom5 - i5, 4) AS index_relative, CASE WHEN mid > 0 THEN round((ask - bid) / mid * 100, 4) END AS spread_pct FROM j""",
    "dup_bars": "SELECT security_id, timeframe, epoch_us(timestamp) AS us, count(*) - 1 AS repeats FROM bars GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "latest_per_security": f"WITH {_CLEAN} SELECT security_id, max(us) AS us, arg_max(close, us) AS close, arg_max(volume, us) AS volume FROM m GROUP BY 1",
}
