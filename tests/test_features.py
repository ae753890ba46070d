"""The whole feature pass on a small case worked out by hand, and its guards."""

from datetime import UTC, date, datetime, timedelta

import pytest

from tidemark.operators import features

MIN = 60_000_000
DAYS = [date(2026, 7, 13), date(2026, 7, 14)]
OPEN = {d: int(datetime(d.year, d.month, d.day, 13, 30, tzinfo=UTC).timestamp()) * 1_000_000 for d in DAYS}
BAR = "security_id string, local_date date, session string, us long, available_us long, open double, high double, low double, close double, volume long, vwap double, bid double, ask double, trade_count long"
INSTRUMENT = "security_id string, version_id long, ticker string, available_at timestamp, sector string, sector_available_at timestamp, shares_outstanding long, shares_outstanding_available_at timestamp, free_float long, free_float_available_at timestamp"
EARLY = datetime(2026, 1, 1, tzinfo=UTC)


def case(spark, float_known=EARLY):
    base = {"S": 10.0, "SEC": 50.0, "IDX": 400.0}
    minute = []
    for k, d in enumerate(DAYS):
        for m in range(10):
            for s, p in base.items():
                us, c = OPEN[d] + m * MIN, p + k + 0.1 * m
                minute.append((s, d, "regular", us, us + MIN, c, c + 0.05, c - 0.05, c, 100 * (k + 1), c, c - 0.01, c + 0.01, 1))
    daily = []
    for s, p in base.items():
        for back in (2, 1):
            us = OPEN[DAYS[1]] - back * 86_400_000_000
            daily.append((s, DAYS[1] - timedelta(back), "regular", us, us + 8 * 3_600_000_000, p, p + 1, p - 1, p, 1000, None, None, None, None))
    inst = [(s, 1, s.lower(), EARLY, "Technology" if s == "S" else None, EARLY, 2000, EARLY, 1000, float_known if s == "S" else EARLY) for s in base]
    actions = spark.createDataFrame([], "security_id string, effective_us long, available_us long, ratio double")
    return spark.createDataFrame(minute, BAR), spark.createDataFrame(daily, BAR), spark.createDataFrame(inst, INSTRUMENT), actions


def run(minute, daily, inst, actions, **more):
    out = features.compute_features(minute, daily, inst, actions, {"Technology": "SEC"}, "IDX", atr_period=2, volatility_window=2, **more)
    return {(r["security_id"], r["us"]): r for r in out.collect()}


def test_two_days(spark):
    got = run(*case(spark))
    assert len(got) == 60
    first, last = got["S", OPEN[DAYS[1]]], got["S", OPEN[DAYS[1]] + 9 * MIN]
    want = {"gap_pct": 10.0, "relative_volume": 2.0, "dollar_volume": 2200.0, "float_rotation": 0.2, "market_cap": 22_000.0, "vwap": 11.0, "atr": 2.0}
    assert {k: round(first[k], 9) for k in want} == want
    assert first["momentum_1m"] is None and first["volume_acceleration"] is None and first["ticker"] == "s"
    own, sector = (11.9 / 11.4 - 1) * 100, (51.9 / 51.4 - 1) * 100
    assert abs(last["momentum_5m"] - own) < 1e-9 and abs(last["sector_relative"] - (own - sector)) < 1e-9
    assert abs(last["index_relative"] - (own - (401.9 / 401.4 - 1) * 100)) < 1e-9
    assert last["volume_acceleration"] == 0.0 and last["realised_volatility"] > 0 and abs(last["spread_pct"] - 0.02 / 11.9 * 100) < 1e-9
    day_one = got["S", OPEN[DAYS[0]]]  # the daily bar of that day itself isn't known yet
    assert day_one["relative_volume"] is None and day_one["atr"] is None and day_one["gap_pct"] == 0.0


def test_what_is_known_later_isnt_used(spark):
    got = run(*case(spark, float_known=datetime(2026, 7, 19, tzinfo=UTC)))
    assert got["S", OPEN[DAYS[1]]]["float_rotation"] is None and got["IDX", OPEN[DAYS[1]]]["float_rotation"] == 0.2


def test_guards(spark):
    minute, daily, inst, actions = case(spark)
    odd = spark.createDataFrame([("X", DAYS[0], "regular", 1, 2, 1.0, 1.0, 1.0, 1.0, 1, None, None, None, None), ("S", DAYS[0], "outside", 3, 4, 1.0, 1.0, 1.0, 1.0, 1, None, None, None, None)], BAR)
    codes = sorted((r["code"], r["security_id"]) for r in features.guards(odd, inst).collect())
    assert codes == [("INSTRUMENT_NOT_AVAILABLE", "S"), ("OUTSIDE_SESSION", "S"), ("UNKNOWN_INSTRUMENT", "X")]
    with pytest.raises(Exception, match="UNKNOWN_INSTRUMENT X"):
        run(minute.unionByName(odd.filter("security_id = 'X'")), daily, inst, actions)
    assert len(run(minute.unionByName(odd), daily, inst, actions, strict=False)) == 60
    assert run(minute.limit(0), daily, inst, actions) == {} and len(run(minute, daily.limit(0), inst, actions)) == 60
