"""Queries that once did a part of the job, on small tables with results worked out by hand or by brute force."""

import random
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from tidemark.operators import asof, attention
from tidemark.operators import bars as B
from tidemark.plans import documents, models

MIN = 60_000_000


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def us(text):
    return int(at(text).timestamp()) * 1_000_000


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def clock_tables(spark, d):
    seen = at("2026-01-05T16:00:00")
    texts = ["2026-01-05T15:00:00.000000Z", "2026-01-05T10:01:00-05:00", "1767625320", "2026-01-05 10:03:00", "n/a"]
    rows = [(f"o{i}", "S", "T", t, seen, "ny", c, 100, 1.0, 2.0, 1000, []) for i, (t, c) in enumerate(zip(texts, [10.0, 11.0, 12.1, 24.2, 99.0]))]
    schema = "observation_id string, security_id string, ticker string, source_timestamp string, first_seen_at timestamp, feed string, close double, volume long, bid double, ask double, free_float long, missing_flags array<string>"
    write(spark, d, "market_observations", rows, schema)
    write(spark, d, "feed_zones", [("ny", "America/New_York")], "feed string, zone string")
    write(spark, d, "catalyst_events", [("a", " t ", at("2026-01-05T15:00:00"))], "event_id string, ticker string, available_at timestamp")


def test_observations_of_every_clock_text_count(spark, tmp_path):
    clock_tables(spark, str(tmp_path))
    got = {r["observation_id"]: r["return_pct"] for r in models.gated_features(spark, str(tmp_path)).collect()}
    assert got == {"o1": 10.0, "o2": 10.0, "o3": 100.0}
    five = models.alert_outcomes(spark, str(tmp_path)).filter("horizon = 5").collect()
    assert [tuple(r[c] for c in ("alert_id", "observations", "last", "highest", "lowest", "return_pct", "mae_pct")) for r in five] == [("a", 3, 24.2, 24.2, 11.0, 142.0, 10.0)]


def test_two_clock_lookup_has_no_lower_bound(spark):
    rng = random.Random(5)
    day = 1440 * MIN
    right = [("k%d" % rng.randrange(3), rng.randrange(40 * day), 0, float(i)) for i in range(120)]
    right = [(k, o, o + rng.choice([0, MIN, 3 * day, 20 * day]), v) for k, o, _, v in right]
    left = [("k%d" % rng.randrange(4), i, e := rng.randrange(45 * day), e + rng.choice([-5 * day, 0, MIN, 9 * day])) for i in range(200)]
    want = {i: max(((o, v) for q, o, a, v in right if q == k and o <= e and a <= n), default=(None, None)) for k, i, e, n in left}
    got = attention.two_clock_last(
        spark.createDataFrame(left, "k string, id long, event_us long, known_us long"), spark.createDataFrame(right, "k string, observed_us long, available_us long, value double"), ["k"]
    )
    assert {r["id"]: (r["observed_us"], r["value"]) for r in got.collect()} == want
    assert any(o is not None and e - o > 3_600_000_000 for (_, i, e, _) in left for o in [want[i][0]])


def test_grid_holds_whole_sessions_of_all_securities(spark):
    rng, zone = random.Random(7), ZoneInfo("America/New_York")
    dates = [date(2026, 3, 6), date(2026, 3, 9), date(2026, 3, 7)]  # clocks change on the 8th; the 7th is a Saturday
    begin = {(d, s): int(datetime(d.year, d.month, d.day, *hm, tzinfo=zone).timestamp()) // 60 for d in dates for s, hm in (("premarket", (4, 0)), ("regular", (9, 30)))}
    grid = {(d, s): range(t, t + (330 if s == "premarket" else 390)) for (d, s), t in begin.items() if d.weekday() < 5}
    rows = [("A", d, s, t * MIN + 7) for (d, s), g in grid.items() for t in g if rng.random() < 0.6] + [("B", dates[2], "regular", begin[dates[2], "regular"] * MIN)]
    t0 = begin[dates[0], "regular"]
    halts = [("A", (t0 + 5) * MIN + 1, (t0 + 50) * MIN + 1), ("B", (t0 + 300) * MIN, -1), ("C", (t0 - 10**5) * MIN, (t0 + 20) * MIN)]
    have = {(k, s, t // MIN) for k, _, s, t in rows}
    want = []
    for k in "ABC":
        for (_, s), g in grid.items():
            gone = [t for t in g if (k, s, t) not in have and not any(h == k and a <= t * MIN and (z == -1 or t * MIN < z) for h, a, z in halts)]
            want += [(k, t * MIN) for t in gone]
    got = B.missing_runs(
        spark.createDataFrame(rows, "security_id string, local_date date, session string, us long"), spark.createDataFrame(halts, "security_id string, start_us long, end_us long"), spark.createDataFrame([("A",), ("B",), ("C",)], "security_id string")
    ).collect()
    assert all(r["last_us"] - r["first_us"] == (r["minutes"] - 1) * MIN for r in got)
    assert sorted((r["security_id"], r["first_us"] + i * MIN) for r in got for i in range(r["minutes"])) == sorted(want)


def test_previous_daily_takes_each_bar_from_its_own_availability(spark):
    rng = random.Random(9)
    day = 1440 * MIN
    first = us("2026-01-05T05:00:00")
    daily = [("A", first + i * day, first + (i + 1) * day + rng.choice([0, 0, 5 * day, 12 * day]), float(i)) for i in range(30)]
    minute = [("A", first + i * day + 10 * 60 * MIN, first + i * day + 10 * 60 * MIN + rng.choice([0, 3 * day]), date(2026, 1, 5) + timedelta(i)) for i in range(30)]
    want = {}
    for _, t, known, local in minute:
        want[t] = max(((u, c) for _, u, a, c in daily if date(2026, 1, 5) + timedelta((u - first) // day) < local and a <= known), default=(None, None))
    got = B.previous_daily(
        spark.createDataFrame(minute, "security_id string, us long, available_us long, local_date date"), spark.createDataFrame(daily, "security_id string, us long, available_us long, close double")
    )
    assert {r["us"]: (r["prior_us"], r["prior_close"]) for r in got.collect()} == want


def test_prior_close_is_comparable_over_known_splits(spark):
    actions = spark.createDataFrame([("A", 15, 12, 2.0), ("A", 25, 40, 5.0), ("A", 10, 0, 7.0), ("B", 15, 0, 3.0)], "security_id string, effective_us long, available_us long, ratio double")
    daily = spark.createDataFrame([("A", 10, 11, 102.0, 98.0, 100.0), ("A", 20, 21, 51.0, 49.0, 50.0), ("A", 30, 31, 51.0, 50.0, 50.0)], "security_id string, us long, available_us long, high double, low double, close double")
    assert {r["us"]: r["true_range"] for r in B.true_range(daily, actions).collect()} == {10: 4.0, 20: 2.0, 30: 1.0}
    schema = "security_id string, local_date date, session string, us long, available_us long, open double, close double, prior_close double, prior_us long"
    minute = [("A", date(2026, 1, 6), "premarket", 18, 19, 49.0, 55.0, 100.0, 10), ("A", date(2026, 1, 6), "regular", 19, 20, 60.0, 1.0, 100.0, 10), ("A", date(2026, 1, 7), "regular", 28, 45, 11.0, 1.0, 50.0, 20)]
    got = {r["us"]: (r["prior_close"], round(r["gap_percent"], 6)) for r in B.gap_percent(spark.createDataFrame(minute, schema), actions).collect()}
    assert got == {18: (100.0, 10.0), 19: (100.0, 20.0), 28: (50.0, 10.0)}


def test_every_document_has_a_row_and_equal_texts_without_tokens_one_class(spark, tmp_path):
    t = [at(f"2026-01-0{i}T00:00:00") for i in range(1, 8)]
    jp, words = "東京 株式", "profit rose sharply in quarter"
    rows = [(1, "A", jp, t[0]), (2, "A", f" 東京　株式\n", t[1]), (3, "A", "大阪", t[2]), (4, "B", jp, t[3]), (5, "A", None, t[4]), (6, "A", "", t[5]), (7, "A", " \t", t[6]), (8, None, jp, t[0]), (9, "A", words, None), (10, "A", words, t[0]), (11, "A", words, t[1]), (12, "A", "a the", t[1]), (13, "A", "The  a", t[2])]
    write(spark, str(tmp_path), "documents", rows, "doc_id long, ticker string, text string, published_at timestamp")
    got = {r["doc_id"]: (r["class_id"], r["links"], r["prior"]) for r in documents.near_dup_jaccard(spark, str(tmp_path)).collect()}
    alone = {i: (i, 0, None) for i in (3, 4, 5, 6, 7, 8, 12, 13)}
    assert got == alone | {1: (1, 1, None), 2: (1, 1, 1), 9: (9, 2, None), 10: (9, 2, None), 11: (9, 2, 10)}


def test_atr_takes_the_last_days_known_in_whatever_order_they_arrive(spark):
    rng = random.Random(3)
    daily = [("AB"[i % 2], i * 100, i * 100 + rng.choice([50, 400, 1700]), 10.0 + rng.random() * 5, 9.0, 9.5) for i in range(60)]
    minute = [("AB"[i % 2], i * 90 + 7) for i in range(80)]
    frame = spark.createDataFrame(daily, "security_id string, us long, available_us long, high double, low double, close double")
    none = spark.createDataFrame([], "security_id string, effective_us long, available_us long, ratio double")
    ranges = {(r["security_id"], r["us"]): r["true_range"] for r in B.true_range(frame, none).collect()}
    want = {}
    for k, t in minute:
        known = sorted((u, ranges[k, u]) for q, u, a, *_ in daily if q == k and a <= t)[-5:]
        want[k, t] = round(sum(x for _, x in known) / 5, 9) if len(known) == 5 else None
    got = B.atr_known_at(spark.createDataFrame(minute, "security_id string, available_us long"), frame, none, 5).collect()
    assert {(r["security_id"], r["available_us"]): None if r["atr"] is None else round(r["atr"], 9) for r in got} == want
    assert any(v is None for v in want.values()) and len(set(want.values())) > 20


def test_the_row_before_may_be_days_before(spark):
    rows = [("A", 5, "x", 1.0), ("A", 5, "y", 2.0), ("A", 950, "z", 3.0), ("A", 951, "w", 4.0), ("A", None, "n", 5.0), ("B", 4, "q", 6.0)]
    got = asof.previous_row(spark.createDataFrame(rows, "k string, us long, id string, v double"), ["k"], "us", "id", ["v"], 100).collect()
    assert {r["id"]: (r["prev_us"], r["prev_v"]) for r in got} == {"x": (None, None), "y": (5, 1.0), "z": (5, 2.0), "w": (950, 3.0), "n": (None, None), "q": (None, None)}
