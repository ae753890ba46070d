"""Kernels, calendar, text and fits against plain Python, with nulls, ties, copies and empty tables."""

import math
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.calendar import SessionCalendar
from tidemark.operators import asof, attention, bars, metrics, modelling, quality, similarity


def utc(s):
    return datetime.fromisoformat(s + "+00:00")


# --- kernels


@pytest.mark.parametrize("bucket", [7, 1000])
def test_asof_last(spark, bucket):
    rng = random.Random(bucket)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-50, 60)]), i) for i in range(200)]
    right = [(rng.choice(["a", "b"]), rng.choice([None, rng.randrange(-50, 60)]), rng.choice([None, rng.randrange(99)])) for _ in range(60)]
    l = spark.createDataFrame(left, "k string, at long, i int")  # noqa: E741
    r = spark.createDataFrame(right, "k string, seen long, v int")
    low = lambda v: (v is not None, v or 0)
    want = {}
    for k, t, i in left:
        ok = [(s, low(v), v) for q, s, v in right if q == k and s is not None and t is not None and s <= t]
        want[i] = max(ok)[2] if ok else None
    assert {x["i"]: x["v"] for x in asof.asof_last(l, r, ["k"], "at", "seen", ["v"], bucket).collect()} == want
    assert asof.asof_last(l.limit(0), r, ["k"], "at", "seen", ["v"], bucket).collect() == []
    assert {x["v"] for x in asof.asof_last(l, r.limit(0), ["k"], "at", "seen", ["v"], bucket).collect()} == {None}
    with pytest.raises(ValueError, match="both sides"):
        asof.asof_last(l, r.withColumnRenamed("v", "i"), ["k"], "at", "seen", ["i"], bucket)


def test_islands_and_row_numbers(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 7, 8, 20)], "k string, at long")
    assert sorted((r["first"], r["last"], r["n"]) for r in asof.islands(df, ["k"], "at", 1).collect()) == [(1, 3, 3), (7, 8, 2), (20, 20, 1)]
    values = list(range(1000))
    random.Random(2).shuffle(values)
    n = asof.global_row_numbers(spark.createDataFrame([(v,) for v in values], "v long").repartition(5), ["v"]).collect()
    assert all(r["position"] == r["v"] + 1 for r in n) and len(n) == 1000
    assert asof.global_row_numbers(df.limit(0), ["at"]).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_similarity_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        base = [f"w{x}" for x in range(rng.choice([0, 3, 10, 12]))]
        rows.append((rng.choice(["p", "q"]), i, rng.randrange(40), sorted({*base[: rng.randrange(len(base) + 1)], *(f"z{rng.randrange(4)}" for _ in range(rng.randrange(3)))})))
    df = spark.createDataFrame(rows, "b string, i long, us long, t array<string>")
    members, pairs = similarity.similar_sets(df, ["b"], "i", "t", 0.8)
    got = {r["id"]: r["links"] for r in similarity.links(members, pairs, ["b"]).collect()}
    prior = {r["id"]: r["prior"] for r in similarity.latest_similar_before(members, pairs, df.select("b", F.col("i").alias("id"), "us"), ["b"], ["us"]).collect()}
    near = lambda a, b: a[0] == b[0] and a[1] != b[1] and len({*a[3]} & {*b[3]}) >= 0.8 * len({*a[3]} | {*b[3]}) - 1e-9
    full = [r for r in rows if r[3]]
    assert got == {a[1]: sum(near(a, b) for b in full) for a in full}
    assert prior == {a[1]: max(((b[2], b[1]) for b in full if near(a, b) and (b[2], b[1]) < (a[2], a[1])), default=(None, None))[1] for a in full}


# --- calendar, text, bars


@pytest.mark.parametrize(
    "at, want",
    [
        ("2026-03-06T08:59:59.999999", "outside"),
        ("2026-03-06T09:00:00", "premarket"),
        ("2026-03-06T14:29:59", "premarket"),
        ("2026-03-06T14:30:00", "regular"),
        ("2026-03-06T21:00:00", "outside"),
        ("2026-03-09T13:30:00", "regular"),  # the Monday after the clocks change
        ("2026-03-09T13:29:59", "premarket"),
        ("2026-03-07T15:00:00", "outside"),
        ("2026-03-10T15:00:00", "outside"),  # holiday
        ("2026-03-11T17:00:00", "outside"),  # early close at 13:00
        ("2026-03-11T16:59:00", "regular"),
    ],
)
def test_sessions(spark, at, want):
    c = SessionCalendar(holidays=("2026-03-10",), early_closes={"2026-03-11": 13 * 60})
    row = spark.createDataFrame([(utc(at), None)], "t timestamp, n timestamp").select(c.classify(F.col("t")).alias("s"), c.classify(F.col("n")).alias("n")).first()
    assert tuple(row) == (want, None)


def test_expected_minutes(spark):
    c = SessionCalendar(holidays=("2026-03-10",))
    df = spark.sql("select date'2026-03-09' d union all select date'2026-03-10' union all select date'2026-03-07'")
    n = {str(r["d"]): (r["n"], r["first"]) for r in df.select("d", F.size(c.expected_minutes(F.col("d"), F.lit("regular"))).alias("n"), F.unix_seconds(F.try_element_at(c.expected_minutes(F.col("d"), F.lit("regular")), F.lit(1))).alias("first")).collect()}
    assert n == {"2026-03-09": (390, int(utc("2026-03-09T13:30:00").timestamp())), "2026-03-10": (0, None), "2026-03-07": (0, None)}


def test_text_scalars(spark):
    t = "Revenue  rose 5.5% to $1.5 million, $2 bn; 100,000 shares and a 1-for-10 split expected on 2026-02-28. $1.5 million"
    df = spark.createDataFrame([(t,), (None,), ("",), ("scheduled 2026-02-30",)], "t string")
    rows = df.select(X.numeric_details(F.col("t")).alias("n"), X.expected_date(F.col("t")).alias("d"), X.normalised(F.col("t")).alias("x"), X.token_set(F.col("t")).alias("k"), X.mention_tokens(F.col("t")).alias("m")).collect()
    assert [(x["kind"], x["value"]) for x in rows[0]["n"]] == [("money", 1.5e6), ("money", 2e9), ("percentage", 5.5), ("shares", 100_000.0), ("ratio", 10.0)]
    assert str(rows[0]["d"]) == "2026-02-28" and [r["d"] for r in rows[1:]] == [None] * 3
    assert rows[0]["x"].startswith("revenue rose 5.5%") and " " not in rows[0]["x"]
    assert rows[1]["n"] == rows[1]["k"] == rows[2]["k"] == [] and "to" not in rows[0]["k"] and rows[3]["m"] == ["02", "2026", "30", "scheduled"]
    u = spark.createDataFrame([("https://a.example/x",), ("http://",), ("ftp://a",), (None,), ("fix://x",), ("https://evil-sec.example",)], "u string")
    got = [tuple(r) for r in u.select(X.valid_link(F.col("u")), X.valid_link(F.col("u"), ("fix",)), X.host_within(F.col("u"), "sec.example")).collect()]
    assert got == [(True, True, False), (False, False, False), (False, False, False), (False, False, False), (False, True, False), (True, True, False)]


def test_bar_features_by_hand(spark):
    t0 = int(utc("2026-03-06T14:30:00").timestamp()) * 1_000_000
    rows = [("S", "1m", datetime.fromtimestamp(t0 / 1e6 + 60 * k, timezone.utc), datetime.fromtimestamp(t0 / 1e6 + 60 * k + 60, timezone.utc), 11 + 0.1 * k, 200) for k in range(10)]
    rows += rows[:2] + [("S", "1m", rows[0][2], rows[0][3], float("nan"), 1), ("S", "1m", rows[3][2], rows[3][3], None, 1), (None, "1m", rows[0][2], rows[0][3], 1.0, 1)]
    df = spark.createDataFrame(rows, "security_id string, timeframe string, timestamp timestamp, available_at timestamp, close double, volume long")
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low")} | {c: F.lit(None).cast("double") for c in ("vwap", "bid", "ask")} | {"trade_count": F.lit(None).cast("long"), "session": F.lit("regular")})
    m = bars.clean_bars(df, "1m")
    assert m.count() == 10
    last = bars.volume_acceleration(bars.momentum(bars.cumulative(m))).orderBy(F.desc("us")).first()
    assert math.isclose(last["momentum_5m"], (11.9 / 11.4 - 1) * 100) and last["momentum_15m"] is None
    assert last["session_volume"] == 2000 and math.isclose(last["session_vwap"], 11.45) and last["volume_acceleration"] == 0.0
    day = bars.daily_rollup(m).first()
    assert (day["open"], day["volume"], day["minutes"]) == (11.0, 2000, 10) and math.isclose(day["close"], 11.9)
    splits = spark.createDataFrame([("S", t0 + 1, t0, 2.0), ("S", t0 + 1, t0 + 99, 5.0), ("S", t0 + 2, t0, 0.0)], "security_id string, effective_us long, available_us long, ratio double")
    adj = bars.split_adjusted(m, splits, t0 + 50).orderBy("us").collect()
    assert [(r["close"], r["volume"], r["factor"]) for r in adj[:2]] == [(5.5, 400, 2.0), (11.1, 200, 1.0)]
    assert bars.daily_rollup(m.limit(0)).collect() == [] == bars.momentum(m.limit(0)).collect()


def test_quality_gate_fails_closed(spark):
    df = spark.createDataFrame([("a", -1), ("b", 1), ("c", None)], "k string, v int")
    bad = quality.row_issues(df, [quality.Rule("NEGATIVE", F.col("v") < 0), quality.Rule("ONE", F.col("v") == 1, "warning")], F.col("k"), F.lit(5).cast("long"))
    assert sorted((r["code"], r["entity_id"]) for r in bad.collect()) == [("NEGATIVE", "a"), ("ONE", "b")]
    with pytest.raises(quality.QualityError, match="NEGATIVE: 1"):
        quality.gate([bad])
    assert quality.gate([bad.filter("severity = 'warning'")]).count() == 1
    twice = quality.repeated_key(spark.createDataFrame([("x",)] * 3 + [("y",)], "k string"), ["k"], "DUP", F.lit(0).cast("long"))
    assert [r["entity_id"] for r in twice.collect()] == ["x", "x"]


def test_split_behaviour_and_coverage(spark):
    daily = spark.createDataFrame([("r", 1, 10.0, 10.0, "raw"), ("r", 5, 10.0, 10.0, "raw"), ("a", 1, 10.0, 10.0, "split_adjusted"), ("a", 5, 5.0, 5.0, "split_adjusted"), ("o", 1, 10.0, 10.0, "raw"), ("o", 5, 5.0, 5.0, "raw"), ("n", 9, 1.0, 1.0, "raw")], "security_id string, us long, open double, close double, adjustment string")
    actions = spark.createDataFrame([(s, 3, 2.0) for s in "raon"], "security_id string, effective_us long, ratio double")
    assert sorted((r["security_id"], r["code"]) for r in quality.split_behaviour(daily, actions).collect()) == [("a", "ADJUSTED_LOOKS_RAW"), ("r", "RAW_LOOKS_ADJUSTED")]
    spans = spark.createDataFrame([(0, 10), (10, 20), (20, 30)], "start_us long, end_us long")
    d = spark.createDataFrame([(0, None), (10, 25)], "started_us long, ended_us long")
    assert [r["complete"] for r in attention.covered(spans, d).orderBy("start_us").collect()] == [False, True, False]
    assert all(r["complete"] for r in attention.covered(spans, d.limit(0)).collect())
    m = spark.createDataFrame([("s", ["a", "b"]), ("s", ["b", "c"]), ("t", None)], "security_id string, urls array<string>")
    c = spark.createDataFrame([("s", "b", True, 1), ("s", "c", False, 1), ("s", "a", True, 9), ("t", "b", True, 1)], "security_id string, url string, is_primary boolean, available_us long")
    assert [tuple(r) for r in attention.linked_primary(m, c, 5).collect()] == [("s", ["b"])]


def test_engagement_and_links(spark):
    snaps = "array<struct<observed_us:long,available_us:long,likes:long,replies:long,reposts:long>>"
    h = 3_600_000_000
    df = spark.createDataFrame([(1, [(0, 0, 1, None, 1), (h, h, 9, 1, None), (2 * h, 99 * h, 99, 0, 0)]), (2, [(0, 0, 5, 0, 0), (h, h, 1, 0, 0)]), (3, [(0, 0, 1, 1, 1)]), (4, None), (5, [(0, 0, None, None, None), (h, h, 1, 0, 0)])], f"i int, s {snaps}")
    assert {r["i"]: r["v"] for r in df.select("i", attention.engagement_velocity("s", 3 * h).alias("v")).collect()} == {1: 8.0, 2: 0.0, 3: None, 4: None, 5: None}
    m = spark.createDataFrame([("s", "u1", None, 9), ("s", "u2", True, 1), ("s", "u1", False, 3), ("s", None, False, 0), ("s", "u3", False, 5)], "security_id string, url string, is_repost boolean, first_seen_us long")
    assert attention.first_links(m, 2).first()["links"] == ["u1", "u3"]


# --- fits: the plain loops they stand for


def plain_logistic(x, y, steps=280):
    n, d = len(x), len(x[0])
    b, k = modelling.logit((sum(y) + 1) / (n + 2)), [0.0] * d
    for i in range(steps):
        gb, gk = 0.0, [0.0] * d
        for row, t in zip(x, y):
            r = 1 / (1 + math.exp(-max(-40, min(40, b + sum(w * v for w, v in zip(k, row)))))) - t
            gb += r
            for j, v in enumerate(row):
                gk[j] += r * v
        rate = 0.08 / math.sqrt(1 + i / 100)
        b, k = b - rate * gb / n, [w - rate * (g / n + 0.08 * w) for w, g in zip(k, gk)]
    return [b, *k]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    rows = [(float(rng.randrange(5)), float(rng.randrange(-2, 4)), float(rng.random() < 0.4)) for _ in range(120)]
    return rows, spark.createDataFrame([*rows, (1.0, 1.0, None)], "a double, b double, y double")


@pytest.mark.parametrize("local", [True, False])
def test_fits_equal_plain_loops(table, monkeypatch, local):
    rows, df = table
    if not local:
        monkeypatch.setattr(modelling, "LOCAL_ROWS", 0)
    cells = modelling.Cells(df, ["a", "b"], "y")
    assert (cells.local is not None) is local
    x, y = [r[:2] for r in rows], [r[2] for r in rows]
    steps = 280 if local else 4
    assert np.allclose(modelling.fit_logistic(cells, steps), plain_logistic(x, y, steps), atol=1e-9)
    a = np.column_stack([np.ones(len(x)), np.array(x)])
    k = np.array([np.mean(y), 0, 0])
    for i in range(360):
        k = k - 0.025 / math.sqrt(1 + i / 150) * (a.T @ (a @ k - y) / len(y) + np.array([0, 0.1, 0.1]) * k)
    assert np.allclose(modelling.fit_ridge(cells), k, atol=1e-9)


def test_stumps_equal_exhaustive_search(table):
    rows, df = table
    cells = modelling.Cells(df, ["a", "b"], "y")
    base, stumps = modelling.fit_stumps(cells, rounds=5)
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    z = np.full(len(y), modelling.logit((y.sum() + 1) / (len(y) + 2)))
    assert math.isclose(base, z[0])
    for j, t, left, right, gain in stumps:
        r, best = y - 1 / (1 + np.exp(-z)), None
        total = ((r - r.mean()) ** 2).sum()
        for f in range(2):
            v = np.unique(x[:, f])
            for c in sorted({(v[i] + v[i + 1]) / 2 for q in (0.2, 0.4, 0.6, 0.8) for i in (min(len(v) - 2, int(q * (len(v) - 1))),)}):
                lo, hi = r[x[:, f] <= c], r[x[:, f] > c]
                g = total - ((lo - lo.mean()) ** 2).sum() - ((hi - hi.mean()) ** 2).sum()
                if best is None or g > best[0] + 1e-12:
                    best = (g, f, c, lo.mean(), hi.mean())
        assert (best[1], best[2]) == (j, t) and np.allclose([best[0], *best[3:]], [gain, left, right])
        z = z + 0.12 * np.where(x[:, j] <= t, left, right)


def test_platt_and_selection(spark):
    rng = random.Random(4)
    rows = [(modelling.logit(p := rng.uniform(0.05, 0.95)), float(rng.random() < p * p)) for _ in range(200)]
    a, b = 0.0, 1.0
    for i in range(220):
        r = [1 / (1 + math.exp(-(a + b * v))) - t for v, t in rows]
        rate = 0.05 / math.sqrt(1 + i / 100)
        a, b = a - rate * sum(r) / len(r), b - rate * (sum(x * v for x, (v, _) in zip(r, rows)) / len(r) + 0.02 * (b - 1))
    df = spark.createDataFrame(rows, "z double, y double")
    assert np.allclose(modelling.fit_platt(modelling.Cells(df, ["z"], "y")), (a, b), atol=1e-9)
    assert modelling.fit_platt(modelling.Cells(df.limit(9), ["z"], "y")) == (0.0, 1.0)
    s = spark.createDataFrame([("t", "simple", 0, 0.204), ("t", "mid", 1, 0.2), ("t", "big", 2, 0.1995)], "target string, model string, rank int, score double")
    assert modelling.select_simplest(s, 0.005).first()["model"] == "simple"


def test_bootstrap_and_stability(spark):
    rng = random.Random(8)
    rows = [(i % 40, rng.random(), float(rng.random() < 0.5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "c int, p double, y double")
    full = sum((p - y) ** 2 for _, p, y in rows) / len(rows)
    got = {r["metric"]: (r["low"], r["high"]) for r in metrics.cluster_bootstrap(df, "c", 200).collect()}
    assert got["brier"][0] < full < got["brier"][1] and got["brier"][1] - got["brier"][0] < 0.05
    assert {r["metric"]: (r["low"], r["high"]) for r in metrics.cluster_bootstrap(df.repartition(7), "c", 200).collect()}.keys() == got.keys()
    draws = metrics.bootstrap_draws(spark, df, "c", 3, 7).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert [r["n"] for r in draws] == [40, 40, 40]
    e = spark.createDataFrame([("m", 0, "f", 1.0), ("m", 1, "f", -1.0), ("m", 0, "g", 2.0), ("m", 1, "g", 2.0), ("m", 0, "h", 1.0)], "model string, fold int, feature string, effect double")
    assert {r["feature"]: (r["presence"], r["flips"], r["unstable"]) for r in metrics.effect_stability(e).collect()} == {"f": (1.0, True, True), "g": (1.0, False, False), "h": (0.5, False, True)}
