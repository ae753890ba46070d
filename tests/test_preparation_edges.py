"""Operators of problems 1 to 4, 6 and 7 on small fixtures: random cases against brute force, nulls, ties, copies, empty tables."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.clocktext import choose, read_clock
from tidemark.functions.jsoncanon import canonical_json
from tidemark.operators import clocks, deliveries, grid, intervals, knownat, lateness

T0 = 1_760_000_000_000_000


@pytest.fixture
def many_parts(spark):
    """Range partitions stay apart, so that entities span several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def at(us):
    return None if us is None else datetime.fromtimestamp(us / 1e6, timezone.utc)


# --- 1: deliveries

DELIVERY = "delivery_id long, source_family string, source_id string, first_seen_at timestamp, payload string, zone string, message_digest string"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"a": 1, "b": [1, 2]}', '{"b":[1.0,20e-1],"a":1e0}', True),
        ('{"a": 1}', '{"a": "1"}', False),
        ('{"a": null}', "{}", False),
        ("[1, 2]", "[2, 1]", False),
        ('{"a": "\\u00e9"}', '{"a": "é"}', True),
        ("100000000000000000000000000001", "100000000000000000000000000002", False),
        ("-0", "0.0", True),
        ("1e400", "10e399", True),
        ("true", "1", False),
        ("not json", " not json", False),
        ('"1e0"', '"e000"', False),
        ('{"a": "\ue000", "n": 1}', '{"n": 1.0, "a": "\\uE000"}', True),
        ('["\ue000", 1]', '["\ue000", "1e0"]', False),
        ("NaN", "NaN ", False),
    ],
)
def test_json_values(a, b, same):
    assert (canonical_json(a) == canonical_json(b)) is same


def test_deliveries_nulls_ties_and_copies(spark):
    rows = [
        (5, "f", "x", at(T0), '{"a":1}', "z", "d"),
        (4, "f", "x", at(T0), '{"a":1.0}', None, None),  # tie: smaller id is kept
        (3, "f", "x", None, '{"a":1}', None, None),  # null time comes last
        (6, "f", "x", at(T0), '{"a":2}', None, None),
        (7, None, "x", at(T0), '{"a":1}', None, None),
        (8, None, "x", None, '{"a":1}', None, None),
        (9, "f", None, at(T0), '{"a":1}', None, None),
        (10, "f", "y", at(T0), None, None, None),
        (11, "f", "y", at(T0), None, None, None),
        (12, "f", "y", at(T0), "", None, None),
        (12, "f", "y", at(T0), "", None, None),
        (13, "f", "l", at(T0), '["' + "x" * 2_000_000 + '"]', None, None),
        (14, "f", "n", at(T0), "[" * 5000, None, None),
    ]
    df = spark.createDataFrame(rows, DELIVERY)
    assert sorted(r[0] for r in deliveries.repeated_deliveries(df).collect()) == [3, 5, 8, 11]
    assert deliveries.repeated_deliveries(df.limit(0)).collect() == []


def test_ledger_keeps_the_earliest_whatever_batch_it_came_in(spark, tmp_path):
    ledger = deliveries.DeliveryLedger(spark, str(tmp_path / "ledger"))
    a = spark.createDataFrame([(1, "f", "x", at(T0), "[1]"), (2, "f", "x", at(T0), "[1.0]"), (3, None, "x", at(T0), None)], "delivery_id long, source_family string, source_id string, first_seen_at timestamp, payload string")
    b = spark.createDataFrame([(4, "f", "x", at(T0 - 5), "[ 1 ]"), (5, "f", "y", at(T0), "[1]"), (6, None, "x", at(T0), None), (4, "f", "x", at(T0 - 5), "[ 1 ]")], a.schema)
    ids = lambda df: sorted(r["delivery_id"] for r in df.collect())
    assert ids(ledger.accept(a, 1)) == [2]
    assert ids(ledger.accept(b, 2)) == [1, 6]  # 4 came later but arrived before 1
    assert ids(ledger.accept(b, 2)) == [1, 6]  # replayed
    assert ids(ledger.accept(a.limit(0), 3)) == []
    kept = ids(ledger.kept())
    ledger.compact(9)
    assert kept == ids(ledger.kept()) == [3, 4, 5] and [p.name for p in (tmp_path / "ledger").iterdir() if p.is_dir()] == ["batch=9"]
    assert ids(ledger.accept(a, 4)) == [1, 2]  # 3 is the one kept


@pytest.mark.parametrize("seed", range(2))
def test_waves_find_each_repeat_once(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "f", f"s{rng.randrange(20)}", at(T0 + rng.randrange(9)) if rng.random() < 0.9 else None, f"[{rng.randrange(2)}]") for i in range(150)]
    df = spark.createDataFrame(rows, "delivery_id long, source_family string, source_id string, first_seen_at timestamp, payload string")
    best = {}
    for i, _, s, t, p in rows:
        best[s, p] = min(best.get((s, p), (True,)), (t is None, t or at(0), i)) if (s, p) in best else (t is None, t or at(0), i)
    want = sorted({r[0] for r in rows} - {x[2] for x in best.values()})
    waves = [df.filter(F.col("delivery_id") % 3 == k) for k in range(3)]
    assert sorted(r[0] for r in deliveries.repeated_deliveries(df, waves).collect()) == want


# --- 2: intervals


def merged(rows):
    out = []
    for ent in sorted({e for e, *_ in rows if e is not None}):
        spans = sorted((s, intervals.OPEN if e is None else e) for x, s, e in rows if x == ent and s is not None and (e is None or e > s))
        runs = []
        for s, e in spans:
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out += [(ent, "period", s, -1 if e == intervals.OPEN else e) for s, e in runs]
        out += [(ent, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_intervals_against_brute_force(spark, seed):
    rng = random.Random(seed)
    width = 1 << intervals.SHARD_BITS
    rows = []
    for _ in range(300):
        scale = rng.choice([100, width // 50, width, 5 * width, 40 * width])
        s = rng.choice([0, T0, -3 * width]) + rng.randrange(-scale, scale)
        if rng.random() < 0.2:
            s = s // width * width  # on a shard's edge
        e = None if rng.random() < 0.01 else s + rng.choice([0, 1, -5, rng.randrange(scale) + 1, width, 2 * width])
        rows.append((rng.choice(["a", "b", "c", None]) if rng.random() < 0.7 else "hot", s if rng.random() > 0.02 else None, e))
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "k string, s long, e long, entity string, shard int")
    got = sorted(map(tuple, intervals.merge_intervals(df, "k", F.col("s"), F.col("e")).collect()))
    assert got == merged(rows)


def test_intervals_empty(spark):
    df = spark.createDataFrame([], "k string, s long, e long")
    assert intervals.merge_intervals(df, "k", F.col("s"), F.col("e")).collect() == []


# --- 3: clocks


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2025-11-02 01:30:00", "America/New_York", ("2025-11-02T05:30:00", "2025-11-02T06:30:00")),
        ("2026-03-08 02:30:00", "America/New_York", None),
        ("2026-03-08 02:30:00 EST", "America/New_York", "2026-03-08T07:30:00"),
        ("2025-11-02T01:30:00[America/New_York]", None, ("2025-11-02T05:30:00", "2025-11-02T06:30:00")),
        ("2025-04-06 01:45:00", "Australia/Lord_Howe", ("2025-04-05T14:45:00", "2025-04-05T15:15:00")),
        ("03/04/2026 12:05:09 AM", "UTC", "2026-03-04T00:05:09"),
        ("03/04/2026 13:05:09 PM", "UTC", None),
        ("04.03.2026 00:05:09", "UTC", "2026-03-04T00:05:09"),
        ("2026-02-30T00:00:00Z", None, None),
        ("2026-02-28T24:00:00Z", None, None),
        ("2026-02-28T23:59:60Z", None, None),
        ("2026-02-28", "UTC", None),
        ("20260228235958", None, "2026-02-28T23:59:58"),
        ("1772323198", None, "2026-02-28T23:59:58"),
        ("12345", "UTC", None),
        ("2026-02-28 23:59:58", None, None),
        ("2026-02-28 23:59:58 XYZ", "UTC", None),
        ("2026-02-28 23:59:58 Mars/Base", "UTC", None),
        ("2026-02-28 23:59:58−05", None, "2026-03-01T04:59:58"),
        ("  Sat, 28 Feb 2026 23:59:58 +0530 ", None, "2026-02-28T18:29:58"),
        ("2026-02-28T23:59:58.123456789Z", None, "2026-02-28T23:59:58.123456"),
        ("2026-02-28 23:59", "Nowhere/Zone", None),
        ("２０２６-02-28T23:59:58Z", None, None),
        ("", "UTC", None),
        ("x" * 1_000_000, "UTC", None),
    ],
)
def test_readings(text, zone, want):
    us = lambda s: round(datetime.fromisoformat(s + "+00:00").timestamp() * 1e6)
    want = (None, None) if want is None else (us(want), None) if isinstance(want, str) else tuple(map(us, want))
    assert read_clock(text, zone) == want


def test_twice_occurring_time_follows_first_seen():
    assert choose(1, 5, 5) == 5 and choose(1, 5, 4) == 1 and choose(1, 5, None) == 1 and choose(1, 5, 0) == 1 and choose(1, None, 9) == 1


def test_dictionary_is_incremental_and_rows_keep_their_own_reading(spark, tmp_path):
    rows = [("a", "f", "America/New_York", "2025-11-02 01:30:00", None), ("b", "f", "America/New_York", "2025-11-02 01:30:00", 1_762_065_000_000_000), ("c", None, None, "2025-11-02T01:30:00.000000Z", None), ("d", None, None, None, None), ("e", None, None, "2025-13-02T01:30:00.000000Z", None), ("f", None, None, "pending", None), ("g", None, None, "1762065000", None)]
    df = spark.createDataFrame(rows, "k string, feed string, zone string, text string, first_seen_us long")
    d = clocks.ClockDictionary(spark, str(tmp_path / "dict"))
    got = sorted(map(tuple, clocks.normalise(df, d, ["k"]).collect()))
    assert got == [("a", 1_762_061_400_000_000), ("b", 1_762_065_000_000_000), ("c", 1_762_047_000_000_000), ("g", 1_762_065_000_000_000)]
    n = d.table().count()
    assert sorted(map(tuple, clocks.normalise(df, d, ["k"]).collect())) == got and d.table().count() == n
    d.extend(df.filter("k in ('a', 'g')"), 1)
    assert d._entries().filter("batch = 1").count() == 0  # nothing new
    d._entries().filter("text = '1762065000'").drop("batch").write.parquet(f"{d.path}/batch=7")  # as by another writer
    assert d._entries().count() == n + 1 and sorted(map(tuple, clocks.normalise(df, d, ["k"]).collect())) == got
    assert clocks.normalise(df.limit(0), d, ["k"]).collect() == []


def test_instants_with_clashing_columns(spark):
    o = spark.createDataFrame([("x", "2025-11-02 01:30", "f", None, "old", 5), ("y", None, None, None, None, None)], "observation_id string, source_timestamp string, feed string, first_seen_at timestamp, zone string, utc_us long")
    z = spark.createDataFrame([("f", "UTC"), (None, None)], "feed string, zone string")
    assert {r["observation_id"]: r["utc_us"] for r in clocks.observation_instants(o, z).collect()} == {"x": 1_762_047_000_000_000, "y": None}


# --- 4: grid


def test_grid_against_direct_regression(spark):
    rng = random.Random(1)
    rows, h = [], grid.BANDWIDTH
    for ent in ("a", "b"):
        for _ in range(60):
            rows.append((ent, T0 // 60_000_000 * 60_000_000 + rng.randrange(90) * 60_000_000 + rng.choice([0, rng.randrange(60_000_000)]), rng.uniform(9, 11), rng.choice([None, 5]), 0))
    rows += rows[:7]
    late = (*rows[0][:2], 10.5, 9, 4)  # a later revision of the first reading
    df = spark.createDataFrame([*rows, late, ("a", None, 1.0, 1, 0), (None, T0, 1.0, 1, 0), ("a", T0, None, 1, 0), ("c", T0, float("nan"), 1, 0), ("d", T0, float("inf"), 1, 0), ("d", T0 + 240_000_000, 2.0, None, 0), ("d", T0 + 300_000_000, 3.0, 4, 0)], "entity string, us long, y double, volume long, revised_us long")
    best = {}
    for r in sorted([*rows, late], key=lambda r: (r[4], r[2])):
        best[r[0], r[1]] = r
    got = grid.regular_grid(df.withColumn("slot", F.lit(1)).withColumn("day", F.lit(2))).collect()
    assert {r["entity"] for r in got} == {"a", "b", "d"}
    d = sorted((r["slot"], r["missing"], r["last"], r["volume"]) for r in got if r["entity"] == "d")
    assert [x[1:] for x in d] == [(False, float("inf"), 1), *[(True, None, None)] * 3, (False, 2.0, None), (False, 3.0, 4)]
    assert all(r["fit"] is None or 1 < r["fit"] < 4 for r in got if r["entity"] == "d")
    for ent in ("a", "b"):
        pts = [(u, y) for (e, u), (_, _, y, *_) in best.items() if e == ent]
        slots = {u // 60_000_000 for u, _ in pts}
        mine = {r["slot"]: r for r in got if r["entity"] == ent}
        assert set(mine) == set(range(min(slots), max(slots) + 1))
        for s, r in mine.items():
            assert r["missing"] == (s not in slots) and (r["last"] is None) == r["missing"]
            near = [(x, y, 1 - (x / h) ** 2) for x, y in (((u - s * 60_000_000) / 60e6, y) for u, y in pts) if -h <= x < h]
            w = [sum(k * x**i for x, _, k in near) for i in range(3)]
            t = [sum(k * x**i * y for x, y, k in near) for i in range(2)]
            sup = w[0] ** 2 / q if (q := sum(k * k for *_, k in near)) > 1e-12 else 0
            assert abs(r["support"] - sup) < 1e-6
            if sup > grid.MIN_SUPPORT + 1e-6:
                det = w[0] * w[2] - w[1] ** 2
                want = (w[2] * t[0] - w[1] * t[1]) / det if det > grid.MIN_SPREAD * w[0] ** 2 else t[0] / w[0]
                assert abs(r["fit"] - want) < 1e-6
            elif sup < grid.MIN_SUPPORT - 1e-6:
                assert r["fit"] is None
    assert grid.regular_grid(df.limit(0)).collect() == []


# --- 6: lateness

DAY = 86_400_000_000


def doc(i, ticker, day, published_h, known_h):
    base = day * DAY
    return (i, ticker, at(base + published_h * 3_600_000_000), at(base + known_h * 3_600_000_000), None, "x")


def test_periods_are_corrected_batch_by_batch(spark, tmp_path):
    schema = "document_id string, ticker string, published_at timestamp, available_at timestamp, first_seen_at timestamp, period_day string"
    day = 20_400
    one = [doc("a", "T", day, 9, 10), doc("b", "T", day, 9, 24), doc("c", "U", day + 1, 9, 10)]
    two = [doc("d", "T", day, 9, 25), doc("a", "T", day, 9, 30), doc("e", "T", day, 9, 72), (None, "T", at(day * DAY), at(day * DAY), None, ""), ("n", "T", None, at(day * DAY), None, ""), ("m", "T", at(day * DAY), None, None, "")]
    three = [doc("f", "T", day, 9, 73)]
    store = lateness.PeriodStore(spark, str(tmp_path / "p"))
    assert store.counts().collect() == []
    seen = []
    for k, rows in enumerate((one, two, three, three, []), 1):
        store.apply(lateness.arrivals(spark.createDataFrame(rows, schema)), min(k, 3) if k < 5 else 5)
        seen.append(sorted((r["ticker"], r["docs_at_close"], r["docs_final"], r["docs_dropped"]) for r in store.counts().collect()))
    assert seen == [[("T", 2, 2, 0), ("U", 1, 1, 0)], [("T", 2, 4, 0), ("U", 1, 1, 0)], [("T", 2, 4, 1), ("U", 1, 1, 0)], [("T", 2, 4, 1), ("U", 1, 1, 0)], [("T", 2, 4, 1), ("U", 1, 1, 0)]]
    found = lateness.corrected_periods(store.counts()).collect()
    assert [(r["ticker"], r["docs_final"], r["period_day"]) for r in found] == [("T", 4, "2025-11-08")]


@pytest.mark.parametrize("parts, seed", [(1, 0), (2, 1), (2, 2), (7, 3), (7, 4)])
def test_counts_are_the_same_in_whatever_batches_and_order(spark, tmp_path, parts, seed):
    rng = random.Random(seed)
    schema = "document_id string, ticker string, published_at timestamp, available_at timestamp, first_seen_at timestamp, period_day string"
    rows = []
    for i in range(60):
        day = 20_400 + rng.randrange(4)
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append(doc(f"d{i}", rng.choice("TU"), day if rng.random() < 0.8 else 20_400 + rng.randrange(4), rng.randrange(24), rng.randrange(10, 120)))
    whole = sorted(map(tuple, lateness.period_counts(lateness.arrivals(spark.createDataFrame(rows, schema))).collect()))
    rng.shuffle(rows)
    store = lateness.PeriodStore(spark, str(tmp_path / "p"))
    for k in range(parts):
        store.apply(lateness.arrivals(spark.createDataFrame(rows[k::parts], schema)), k)
    assert sorted(map(tuple, store.counts().collect())) == whole
    store.compact()
    assert sorted(map(tuple, store.counts().collect())) == whole


def test_replay_replaces_and_late_rows_leave_final_files_alone(spark, tmp_path):
    schema = "document_id string, ticker string, published_at timestamp, available_at timestamp, first_seen_at timestamp, period_day string"
    store = lateness.PeriodStore(spark, str(tmp_path / "p"))
    put = lambda k, *rows: store.apply(lateness.arrivals(spark.createDataFrame(rows, schema)), k)
    got = lambda: sorted((r["ticker"], str(r["period_day"]), r["docs_at_close"], r["docs_final"], r["docs_dropped"]) for r in store.counts().collect())
    put(1, doc("x", "T", 20_400, 9, 10), doc("y", "T", 20_401, 9, 10))
    put(2, doc("z", "U", 20_400, 9, 10))
    put(1, doc("x", "T", 20_400, 9, 10))  # y is gone
    assert got() == [("T", "2025-11-08", 1, 1, 0), ("U", "2025-11-08", 1, 1, 0)]
    before = {k: v for k, v in store._manifest()[1].items() if k[0] == "final"}
    put(3, doc("w", "T", 20_400, 9, 24 * 365), doc("x", "T", 20_400, 9, 24 * 365))  # a year late: one new, one known before
    assert got() == [("T", "2025-11-08", 1, 1, 1), ("U", "2025-11-08", 1, 1, 0)]
    assert {k: v for k, v in store._manifest()[1].items() if k[0] == "final"} == before


# --- 7: known at


@pytest.mark.parametrize("seed, bits", [(0, 44), (1, 8), (2, 9), (3, 5)])
def test_known_attributes_over_partition_edges(many_parts, monkeypatch, seed, bits):
    monkeypatch.setattr(knownat, "SHARD_BITS", bits)
    rng = random.Random(seed)
    ent = lambda: rng.choice(["hot"] * 5 + ["a", "b"])
    versions = []
    for i in range(60):
        f = T0 + rng.randrange(2000)
        versions.append((ent(), i, at(f), at(f + rng.choice([-5, 0, 50, 400])) if rng.random() < 0.5 else None, at(f + rng.randrange(-300, 300)) if rng.random() < 0.9 else None, rng.choice([None, 1, 2])))
    halts = [(ent() if rng.random() > 0.05 else None, f"h{rng.randrange(25)}", at(T0 + rng.randrange(2000)), at(T0 + rng.randrange(2000)), at(T0 + rng.randrange(2500)) if rng.random() < 0.7 else None) for _ in range(60)]
    halts = list({(h[1], h[2]): h for h in halts}.values())
    events = [(ent() if rng.random() > 0.02 else None, T0 + rng.randrange(2200) if rng.random() > 0.02 else None, f"e{i}", rng.choice([None, 1, 2]), rng.choice([None, "halted", "not_halted", "odd"]), "z") for i in range(700)]
    v = many_parts.createDataFrame(versions, "security_id string, version_id long, effective_from timestamp, effective_to timestamp, free_float_available_at timestamp, free_float long")
    h = many_parts.createDataFrame(halts, "security_id string, halt_id string, first_seen_at timestamp, halt_at timestamp, resumption_trade_at timestamp")
    o = many_parts.createDataFrame(events + events[:9], "security_id string, utc_us long, observation_id string, free_float long, halt_status string, version_id string")
    want = set()
    for s, t, i, num, status, _ in events:
        if s is None or t is None:
            continue
        t = at(t)
        ok = [x for x in versions if x[0] == s and x[2] <= t and (x[3] is None or t < x[3]) and x[4] is not None and x[4] <= t]
        if not ok:
            continue
        best = max(ok, key=lambda x: (x[2], x[4], x[1]))
        last = {}
        for x in sorted((x for x in halts if x[0] == s and x[2] <= t), key=lambda x: x[2]):
            last[x[1]] = x
        halted = any(x[3] <= t and (x[4] is None or x[4] > t) for x in last.values())
        if best[5] != num or status != ("halted" if halted else "not_halted"):
            want.add((i, best[1], "halted" if halted else "not_halted"))
    got = knownat.stale_attributes(o, v, h).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert knownat.stale_attributes(o.limit(0), v, h).collect() == [] == knownat.stale_attributes(o, v.limit(0), h).collect()
    assert knownat.stale_attributes(o, v, h.limit(0)).count() > 0
