"""The modelling run on a small table: order in time, selection, reproduction, findings."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, modelling, research
from tidemark.operators.modelling import walk_forward_folds

DAY = 86_400_000_000
PLAN = research.Plan(200 * DAY, (210 * DAY, 240 * DAY), (250 * DAY, 400 * DAY), 60, 20, 40)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for i in range(300):
        x = rng.choice([0.0, 1.0, 2.0, 3.0])
        y = float(rng.random() < 0.15 + 0.2 * x)
        out.append((f"r{i:03}", i * DAY, i * DAY + DAY, i * DAY - 1, x, rng.choice([1.0, 2.0, None]), y, max(0.0, x + rng.choice([-1, 0, 1])), 1.0, 0.4, 0.6, f"s{i % 7}"))
    schema = "id string, as_of_us long, outcome_us long, features_available_us long, a double, b double, y double, mfe double, gross double, cost double, net double, security string"
    return spark.createDataFrame(out, schema).filter(f"as_of_us <= {199 * DAY} or as_of_us >= {210 * DAY}").filter(f"as_of_us < {240 * DAY} or as_of_us >= {250 * DAY}")


@pytest.fixture(scope="module")
def ran(rows):
    report, predictions, effects = research.run(rows, ["a", "b"], [research.Target("y"), research.Target("mfe", "regression")], PLAN)
    return {(r["target"], r["model"]): r for r in report.collect()}, report, predictions, effects


def test_selection_and_reproduction(rows, ran):
    by, report, predictions, effects = ran
    assert set(by) == {("y", m) for m in research.BINARY} | {("mfe", m) for m in research.REGRESSION}
    assert sum(r["selected"] for r in by.values()) == 2
    for t, families, gap in (("y", research.BINARY, 0.005), ("mfe", research.REGRESSION, 0.05)):  # the first near the best
        best = min(by[t, m]["cv"] for m in families)
        assert by[t, next(m for m in families if by[t, m]["cv"] <= best + gap)]["selected"]
    assert by["y", "logistic"]["cv"] < by["y", "historical_frequency"]["cv"]
    assert predictions.filter("target = 'mfe' and p < 0").count() == 0 and predictions.select("id").distinct().count() == 50
    again = research.reproduce(report, predictions, rows, {"y": "r.y", "mfe": "r.mfe"})
    assert again.filter("matches").count() == 6
    broken = research.reproduce(report, predictions.withColumn("p", F.when(F.col("model") == "ridge", F.col("p") + 1).otherwise(F.col("p"))), rows, {"y": "r.y", "mfe": "r.mfe"})
    assert [r["model"] for r in broken.filter("not matches").collect()] == ["ridge"]
    assert {r["feature"] for r in effects.filter("model = 'logistic'").collect()} == {"z_a", "m_a", "z_b", "m_b"}


def test_outcomes_over_a_border_stop_the_run(rows):
    late = rows.withColumn("outcome_us", F.when(F.col("id") == "r199", F.lit(211 * DAY)).otherwise(F.col("outcome_us")))
    with pytest.raises(research.EmbargoError):
        research.run(late, ["a"], [research.Target("y")], PLAN)


def test_reversal(ran):
    p = ran[2].filter("target = 'y' and model = 'logistic'")
    back = research.reversal(p).agg(F.sum("p"), F.sum("y")).first()
    there = p.agg(F.count("*") - F.sum("p"), F.count("*") - F.sum("y")).first()
    assert abs(back[0] - there[0]) < 1e-9 and back[1] == there[1]


def test_findings_and_markdown(rows, ran):
    _, report, predictions, _ = ran
    again = research.reproduce(report, predictions, rows, {"y": "r.y", "mfe": "r.mfe"})
    best = metrics.top_rows(predictions.filter("target = 'y' and model = 'logistic'").select("id", "p").join(rows, "id"), [], 10)
    found = research.findings(rows, report, predictions, again, best, survivorship_safe=False)
    assert [r["check_id"] for r in research.blockers(found).collect()] == ["SURVIVORSHIP"]
    text = research.markdown(found)
    assert text.count("\n") == 11 and "| SURVIVORSHIP | FAIL | BLOCKER |" in text and text.index("SURVIVORSHIP") < text.index("FEATURE_LEAKAGE")
    leaky = rows.withColumn("features_available_us", F.when(F.col("id") == "r003", F.col("as_of_us") + 1).otherwise(F.col("features_available_us")))
    assert {r["probe"]: r["n"] for r in research.leakage_probes(leaky).collect()} == {"feature": 1, "outcome": 0}


def test_folds_against_plain_counting(spark):
    rng = random.Random(4)
    data = [(i, t := rng.randrange(40) * DAY, t + rng.randrange(1, 9) * DAY) for i in range(140)]
    df = spark.createDataFrame(data, "id long, as_of_us long, outcome_us long")
    ordered = sorted(data, key=lambda r: (r[1], r[0]))
    want = [(k, p, ordered[p][1], sum(r[2] < ordered[p][1] for r in ordered[:p]), 10) for k, p in enumerate(range(30, 131, 10))]
    assert sorted(map(tuple, walk_forward_folds(df, 30, 10, 10, ["as_of_us", "id"]).collect())) == want


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_statistics_by_either_way(spark, monkeypatch, limit):
    monkeypatch.setattr(modelling, "MEDIAN_ROWS", limit)
    rng = random.Random(8)
    cols = {"a": [float(rng.randrange(9)) for _ in range(101)], "b": [rng.choice([None, rng.random()]) for _ in range(101)], "c": [2.0] * 101, "d": [None] * 101}
    rows = list(zip(*cols.values()))
    got = {r["feature"]: r for r in modelling.feature_statistics(spark.createDataFrame(rows, "a double, b double, c double, d double"), list(cols)).collect()}
    for f in "abc":
        known = [x for x in cols[f] if x is not None]
        mid = median(known)
        full = known + [mid] * (101 - len(known))
        mean = sum(full) / 101
        dev = math.sqrt(sum((x - mean) ** 2 for x in full) / 101)
        assert (got[f]["n"], got[f]["missing"]) == (101, 101 - len(known)) and abs(got[f]["median"] - mid) < 1e-12
        assert abs(got[f]["mean"] - mean) < 1e-9 and abs(got[f]["deviation"] - (dev if dev > 1e-6 else 1.0)) < 1e-9
    assert got["d"]["median"] is None
