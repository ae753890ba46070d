"""Draws from digests against hashlib, and that a bootstrap's draws aren't rows of the plan."""

import random
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest

from tidemark.functions import digests
from tidemark.operators import metrics

REPS, SEED = 12, 7


@pytest.mark.parametrize("together", [1 << 22, 300])
def test_digests_equal_hashlib(monkeypatch, together):
    monkeypatch.setattr(digests, "BYTES", together)
    rng = random.Random(3)
    texts = ["", "a", "\0", "a\0", "é€", *("x" * n for n in (46, 47, 48, 51, 55, 56, 63, 64, 119, 120, 500)), *(str(rng.randrange(10**9)) for _ in range(50))]
    prefixes = ["", "7|0", "7|10", "-12345678901|3", "w" * 70]
    for keys in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array([""]), pa.array([], pa.string())):
        got = {(r, i): int(b) for r, at, bits in digests.leading_bits(keys, prefixes) for i, b in zip(at.tolist(), bits)}
        assert got == {(r, i): int(md5((p + t).encode()).hexdigest()[:13], 16) for r, p in enumerate(prefixes) for i, t in enumerate(keys.to_pylist())}


def plain(rows):
    """Sums per repetition, drawn one by one as the SQL does it."""
    out = {}
    for rep in range(REPS):
        for c, n, e in rows:
            u = (int(md5("|".join([str(SEED), str(rep), *([] if c is None else [c])]).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            if times := sum(u > x for x in metrics.POISSON):
                a, b = out.get(rep, (0, 0))
                out[rep] = a + times * (n or 0), b + times * (e or 0)
    return out


def test_thresholds_are_the_uniform_numbers():
    for x, least in zip(metrics.POISSON, metrics.TIMES_FROM):
        assert (least + 0.5) / (1 << 52) > x >= (least - 0.5) / (1 << 52)
        assert (metrics._times(np.array([least - 1, least], np.uint64)) == [sum((b + 0.5) / (1 << 52) > y for y in metrics.POISSON) for b in (least - 1, least)]).all()


def test_draws_equal_plain_draws(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(str(i), rng.randrange(9), rng.random()) for i in range(300)] + [(None, 1, 0.5), ("", 2, None), ("long" * 40, 3, 0.25), ("odd", 1, float("inf"))]
    df = spark.createDataFrame(rows, "c string, n int, e double")
    got = {r["rep"]: (r["n"], r["e"]) for r in metrics.poisson_sums(df.repartition(5), "c", REPS, SEED).collect()}
    want = plain(rows)
    assert got.keys() == want.keys() and all(got[r] == pytest.approx(want[r], rel=1e-12) for r in want)
    assert {v[1] == float("inf") for v in want.values()} == {True, False}
    one = rows[:1]  # some repetitions draw nothing and have no row
    got = {r["rep"]: r["n"] for r in metrics.poisson_sums(df.filter("c = '0'"), "c", REPS, SEED).collect()}
    assert got == {r: n for r, (n, _) in plain(one).items()} and 0 < len(got) < REPS


def test_draws_are_no_rows(spark):
    """A hundred rows a cluster, each hashed by expressions that a filter repeats, took 20 us a draw."""
    df = spark.createDataFrame([(i, 0.5, 1.0) for i in range(40)], "c int, p double, y double")
    plan = metrics.cluster_bootstrap(df, "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "sequence(" not in plan
    none = metrics.cluster_bootstrap(df.filter("c < 0"), "c").collect()
    assert sorted(tuple(r) for r in none) == [("base_rate", None, None), ("brier", None, None)]
