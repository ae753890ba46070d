import random
import time
from itertools import product

from tidemark.llm import mixing
from tidemark.llm.queries import QUERIES
from tidemark.plans.tables import table


def test_knapsack_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        items = [(rng.randint(1, 30), rng.randint(0, 3)) for _ in range(4)]
        items = list({n: (n, k) for n, k in items}.values())
        budget = rng.randint(0, 120)
        best = max(s for c in product(*(range(k + 1) for _, k in items)) if (s := sum(n * x for (n, _), x in zip(items, c))) <= budget)
        got = mixing.knapsack(items, budget)
        assert mixing.sum_of(got) == best
        assert all(got.get(n, 0) <= k for n, k in items)


def test_subset_is_exact_on_long_tails():
    rng = random.Random(4)
    counts = {}
    for _ in range(20_000):
        n = int(rng.lognormvariate(5, 1.2)) + 1
        counts[n] = counts.get(n, 0) + 1
    counts[400_000] = 2
    total = mixing.sum_of(counts)
    for share in (0.001, 0.31, 0.5, 0.97, 1.0):
        take = mixing.subset(counts, int(total * share))
        assert mixing.sum_of(take) == int(total * share)
        assert all(0 <= take[n] <= counts[n] for n in take)


def test_subset_of_few_long_documents_against_brute_force():
    assert mixing.sum_of(mixing.subset({300_000: 1, 200_000: 1, 400_000: 1}, 500_000)) == 500_000
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.choice([rng.randrange(1, 30), rng.randrange(100_000, 400_000)]): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        budget = rng.randrange(mixing.sum_of(counts) + 2)
        best = max(s for c in product(*(range(k + 1) for k in counts.values())) if (s := sum(n * x for n, x in zip(counts, c))) <= budget)
        take = mixing.subset(counts, budget)
        assert mixing.sum_of(take) == best and all(take[n] <= counts[n] for n in take)


def test_many_long_lengths_are_planned_quickly():
    counts = {131_072 + i: 2 for i in range(8_000)}
    began = time.process_time()
    assert mixing.sum_of(mixing.subset(counts, mixing.sum_of(counts) // 3)) == mixing.sum_of(counts) // 3
    assert time.process_time() - began < 10


def test_a_given_total_lets_a_scarce_source_miss_its_share():
    counts = {"a": {10: 100}, "b": {10: 2}}
    targets = {"a": (0.5, 1), "b": (0.5, 1)}
    assert [p.budget for p in mixing.plan(counts, targets)] == [20, 20]
    assert [p.budget for p in mixing.plan(counts, targets, 600)] == [300, 20]


def test_whole_tables(spark, data):
    targets = {r["source"]: r for r in table(spark, data, "mix_targets").collect()}
    rows = QUERIES["p9_mix"](spark, data).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert all(1 <= r["times"] <= targets[r["source"]]["max_repeats"] for r in rows)
    used = {}
    for r in rows:
        used[r["source"]] = used.get(r["source"], 0) + r["times"] * r["tokens"]
    out = {r["source"]: r for r in QUERIES["p9_shares"](spark, data).collect()}
    assert out.keys() == targets.keys()
    live = sum(targets[s]["target_share"] for s in used)
    for s, r in out.items():
        assert r["used_tokens"] == used.get(s, 0) <= r["budget_tokens"]
        if s in used:
            assert abs(r["actual_share"] - targets[s]["target_share"] / live) < 0.02
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["p9_mix"](spark, data).collect()))


def test_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 50)
    rows = spark.range(2_000).selectExpr("id as doc_id", "'a' as source", "cast(7 as long) as tokens")
    p = mixing.plan({"a": {7: 2_000}}, {"a": (1.0, 1)})
    p[0].take = {7: 1_234}
    p[0].passes = 0
    got = mixing._choose(rows, p, 1).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == 1_234


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "one two", "b"), (5, "x y z", "a")], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("c", None, None), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    assert {r["doc_id"] for r in mixing.mix(docs, goals).collect()} <= {4, 5}
    assert {r["source"] for r in mixing.shares(docs, goals).collect()} == {"a", "b", "c"}
    assert mixing.mix(docs.limit(0), goals).collect() == []
    assert [r["used_tokens"] for r in mixing.shares(docs.limit(0), goals).collect()] == [0, 0, 0]
