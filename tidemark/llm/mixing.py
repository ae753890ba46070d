"""Mixing sources to target shares of all tokens, exactly to the token where the documents' lengths allow it.

Per source the documents are counted by exact token length. A budget within what the repeats allow is met by whole
passes over the source and, for the rest, by a subset whose lengths sum to it: a proportional draw over all lengths
fixes most of it, a bounded knapsack over the remaining counts closes it, with a wider window where a narrow one can't.
Only these counts (one per source and distinct length) come to the driver. Which documents of a length are taken is
decided by a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe import TOKENIZER_DIR, token_count
from tidemark.session import stored

SEED = 20_240_607
#: Tokens that the knapsack closes at first, and at most (five bytes of the driver's memory each).
WINDOW, WIDEST = 1 << 17, 1 << 25
#: Documents of one source and length are ranked in hash ranges of about this many.
RANK_ROWS = 50_000


@dataclass
class Plan:
    """passes: times every document is used; take: documents by length that are used once more."""

    source: str
    budget: int
    passes: int
    take: dict[int, int]
    tokens: int


def subset(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Counts by length, at most those given, whose lengths sum to budget or as closely below it as they can.

    A draw in proportion, rounded down, leaves a rest that the knapsack closes. Where it can't reach the rest exactly,
    documents are given back and a window four times as wide is tried, up to the whole budget: then the sum found is the
    largest there is. (A budget of more than WIDEST tokens, in units of the lengths' common divisor, that no window
    reaches keeps the best sum found.)
    """
    total = sum(n * k for n, k in counts.items())
    if budget >= total:
        return dict(counts)
    unit = gcd(*counts) or 1
    # wide enough for some documents of the length that holds most tokens
    typical = sum(n * n * k for n, k in counts.items()) // (total * unit)
    window, best = min(max(WINDOW, 64 * typical), WIDEST), None
    while True:
        take, rest = _draw(counts, budget, total, min(budget, window * unit))
        found = knapsack([(n // unit, counts[n] - take[n]) for n in counts], rest // unit)
        left = rest - unit * sum(n * k for n, k in found.items())
        if best is None or left < best[0]:
            best = left, {n: k + found.get(n // unit, 0) for n, k in take.items()}
        if left < unit or window * unit >= budget or window >= WIDEST:
            return best[1]
        window = min(4 * window, WIDEST)


def _scattered(n: int) -> tuple[int, int]:
    """An order of lengths in which neighbours differ much."""
    return n * 2_654_435_761 % (1 << 32), n


def _draw(counts: dict[int, int], budget: int, total: int, window: int) -> tuple[dict[int, int], int]:
    """A draw in proportion that leaves at least window tokens of the budget open, and not many more."""
    take = {n: k * budget // total for n, k in counts.items()}
    rest = budget - sum(n * k for n, k in take.items())
    order = sorted(counts, key=_scattered)
    for most in (2, budget):  # a few documents of each length first
        for n in order:
            if rest >= window:
                break
            back = min(take[n], most, -(-(window - rest) // n))
            take[n] -= back
            rest += back * n
    for n in order:
        k = min(counts[n] - take[n], (rest - window) // n)
        if k > 0:
            take[n] += k
            rest -= k * n
    return take, rest


def sum_of(take: dict[int, int]) -> int:
    return sum(n * k for n, k in take.items())


def knapsack(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Bounded knapsack on lengths: counts whose sum is the largest up to budget. Each reachable sum remembers the part
    that reached it first; all parts before that one reach what is left without it."""
    reach, by = np.zeros(budget + 1, bool), np.zeros(budget + 1, np.int32)
    reach[0] = True
    parts: list[tuple[int, int]] = []
    # few lengths in scattered order already reach all sums near the budget, and the walk over them ends there
    for n, most in sorted(items, key=lambda x: _scattered(x[0])):
        most, part = min(most, budget // n), 1
        while most > 0 and not reach[budget]:  # binary parts of the count
            k = min(part, most)
            new = reach[: budget + 1 - n * k] & ~reach[n * k :]
            by[n * k :][new] = len(parts)
            reach[n * k :][new] = True
            parts.append((n, k))
            most -= k
            part *= 2
    at = int(np.flatnonzero(reach)[-1])
    out: dict[int, int] = {}
    while at:
        n, k = parts[by[at]]
        out[n] = out.get(n, 0) + k
        at -= n * k
    return out


def plan(counts: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[Plan]:
    """Budgets and draws of all sources.

    total: tokens of the mix. By default it is the largest at which no source needs more than its repeats allow, so that
    all shares are met; given, a source that is too small gives all its repeats allow and misses its share, and the others
    keep theirs of the total. A source with a target but no tokens leaves its share empty and doesn't bind the rest.
    """
    tokens = {s: sum_of(counts.get(s, {})) for s in targets}
    live = {s: (share, most) for s, (share, most) in targets.items() if tokens[s] and share > 0 and most > 0}
    if not live:
        return [Plan(s, 0, 0, {}, tokens[s]) for s in sorted(targets)]
    scale = sum(share for share, _ in live.values())
    if total is None:
        total = min(most * tokens[s] * scale / share for s, (share, most) in live.items())
    out = []
    for s in sorted(targets):
        if s not in live:
            out.append(Plan(s, 0, 0, {}, tokens[s]))
            continue
        share, most = live[s]
        budget = min(int(total * share / scale + 1e-6), most * tokens[s])
        passes, rest = divmod(budget, tokens[s])
        out.append(Plan(s, budget, passes, subset(counts[s], rest) if rest else {}, tokens[s]))
    return out


def token_lengths(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens) of documents with a source and at least one token; a written table, as it is read often.
    Each text is encoded once: the filter on its length is on the table."""
    sized = documents.filter("source is not null and doc_id is not null").select("doc_id", "source", token_count("text", tokenizer_dir).alias("tokens"))
    return stored(sized, "lengths").filter("tokens > 0")


def _plans(lengths: DataFrame, targets: DataFrame, total: int | None) -> list[Plan]:
    # one row per source and distinct length: with N tokens a source has at most sqrt(2 N) lengths
    rows = lengths.groupBy("source", "tokens").count().collect()
    counts: dict[str, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["source"], {})[r["tokens"]] = r["count"]
    goal = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.dropna(subset=["source"]).collect()}
    return plan(counts, goal, total)


def mix(documents: DataFrame, targets: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, seed: int = SEED, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, times) of every document used. total_tokens: see plan.

    Sources without a target, null sources, and documents without tokens aren't used; times is at most the source's
    max_repeats. The same seed and documents give the same choice, however they are partitioned.
    """
    lengths = token_lengths(documents, tokenizer_dir)
    return _choose(lengths, _plans(lengths, targets, total_tokens), seed)


def _choose(lengths: DataFrame, plans: list[Plan], seed: int) -> DataFrame:
    spark = lengths.sparkSession
    passes = spark.createDataFrame([(p.source, p.passes) for p in plans], "source string, passes int")
    quota = spark.createDataFrame([(p.source, n, k) for p in plans for n, k in p.take.items() if k], "source string, tokens long, take long")
    there = lengths.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    quota = quota.join(there, ["source", "tokens"]).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / RANK_ROWS)).cast("long"))
    # order by a seeded hash; a length that very many documents have is ranked in parallel hash ranges
    keyed = lengths.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    quota = F.broadcast(quota) if sum(len(p.take) for p in plans) <= 100_000 else quota
    asked = keyed.join(quota, ["source", "tokens"]).withColumn("part", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("parts")).cast("long"))
    sizes = asked.filter("parts > 1").groupBy("source", "tokens", "part").agg(F.count("*").alias("size"))
    w = Window.partitionBy("source", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("source", "tokens", "part", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before"))
    asked = asked.join(before, ["source", "tokens", "part"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "part").orderBy("h", "doc_id"))
    once = asked.filter("before < take").withColumn("rank", rank + F.col("before")).filter("rank <= take").select("doc_id", "source", "tokens", F.lit(1).alias("times"))
    every = lengths.join(F.broadcast(passes.filter("passes > 0")), "source").select("doc_id", "source", "tokens", F.col("passes").alias("times"))
    both = every.unionByName(once).groupBy("doc_id", "source", "tokens")
    return both.agg(F.sum("times").cast("int").alias("times"))


def shares(documents: DataFrame, targets: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, seed: int = SEED, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, budget_tokens, used_tokens, actual_share, documents, uses, most_repeats) per target."""
    lengths = token_lengths(documents, tokenizer_dir)
    plans = _plans(lengths, targets, total_tokens)
    used = (
        _choose(lengths, plans, seed)
        .groupBy("source")
        .agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.count("*").alias("documents"), F.sum("times").alias("uses"), F.max("times").alias("most_repeats"))
    )
    budgets = documents.sparkSession.createDataFrame([(p.source, p.budget) for p in plans], "source string, budget_tokens long")
    out = targets.dropna(subset=["source"]).select("source", "target_share").join(budgets, "source").join(used, "source", "left").fillna(0, ["used_tokens", "documents", "uses", "most_repeats"])
    total = F.nullif(F.sum("used_tokens").over(Window.partitionBy()), F.lit(0))  # one row per source
    return out.withColumn("actual_share", F.col("used_tokens") / total)
