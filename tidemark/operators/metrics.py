"""Evaluation of predictions: losses, calibration, top-k, breakdowns, bootstrap, stress and concentration."""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import exp, factorial, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.digests import leading_bits

#: Distribution function of Poisson(1) at 0, 1, ...; beyond the last it is 1 to 1e-9.
POISSON = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(11)]
#: The least 52 bits b whose uniform number, (b + 0.5) / 2^52, is over each of these.
TIMES_FROM = [floor(Fraction(x) * (1 << 52) - Fraction(1, 2)) + 1 for x in POISSON]
#: Clusters that are hashed together, so that NumPy's calls cost little beside what they do.
TOGETHER = 30_000
#: Ranks among which top-k metrics are taken.
TOP_K = (1, 3, 5, 10)


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def losses(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, brier, log_loss, base_rate) of probabilities p and labels y; rows with a null in either don't count."""
    s = scored.filter("p is not null and y is not null")
    return s.groupBy(*by).agg(F.count("*").alias("n"), brier(F.col("p"), F.col("y")).alias("brier"), log_loss(F.col("p"), F.col("y")).alias("log_loss"), F.avg("y").alias("base_rate"))


def regression_losses(scored: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("p") - F.col("y")
    return scored.filter("p is not null and y is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, high, n, mean_p, observed): equal-width bins, the last closed, empty ones kept."""
    spark = scored.sparkSession
    edges = spark.createDataFrame([(i, i / bins, (i + 1) / bins) for i in range(bins)], "bin int, low double, high double")
    at = F.lit(0)
    for i in range(1, bins):
        at = at + F.when(F.col("p") >= i / bins, 1).otherwise(0)
    s = scored.filter("p is not null and y is not null").groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))
    return edges.join(F.broadcast(s), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.nullif(F.sum("n"), F.lit(0))).alias("calibration_error"))


def top_rows(scored: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of each group with the greatest p, then the earliest as_of_us, then the smallest id, with their rank.

    The limit on the rank is applied in the map tasks too (WindowGroupLimit), so a large group sends k rows a task.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("p"), "as_of_us", "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k_metrics(scored: DataFrame, by: list[str], ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """(by..., k, n, precision, expectancy, fill_rate) of the k best of each group; an unfilled row counts as 0."""
    best = top_rows(scored, by, max(ks))
    many = best.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    return many.groupBy(*by, "k").agg(F.count("*").alias("n"), F.avg("y").alias("precision"), F.avg(F.coalesce("net", F.lit(0.0))).alias("expectancy"), F.avg(F.col("net").isNotNull().cast("int")).alias("fill_rate"))


def breakdowns(scored: DataFrame, dimensions: list[str], small: int = 10) -> DataFrame:
    """(dimension, category, n, brier, expectancy, small_sample) for every value of every dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category")) for d in dimensions]))
    s = scored.select(pairs.alias("x"), "p", "y", "net").select("x.*", "p", "y", "net")
    out = s.groupBy("dimension", "category").agg(F.count("*").alias("n"), brier(F.col("p"), F.col("y")).alias("brier"), F.avg(F.coalesce("net", F.lit(0.0))).alias("expectancy"))
    return out.withColumn("small_sample", F.col("n") < small)


def cost_stress(best: DataFrame, factors: tuple[float, ...] = (1.0, 1.5, 2.0)) -> DataFrame:
    """(factor, expectancy): mean of gross less the factor times the costs over rows; unfilled rows count as 0."""
    f = F.explode(F.array(*[F.lit(x) for x in factors]))
    s = best.withColumn("factor", f)
    return s.groupBy("factor").agg(F.avg(F.coalesce(F.col("gross") - F.col("factor") * F.col("cost"), F.lit(0.0))).alias("expectancy"))


def concentration(scored: DataFrame, key: str) -> DataFrame:
    """(key, n, share, left_out_brier): share of each key and the Brier score without it, from sums per key."""
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    per = scored.groupBy(key).agg(F.count("*").alias("n"), F.sum(e).alias("_s"))
    total = per.agg(F.sum("n").alias("_all_n"), F.sum("_s").alias("_all_s"))
    x = per.crossJoin(F.broadcast(total))  # one row
    return x.select(key, "n", (F.col("n") / F.col("_all_n")).alias("share"), F.try_divide(F.col("_all_s") - F.col("_s"), F.col("_all_n") - F.col("n")).alias("left_out_brier"))


def monotonicity_violations(wide: DataFrame, chains: list[list[str]]) -> DataFrame:
    """(chain, violations): rows whose probabilities rise along a chain that ought to fall (a harder target is rarer)."""
    rises = lambda c: reduce(lambda x, y: x | y, [F.coalesce(F.col(b) > F.col(a), F.lit(False)) for a, b in zip(c, c[1:])])
    counts = [F.count_if(rises(c)).alias(">=".join(c)) for c in chains]
    one = wide.agg(*counts)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(">=".join(c)) for c in chains]), F.array(*[F.col(f"`{'>='.join(c)}`") for c in chains]))).alias("chain", "violations"))


def bootstrap_draws(spark, clusters: DataFrame, cluster: str, repetitions: int, seed: int) -> DataFrame:
    """(rep, cluster, times): clusters drawn with replacement, as many as there are, with Python's own generator.

    For cluster lists of up to a million; the draw is sequential by its definition. poisson_sums is for more.
    """
    ids = [r[0] for r in clusters.select(cluster).distinct().orderBy(cluster).limit(1_000_001).collect()]
    if len(ids) > 1_000_000:
        raise ValueError("too many clusters for a sequential draw; use poisson_sums")
    rng = random.Random(seed)
    rows = []
    for rep in range(repetitions):
        count: dict = {}
        for _ in ids:
            c = rng.choice(ids)
            count[c] = count.get(c, 0) + 1
        rows += [(rep, c, n) for c, n in count.items()]
    kind = clusters.schema[cluster].dataType.simpleString()
    return spark.createDataFrame(rows, f"rep int, {cluster} {kind}, times int")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= TOGETHER:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _times(bits: np.ndarray) -> np.ndarray:
    """Poisson(1) counts of 52 bits each."""
    times = np.zeros(len(bits), np.uint8)
    for least in TIMES_FROM:
        more = bits >= np.uint64(least)
        if not more.any():
            break
        times += more
    return times


def _drawn(names: list[str], repetitions: int, seed: int):
    """Sums per repetition over a task's (_key, names...); a row for each repetition that draws any of its clusters."""
    prefixes = [f"{seed}|{rep}" for rep in range(repetitions)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, drawn = np.zeros((repetitions, len(names))), np.zeros(repetitions, bool)
        for t in _together(batches):
            values = np.column_stack([t.column(c).to_numpy() for c in names])
            finite = np.isfinite(values).all()
            keys = pa.concat_arrays(t.column("_key").cast(pa.string()).chunks)
            for rep, at, bits in leading_bits(keys, prefixes):
                times, of = _times(bits), values if len(at) == len(values) else values[at]
                if not finite:  # what isn't drawn doesn't count, but zero times infinity would
                    times, of = times[times > 0], of[times > 0]
                total[rep] += times.astype(float) @ of
                drawn[rep] |= times.any()
        reps = np.flatnonzero(drawn)
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int32()), *[pa.array(v) for v in total[reps].T]], ["rep", *names])

    return run


def poisson_sums(sums: DataFrame, cluster: str, repetitions: int, seed: int) -> DataFrame:
    """(rep, values...): the other columns of sums, which has a row a cluster, each added as often as its cluster is drawn:
    a seeded Poisson(1) count per cluster and repetition, a bootstrap without a sequential draw. The uniform number is that
    of 52 bits of the MD5 digest of 'seed|rep|cluster', so other engines can draw the same. Nulls add nothing; a repetition
    that draws no cluster has no row.

    Each task hashes its clusters in arrays and gives a row a repetition, so that a draw is neither a row nor an expression.
    """
    values = [c for c in sums.columns if c != cluster]
    key = F.coalesce(F.concat(F.lit("|"), F.col(cluster).cast("string")), F.lit("")).alias("_key")  # concat_ws skips nulls
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values]
    parts = sums.select(key, *numbers).mapInArrow(_drawn(values, repetitions, seed), ", ".join(["rep int", *[f"{c} double" for c in values]]))
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in values])


def cluster_bootstrap(scored: DataFrame, cluster: str, repetitions: int = 100, seed: int = 7) -> DataFrame:
    """(metric, low, high): 95 % intervals of Brier score and base rate over resampled clusters.

    Sums per cluster are resampled, not rows, so the repetitions cost clusters, however many rows those have.
    """
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    sums = scored.filter("p is not null and y is not null").groupBy(F.col(cluster).alias("_cluster")).agg(F.count("*").alias("n"), F.sum(e).alias("e"), F.sum("y").alias("y"))
    per = poisson_sums(sums, "_cluster", repetitions, seed).select((F.col("e") / F.col("n")).alias("brier"), (F.col("y") / F.col("n")).alias("base_rate"))
    q = per.agg(*[F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in ("brier", "base_rate")])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("low"), F.col(m)[1].alias("high")) for m in ("brier", "base_rate")]))
    return q.select(rows.alias("r")).select("r.*")


def effect_stability(effects: DataFrame) -> DataFrame:
    """(model, feature, mean, deviation, presence, flips, unstable) of feature effects over folds; a missing one is 0."""
    folds = effects.select("model", "fold").distinct().groupBy("model").agg(F.count("*").alias("folds"))
    per = effects.groupBy("model", "feature").agg(F.sum("effect").alias("s"), F.sum(F.col("effect") * F.col("effect")).alias("q"), F.count_if(F.expr("effect <> 0")).alias("k"), F.count_if(F.expr("effect > 0")).alias("up"), F.count_if(F.expr("effect < 0")).alias("down")).join(folds, "model")
    mean = F.col("s") / F.col("folds")
    dev = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("folds") - mean * mean))
    presence = F.col("k") / F.col("folds")
    flips = (F.col("up") > 0) & (F.col("down") > 0)
    relative = F.try_divide(dev, F.abs(mean))
    unstable = flips | F.coalesce(relative > 1.5, F.lit(False)) | ((presence > 0.2) & (presence < 0.8))
    return per.select("model", "feature", mean.alias("mean"), dev.alias("deviation"), presence.alias("presence"), flips.alias("flips"), unstable.alias("unstable"))
