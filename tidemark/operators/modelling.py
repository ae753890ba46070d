"""Chronological splits, purged folds, preprocessing and model fits, from sums that scale with features, not rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_last, global_row_numbers, running_totals
from tidemark.session import cut, stored

#: Distinct feature rows up to which a fit iterates on the driver; beyond, each iteration is a pass over the table.
LOCAL_ROWS = 50_000
#: Distinct values of all features up to which medians are one aggregate's work.
MEDIAN_ROWS = 1_000_000


def split_label(as_of_us: Column, train_end: int, calibration: tuple[int, int], final: tuple[int, int]) -> Column:
    """train, calibration, final_test, embargo (gaps before the final range) or out_of_range; ranges are closed."""
    return (
        F.when(as_of_us <= train_end, "train")
        .when((as_of_us >= calibration[0]) & (as_of_us <= calibration[1]), "calibration")
        .when((as_of_us >= final[0]) & (as_of_us <= final[1]), "final_test")
        .when(as_of_us < final[0], "embargo")
        .otherwise("out_of_range")
    )


def embargo_breaches(rows: DataFrame, calibration_start: int, final_start: int) -> DataFrame:
    """Rows whose outcome became known only after the next range had begun."""
    return rows.filter(((F.col("split") == "train") & (F.col("outcome_us") >= calibration_start)) | ((F.col("split") == "calibration") & (F.col("outcome_us") >= final_start)))


def walk_forward_folds(rows: DataFrame, minimum: int, validation: int, step: int, order: list[str], as_of: str = "as_of_us", outcome: str = "outcome_us") -> DataFrame:
    """(fold, start_position, first_us, train, validation): purged expanding folds by position in time.

    Fold i validates the positions minimum + i * step and on; it trains on earlier rows whose outcome was known before
    its first validation row. Positions come without a global sort in one task. The first fold that may train on a row
    follows from its position and, by an as-of lookup, from when its outcome became known; what a fold trains on is the
    running total over folds, so neither rows nor folds meet in one task or on the driver.
    """
    numbered = global_row_numbers(rows.select(*dict.fromkeys([*order, as_of, outcome])), order).withColumn("pos", F.col("position") - 1)
    n = numbered.count()
    count = max(0, (n - minimum - validation) // step + 1)
    if not count:
        return rows.sparkSession.createDataFrame([], "fold int, start_position long, first_us long, train long, validation long")
    at = F.col("pos") - minimum
    starts = numbered.filter((at >= 0) & (at % step == 0)).select((at / step).cast("int").alias("fold"), F.col("pos").alias("start_position"), F.col(as_of).alias("first_us")).filter(F.col("fold") < count)
    # first_us rises with the fold: folds up to the last one that begins at the outcome's time or before don't know it
    blind = starts.groupBy("first_us").agg(F.max("fold").alias("_blind"))
    placed = asof_last(numbered, blind, [], outcome, "first_us", ["_blind"], 86_400_000_000)
    early = F.greatest(F.lit(0), F.ceil((at + 1) / step)).cast("int")
    per = placed.groupBy(F.greatest(F.coalesce(F.col("_blind") + 1, F.lit(0)), early).alias("fold")).agg(F.count("*").alias("n"))
    every = starts.join(per, "fold", "left").fillna(0, ["n"])
    return running_totals(every, ["fold"], "n", "train").select("fold", "start_position", "first_us", "train", F.least(F.lit(validation).cast("long"), F.lit(n) - F.col("start_position")).alias("validation"))


def feature_statistics(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, missing, median, mean, deviation): exact median, mean and population deviation after imputing it.

    The rows become counts of distinct values first. Up to MEDIAN_ROWS of these the median is an aggregate; more are ranked
    in range partitions, so that no task sees all values of a feature.
    """
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    counts = stored(train.select(long.alias("x")).select("x.*").groupBy("feature", "v").agg(F.count("*").alias("k")), "values")
    some, v, k = counts.filter("v is not null"), F.col("v"), F.col("k")
    sums = counts.groupBy("feature").agg(F.sum("k").alias("n"), F.sum(F.when(v.isNull(), k).otherwise(0)).alias("missing"), F.sum(v * k).alias("s"), F.sum(v * v * k).alias("q"))
    if counts.count() <= MEDIAN_ROWS:
        medians = some.groupBy("feature").agg(F.percentile("v", F.lit(0.5), F.col("k")).alias("median"))
    else:
        medians = _ranked_medians(some)
    a = sums.join(F.broadcast(medians), "feature", "left")  # a row per feature
    mean = (F.col("s") + F.col("missing") * F.col("median")) / F.col("n")
    square = (F.col("q") + F.col("missing") * F.col("median") * F.col("median")) / F.col("n")
    mean = F.when(F.col("missing") == 0, F.col("s") / F.col("n")).otherwise(mean)
    var = F.greatest(F.lit(0.0), F.when(F.col("missing") == 0, F.col("q") / F.col("n")).otherwise(square) - mean * mean)
    return a.select("feature", "n", "missing", "median", mean.alias("mean"), F.when(var <= 1e-12, 1.0).otherwise(F.sqrt(var)).alias("deviation"))


def _ranked_medians(counts: DataFrame) -> DataFrame:
    """(feature, median) from (feature, v, k), by the running count over all features in order of (feature, v)."""
    totals = counts.groupBy("feature").agg(F.sum("k").alias("_n")).orderBy("feature").collect()  # a row per feature
    offset, rows = 0, []
    for r in totals:
        rows.append((r["feature"], offset + (r["_n"] - 1) // 2, offset + r["_n"] // 2))
        offset += r["_n"]
    wanted = counts.sparkSession.createDataFrame(rows, "feature string, _lo long, _hi long")
    placed = running_totals(counts, ["feature", "v"], "k", "_to").withColumn("_from", F.col("_to") - F.col("k")).join(F.broadcast(wanted), "feature")
    inside = lambda c: (F.col(c) >= F.col("_from")) & (F.col(c) < F.col("_to"))
    pick = lambda c: F.max(F.when(inside(c), F.col("v")))
    return placed.filter(inside("_lo") | inside("_hi")).groupBy("feature").agg(((pick("_lo") + pick("_hi")) / 2).alias("median"))


def standardised(rows: DataFrame, statistics: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with z_<feature>, imputed and standardised, and m_<feature>, 1 where missing; and their names."""
    s = {r["feature"]: r for r in statistics.collect()}  # a row per feature
    lost = [f for f in features if s[f]["median"] is None]
    if lost:
        raise ValueError(f"no training value for {lost}")
    out = {}
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(s[f]["median"]))
        out[f"z_{f}"] = (x - F.lit(s[f]["mean"])) / F.lit(s[f]["deviation"])
        out[f"m_{f}"] = F.col(f).isNull().cast("double")
    return rows.withColumns(out), list(out)


def laplace_frequency(rows: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    return rows.filter(F.col(y).isNotNull()).groupBy(*by).agg(((F.sum(y) + 1) / (F.count("*") + 2)).alias("frequency"))


class Cells:
    """Distinct feature rows with their weight and label sum: what a fit needs of the table, held locally if small.

    total(f) adds f(x, w, s) over all cells: x features, w rows, s label sum of each cell.
    """

    def __init__(self, rows: DataFrame, names: list[str], y: str):
        kept = rows.filter(F.col(y).isNotNull()).groupBy(*names).agg(F.count("*").cast("double").alias("_w"), F.sum(F.col(y).cast("double")).alias("_s"), F.sum(F.col(y).cast("double") * F.col(y)).alias("_q"))
        self.names = names
        self.table = cut(kept)
        self.local = None
        if self.table.count() <= LOCAL_ROWS:
            # sorted, so that sums don't depend on the order of tasks
            p = self.table.toPandas().sort_values(names, kind="stable")
            self.local = (p[names].to_numpy(float), p["_w"].to_numpy(float), p["_s"].to_numpy(float))

    def total(self, f) -> np.ndarray:
        if self.local is not None:
            return f(*self.local)
        names = self.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = None
            for b in batches:
                v = f(b[names].to_numpy(float), b["_w"].to_numpy(float), b["_s"].to_numpy(float))
                acc = v if acc is None else acc + v
            if acc is not None:
                yield pd.DataFrame({"v": [acc.ravel()]})

        parts = self.table.mapInPandas(run, "v array<double>").collect()  # a row per partition
        return np.sum([p["v"] for p in parts], axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: float) -> float:
    p = min(max(p, 1e-8), 1 - 1e-8)
    return log(p / (1 - p))


def fit_logistic(cells: Cells, iterations: int = 280, rate: float = 0.08, decay: float = 100.0, penalty: float = 0.08) -> np.ndarray:
    """Intercept and weights by full-batch gradient descent with an L2 penalty on the weights."""
    n, s = cells.total(lambda x, w, s: np.array([w.sum(), s.sum()]))
    b, k = logit((s + 1) / (n + 2)), np.zeros(len(cells.names))
    for i in range(iterations):

        def slope(x, w, s, b=b, k=k):
            r = w * sigmoid(b + x @ k) - s
            return np.append(r.sum(), r @ x)

        g = cells.total(slope) / n
        step = rate / sqrt(1 + i / decay)
        b, k = b - step * g[0], k - step * (g[1:] + penalty * k)
    return np.append(b, k)


def fit_ridge(cells: Cells, iterations: int = 360, rate: float = 0.025, decay: float = 150.0, penalty: float = 0.10) -> np.ndarray:
    """Intercept and weights by the same descent on squared error. Its gradients follow from second moments: one pass."""
    d = len(cells.names)

    def moments(x, w, s):
        a = np.column_stack([np.ones(len(x)), x])
        return np.concatenate([(a.T * w @ a).ravel(), a.T @ s])

    m = cells.total(moments)
    gram, cross = m[: (d + 1) ** 2].reshape(d + 1, d + 1), m[(d + 1) ** 2 :]
    n = gram[0, 0]
    k = np.zeros(d + 1)
    k[0] = cross[0] / n
    shrink = np.append(0.0, np.full(d, penalty))
    for i in range(iterations):
        k = k - rate / sqrt(1 + i / decay) * ((gram @ k - cross) / n + shrink * k)
    return k


def thresholds(cells: Cells, quantiles: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> list[list[float]]:
    """Per feature the midpoints at quantile places of its distinct values."""
    out = []
    for j, name in enumerate(cells.names):
        if cells.local is not None:  # the distinct values are here
            v = np.unique(cells.local[0][:, j])
            at = sorted({min(len(v) - 2, max(0, int(q * (len(v) - 1)))) for q in quantiles}) if len(v) > 1 else []
            out.append(sorted({(v[a] + v[a + 1]) / 2 for a in at}))
            continue
        values = cells.table.select(F.col(name).alias("v")).distinct()
        n = values.count()
        if n < 2:
            out.append([])
            continue
        at = sorted({min(n - 2, max(0, int(q * (n - 1)))) for q in quantiles})
        wanted = {i for a in at for i in (a, a + 1)}
        numbered = global_row_numbers(values, ["v"]).filter((F.col("position") - 1).isin(*wanted)).collect()
        v = {r["position"] - 1: r["v"] for r in numbered}
        out.append(sorted({(v[a] + v[a + 1]) / 2 for a in at}))
    return out


def fit_stumps(cells: Cells, rounds: int = 16, rate: float = 0.12, binary: bool = True) -> tuple[float, list[tuple[int, float, float, float, float]]]:
    """Base score and stumps (feature, threshold, left, right, gain): boosting on the residuals.

    Each round is one pass that sums weights and residuals left of every candidate threshold; of equal gains the first
    feature and threshold win.
    """
    n, s = cells.total(lambda x, w, s: np.array([w.sum(), s.sum()]))
    base = logit((s + 1) / (n + 2)) if binary else s / n
    cuts = [(j, t) for j, ts in enumerate(thresholds(cells)) for t in ts]
    stumps: list[tuple[int, float, float, float, float]] = []
    for _ in range(rounds):

        def sums(x, w, s, stumps=tuple(stumps)):
            z = score(x, base, stumps, rate)
            r = s - w * (sigmoid(z) if binary else z)
            left = [(w[m].sum(), r[m].sum()) for j, t in cuts for m in (x[:, j] <= t,)]
            return np.array([(w.sum(), r.sum()), *left])

        v = cells.total(sums).reshape(-1, 2)
        (w, r), best = v[0], None
        for (j, t), (wl, rl) in zip(cuts, v[1:]):
            wr, rr = w - wl, r - rl
            if wl > 0 and wr > 0:
                gain = rl * rl / wl + rr * rr / wr - r * r / w
                if gain > (best[4] if best else 0.0) + 1e-12:
                    best = (j, t, rl / wl, rr / wr, gain)
        if best is None or best[4] <= 1e-12:
            break
        stumps.append(best)
    return base, stumps


def score(x: np.ndarray, base: float, stumps, rate: float) -> np.ndarray:
    z = np.full(len(x), base)
    for j, t, left, right, _ in stumps:
        z = z + rate * np.where(x[:, j] <= t, left, right)
    return z


def fit_platt(cells: Cells, iterations: int = 220, rate: float = 0.05, decay: float = 100.0, pull: float = 0.02) -> tuple[float, float]:
    """Intercept and slope of a logistic calibration on cells of one column, the logit of p, with a prior towards slope
    1; (0, 1) with fewer than ten rows or one class."""
    n, s = cells.total(lambda x, w, s: np.array([w.sum(), s.sum()]))
    if n < 10 or s in (0, n):
        return 0.0, 1.0
    a, b = 0.0, 1.0
    for i in range(iterations):

        def slope(x, w, s, a=a, b=b):
            r = w * sigmoid(a + b * x[:, 0]) - s
            return np.array([r.sum(), r @ x[:, 0]])

        g = cells.total(slope) / n
        step = rate / sqrt(1 + i / decay)
        a, b = a - step * g[0], b - step * (g[1] + pull * (b - 1))
    return a, b


def select_simplest(scores: DataFrame, tolerance: float) -> DataFrame:
    """(target, model): the first family, in order of rank, whose score is within the tolerance of the best."""
    best = scores.groupBy("target").agg(F.min("score").alias("_b"))
    near = scores.join(best, "target").filter(F.col("score") <= F.col("_b") + tolerance)
    return near.groupBy("target").agg(F.min_by("model", "rank").alias("model"))
