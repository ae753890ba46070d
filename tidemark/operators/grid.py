"""Irregular readings onto a regular grid, by kernel-weighted local linear regression."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.streams import change_flags, whole_groups

SLOT_US = 60_000_000
DAY_US = 86_400_000_000
#: Half width of the kernel in slots; the Epanechnikov kernel 1 - u**2 is 0 from there on.
BANDWIDTH = 5
#: Effective readings a fit needs.
MIN_SUPPORT = 2.0
#: Least variance of the readings' offsets, in slots squared, for a slope; below, the fit is the weighted mean.
MIN_SPREAD = 1e-4

OUT = "entity string, slot long, fit double, last double, volume long, readings long, support double, missing boolean"
MOMENTS = [*[f"m{k}" for k in range(5)], *[f"y{k}" for k in range(4)]]


def slot_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Power sums per (entity, slot) of the readings' offsets d within their slot (in slots, 0 <= d < 1).

    batches: entity, slot, us, revised_us, y, volume, sorted so. Of several readings of one entity and instant the last
    holds (the latest revision, then the greatest value); exact copies count once. Infinite readings are there (n, last)
    but fit nothing. m0..m4 are sums of d**k, y0..y3 of
    y * d**k: with a kernel that is a polynomial on whole slots, they are all the regression needs. Holds a batch and a
    slot's readings at a time, so a day of very many readings is no more than its slots.
    """
    for g in whole_groups(batches, ["entity", "slot"]):
        last = np.append(change_flags(g, ["entity", "us"])[1:], True)
        g = g[last]
        head = np.flatnonzero(change_flags(g, ["entity", "slot"]))
        slot = g["slot"].to_numpy(np.int64)
        d = (g["us"].to_numpy(np.int64) - slot * SLOT_US) / SLOT_US
        y = g["y"].to_numpy(float)
        fits = np.isfinite(y)
        used, y0 = fits.astype(float), np.where(fits, y, 0.0)
        tail = np.append(head[1:], len(g)) - 1
        volume = g["volume"].to_numpy(float)
        some = ~np.isnan(volume)
        whole = g["volume"].fillna(0).astype(np.int64).to_numpy()
        out = {"entity": g["entity"].to_numpy()[head], "slot": slot[head], "n": tail - head + 1, "last": y[tail]}
        out["volume"] = pd.array(np.add.reduceat(whole, head), dtype="Int64")
        out["volume"][~np.logical_or.reduceat(some, head)] = pd.NA
        out |= {f"m{k}": np.add.reduceat(used * d**k, head) for k in range(5)} | {f"y{k}": np.add.reduceat(y0 * d**k, head) for k in range(4)}
        out["day"] = slot[head] // (DAY_US // SLOT_US)
        yield pd.DataFrame(out)


def _regress(h: int, min_support: float):
    # the kernel is 1 - (x / h)**2 with x = offset of the reading's slot + d, for slots -h .. h-1 around the grid time
    deltas = np.arange(-h, h, dtype=float)

    def window_sum(dense: np.ndarray, k: int) -> np.ndarray:
        """Sum over the window of x**k (times y, as dense has it), from power sums of d: (delta + d)**k expanded."""
        total = np.zeros(dense.shape[1])
        for i in range(k + 1):
            taps = comb(k, i) * deltas ** (k - i)
            total += np.convolve(dense[i], taps[::-1], "full")[h - 1 : h - 1 + dense.shape[1]]
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(slot_moments(batches), ["entity", "day"]):
            head = np.flatnonzero(change_flags(g, ["entity", "day"]))
            slot = g["slot"].to_numpy(np.int64)
            tail = np.append(head[1:], len(g)) - 1
            length = slot[tail] - slot[head] + 1
            # the grids of all groups in one array, 2h empty slots apart, so no window reaches another group
            base = np.concatenate([[0], np.cumsum(length + 2 * h)[:-1]]) + h
            size = int(base[-1] + length[-1] + h)
            group = np.repeat(np.arange(len(head)), np.append(head[1:], len(g)) - head)
            at = base[group] + slot - slot[head][group]
            n = g["n"].to_numpy(float)
            m, y = np.split(g[MOMENTS].to_numpy(float).T, [5])
            centre = np.bincount(group, y[0]) / np.maximum(np.bincount(group, m[0]), 1)
            y = y - centre[group] * m[:4]
            dm, dy = np.zeros((5, size)), np.zeros((4, size))
            dm[:, at], dy[:, at] = m, y
            s = [window_sum(dm, k) for k in range(5)]
            t = [window_sum(dy, k) for k in range(4)]
            w0, w1, w2 = (s[k] - s[k + 2] / h**2 for k in range(3))
            t0, t1 = (t[k] - t[k + 2] / h**2 for k in range(2))
            square = s[0] - 2 * s[2] / h**2 + s[4] / h**4
            with np.errstate(divide="ignore", invalid="ignore"):
                support = np.where(square > 1e-12, w0**2 / square, 0.0)
                det = w0 * w2 - w1**2
                flat = t0 / w0
                fit = np.where(det > MIN_SPREAD * np.maximum(w0, 1e-12) ** 2, (w2 * t0 - w1 * t1) / det, flat)
            cell = np.repeat(base, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
            of = np.repeat(np.arange(len(head)), length)
            src = np.full(size, -1)
            src[at] = np.arange(len(g))
            row = src[cell]
            there = row >= 0
            enough = support[cell] >= min_support - 1e-9
            volume = g["volume"].astype("Int64").take(row).reset_index(drop=True)
            yield pd.DataFrame(
                {
                    "entity": g["entity"].to_numpy()[head][of],
                    "slot": slot[head][of] + cell - base[of],
                    "fit": np.where(enough, fit[cell] + centre[of], np.nan),
                    "last": np.where(there, g["last"].to_numpy(float)[row], np.nan),
                    "volume": volume.mask(~there),
                    "readings": np.where(there, n[row], 0).astype(np.int64),
                    "support": support[cell],
                    "missing": ~there,
                }
            )

    return run


def regular_grid(readings: DataFrame, bandwidth: int = BANDWIDTH, min_support: float = MIN_SUPPORT) -> DataFrame:
    """One row per entity, UTC day and slot from the day's first to its last slot with a reading.

    readings: entity, us, y, volume, revised_us. fit is the local linear regression at the slot's start over the readings
    less than bandwidth slots away on the same day (null where the effective number of readings, (sum w)**2 / sum w**2,
    is below min_support); last and volume are the slot's own last reading and summed volume (null where none is known);
    missing marks slots whose own support, that of readings within the slot, is none. Readings with a null or NaN y or a
    null entity or time are none; infinite ones are there but take no part in fits. An entity and day without reading has
    no grid. Volumes are exact up to 2**53.

    One exchange by (entity, day), the shard within which readings see each other; a hot entity is spread over its days.
    """
    r = readings.filter("entity is not null and us is not null and y is not null and not isnan(y)")
    r = r.select("entity", F.floor(F.col("us") / SLOT_US).cast("long").alias("slot"), "us", "revised_us", F.col("y").cast("double").alias("y"), F.col("volume").cast("long").alias("volume"))
    day = F.floor(F.col("slot") / (DAY_US // SLOT_US))
    runs = r.repartition("entity", day).sortWithinPartitions("entity", "slot", "us", "revised_us", "y", "volume")
    out = runs.mapInPandas(_regress(bandwidth, min_support), OUT)
    return out.withColumn("fit", F.nanvl("fit", F.lit(None).cast("double"))).withColumn("last", F.nanvl("last", F.lit(None).cast("double")))


def minute_readings(bars: DataFrame) -> DataFrame:
    """Readings of the one-minute rows of bars."""
    one = bars.filter("timeframe = '1m' and close is not null and not isnan(close)")
    return one.select(F.col("security_id").alias("entity"), F.unix_micros("timestamp").alias("us"), F.col("close").alias("y"), "volume", F.unix_micros("available_at").alias("revised_us"))


def minute_grid(bars: DataFrame) -> DataFrame:
    """One-minute series of close and volume per security and UTC day, with fitted values and missing minutes marked."""
    g = regular_grid(minute_readings(bars))
    return g.select(
        F.col("entity").alias("security_id"),
        (F.col("slot") * SLOT_US).alias("slot_us"),
        F.col("fit").alias("close_fit"),
        F.col("last").alias("close"),
        "volume",
        "readings",
        "support",
        "missing",
    )
