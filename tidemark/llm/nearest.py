"""Records of two tables paired by nearest time, per entity and within a tolerance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.edges import partition_reports, prefix_scan, share_carries, sorted_partitions

_COLS = ["entity", "t", "left", "id"]


def _report(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The first right record of a partition and the first of its last run of right records with equal (entity, t)."""
    first = last = None
    for b in batches:
        r = b[~b["left"].to_numpy(bool)]
        if not len(r):
            continue
        if first is None:
            first = (r["entity"].iat[0], int(r["t"].iat[0]), r["id"].iat[0])
        ent, t = r["entity"].to_numpy(), r["t"].to_numpy(np.int64)
        run = np.flatnonzero((ent == ent[-1]) & (t == t[-1]))[0]
        if last is None or (ent[-1], t[-1]) != last[:2]:
            last = (ent[-1], int(t[-1]), r["id"].iat[run])
    rows = [(*(v or (None, None, None)), v is not None, slot) for v, slot in ((first, "first"), (last, "last"))]
    out = pd.DataFrame(rows, columns=["entity", "t", "id", "there", "slot"])
    return out.assign(t=out["t"].astype("Int64"))


def _pair(work: pd.DataFrame, tolerance: int) -> tuple[pd.DataFrame, np.ndarray, int]:
    """Best partner of each left row in rows sorted by (entity, t, left, id), the rows that may still find a nearer one
    behind the end, and the index of the first of the last run of right rows (-1: none)."""
    ent, t = work["entity"].to_numpy(), work["t"].to_numpy(np.int64)
    left, ident = work["left"].to_numpy(bool), work["id"].to_numpy()
    n = len(work)
    idx = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = (ent[1:] == ent[:-1]) & (t[1:] == t[:-1]) & ~left[1:] & ~left[:-1]
    head = np.maximum.accumulate(np.where(~left & ~same, idx, -1))  # first of the latest run of right rows
    nxt = np.minimum.accumulate(np.where(~left, idx, n)[::-1])[::-1]
    at = np.flatnonzero(left)
    far = np.int64(tolerance) + 1
    p, q = head[at], nxt[at]
    dp, dq = np.full(len(at), far), np.full(len(at), far)
    ok = p >= 0
    ok[ok] = ent[p[ok]] == ent[at[ok]]
    dp[ok] = t[at[ok]] - t[p[ok]]
    has = q < n
    good = has.copy()
    good[has] = ent[q[has]] == ent[at[has]]
    dq[good] = t[q[good]] - t[at[good]]
    prev = dp <= dq
    d = np.minimum(dp, dq)
    pick = np.where(prev, p, q)
    found = d <= tolerance
    # a later right row can matter only to rows of the last entity that lie behind the last right row
    open_ = ~has & (ent[at] == ent[-1]) & (t[-1] - t[at] <= tolerance) if n else has
    out = pd.DataFrame({"id": ident[at], "partner": ident[np.where(found, pick, 0)], "t": t[np.where(found, pick, 0)], "distance": d})
    return out[found & ~open_], at[open_], int(head[-1]) if n else -1


def _scan(shared: Broadcast, tolerance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, carries = TaskContext.get().partitionId(), shared.value
        row = lambda c: pd.DataFrame([(c["entity"], c["t"], False, c["id"])], columns=_COLS)
        before, after = carries.get((pid, "last")), carries.get((pid, "first"))
        tail = row(before) if before else None
        for b in batches:
            if not len(b):
                continue
            work = b[_COLS] if tail is None else pd.concat([tail, b[_COLS]], ignore_index=True)
            out, open_, last = _pair(work, tolerance)
            yield out
            tail = work.iloc[[*([last] if last >= 0 else []), *open_]]
        if tail is not None:
            if after:
                tail = pd.concat([tail, row(after)], ignore_index=True)
            else:  # nothing comes behind: a right row of no entity closes what is open
                tail = pd.concat([tail, pd.DataFrame([("\0", 0, False, "")], columns=_COLS)], ignore_index=True)
            yield _pair(tail, tolerance)[0]

    return run


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int) -> DataFrame:
    """(id, partner, t, distance): for each left id the right row of its entity nearest in time, within the tolerance.

    left and right have entity (string), t (long) and id (string); rows with a null in any of them don't take part. Of
    equally near right rows the earlier holds, then the smaller id. One row per left id that has a partner; of several
    left rows of one id (copies, or even different times) the nearest pair holds. Empty tables give no rows.

    Both tables are range-partitioned together by (entity, t) and scanned locally; records at partition edges come
    through a prefix scan, so an entity may be larger than a task. Rows of equal (entity, t) are in one partition.
    """
    side = lambda df, is_left: df.select("entity", "t", F.lit(is_left).alias("left"), "id").dropna()
    both = sorted_partitions(side(left, True).unionByName(side(right, False)), ["entity", "t"], _COLS)
    reports = partition_reports(both, _report, "entity string, t long, id string, there boolean, slot string")
    forward = prefix_scan(reports.filter("slot = 'last'"), ["entity", "t", "id"])
    back = prefix_scan(reports.filter("slot = 'first'"), ["entity", "t", "id"], backward=True)
    carries = share_carries(forward.unionByName(back))
    pairs = both.mapInPandas(_scan(carries, tolerance_us), "id string, partner string, t long, distance long")
    best = pairs.groupBy("id").agg(F.min(F.struct("distance", "t", "partner")).alias("b"))
    return best.select("id", "b.partner", "b.t", "b.distance")


def ticker_key(ticker: Column) -> Column:
    """Tickers compare without case and surrounding blanks; a blank ticker is none."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(ticker, r"(?U)^\s+|\s+$", ""))), F.lit(""))
