"""Attributes as they were valid and known at an event's time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.edges import partition_reports, prefix_scan, share_carries, sorted_partitions
from tidemark.operators.intervals import OPEN, merge_intervals

#: Order of rows of one entity and instant: attribute changes come before the events they apply to.
VERSION, STATUS, EVENT = 0, 1, 2
SHARD_BITS = 44
_COLS = ["entity", "t", "kind", "id", "num", "flag"]


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best version of each entity through time, from versions sorted by (entity, shard, start) and cut to their shard;
    holds only the live ones. A shard's last change is that nothing is live at its end; the next shard begins anew."""
    entity, place, live, best, pushed = None, None, [], None, 0
    out: list[tuple] = []

    def step(until: int | None) -> None:
        """Applies the ends of best versions up to and including until."""
        nonlocal best
        while live and (until is None or live[0][1][0] <= until) and live[0][1][0] < OPEN:
            at = live[0][1][0]
            while live and live[0][1][0] <= at:
                heapq.heappop(live)
            top = live[0][1] if live else None
            if top != best:
                best = top
                out.append((entity, at, None if top is None else top[1], None if top is None else top[2]))

    for b in batches:
        for ent, shard, start, end, eff, known, version, value in zip(
            b["entity"], b["shard"], b["start"], b["end"], b["eff"], b["known"], b["version_id"], b["value"].astype(object).where(b["value"].notna(), None)
        ):
            if (ent, shard) != (entity, place):
                step(None)
                entity, place, live, best = ent, shard, [], None
            step(start)
            pushed += 1
            heapq.heappush(live, ((-eff, -known, -version, pushed), (end, version, value)))
            if live[0][1] != best:
                best = live[0][1]
                out.append((entity, start, best[1], best[2]))
        if out:
            yield _versions(out)
            out.clear()
    step(None)
    if out:
        yield _versions(out)


def _versions(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["entity", "t", "version_id", "value"])
    # of several changes at one instant the last holds
    df = df[~df.duplicated(["entity", "t"], keep="last")]
    return df.assign(version_id=df["version_id"].astype("Int64"), value=df["value"].astype("Int64"))


def version_timeline(versions: DataFrame, value: str, known_at: str) -> DataFrame:
    """(entity, t, version_id, value): changes of the version that is valid and known, per security.

    At t the version is, among those with effective_from <= t < effective_to (or null) and known_at <= t, the one with
    the greatest effective_from, then known_at, then version_id. Versions without known_at are never known.

    Time is cut into shards of 2**SHARD_BITS microseconds (203 days), and the sweep sees one security's shard: a security
    that holds a third of all versions is as many tasks' work as it has shards. A version is looked at in the shards it
    begins and ends in; of those that cover a shard whole only the best is, found by an aggregate that combines in the
    map tasks.
    """
    v = versions.select(
        F.col("security_id").alias("entity"),
        F.unix_micros("effective_from").alias("eff"),
        F.unix_micros(known_at).alias("known"),
        F.coalesce(F.unix_micros("effective_to"), F.lit(OPEN)).alias("end"),
        "version_id",
        F.col(value).cast("long").alias("value"),
    ).withColumn("start", F.greatest("eff", "known"))
    v = v.filter("entity is not null and eff is not null and known is not null and version_id is not null and start < end")
    last = v.agg(F.max(F.greatest("start", F.when(F.col("end") < OPEN, F.col("end"))))).first()[0]
    if last is None:
        return v.select("entity", F.col("start").alias("t"), "version_id", "value")  # no rows
    final = (last >> SHARD_BITS) + 1
    of = lambda c: F.shiftright(c, SHARD_BITS)
    begin = lambda c: F.shiftleft(c, SHARD_BITS)
    v = v.withColumns({"a": of(F.col("start")), "z": F.least(of(F.col("end") - 1), F.lit(final))})
    until = lambda c: F.when(F.col(c) == final, F.lit(OPEN)).otherwise(begin(F.col(c) + 1))
    kept = ["eff", "known", "version_id", "value"]
    first = v.select("entity", F.col("a").alias("shard"), "start", F.least("end", until("a")).alias("end"), *kept)
    ends = v.filter((F.col("z") > F.col("a")) & (F.col("end") < until("z"))).select("entity", F.col("z").alias("shard"), begin(F.col("z")).alias("start"), "end", *kept)
    # shards that a version covers from edge to edge: of those covering one, the best is enough
    to = F.when(F.col("end") < until("z"), F.col("z") - 1).otherwise(F.col("z"))
    covered = v.withColumn("_to", to).filter(F.col("_to") > F.col("a")).select("entity", F.explode(F.sequence(F.col("a") + 1, F.col("_to"))).alias("shard"), F.struct(*kept).alias("m"))
    covered = covered.groupBy("entity", "shard").agg(F.max("m").alias("m")).select("entity", "shard", begin(F.col("shard")).alias("start"), until("shard").alias("end"), "m.*")
    return (
        first.unionByName(ends).unionByName(covered).repartition("entity", "shard")
        .sortWithinPartitions("entity", "shard", "start", "eff", "known", "version_id")
        .mapInPandas(_sweep, "entity string, t long, version_id long, value long")
    )


def known_halts(halts: DataFrame) -> DataFrame:
    """(entity, t, flag): changes of a security's halt status as known: 1 halted, 0 not halted.

    Of each halt_id the observation seen last by t counts, from its first_seen_at to that of the next one; it halts the
    security from halt_at to resumption_trade_at. What several observations say is united as in intervals.
    """
    h = halts.select("security_id", "halt_id", F.unix_micros("first_seen_at").alias("seen"), F.unix_micros("halt_at").alias("a"), F.unix_micros("resumption_trade_at").alias("z"))
    h = h.filter("security_id is not null and halt_id is not null and seen is not null").distinct()
    # of observations seen at the same instant one holds: the greatest (halt_at, resumption)
    h = h.groupBy("security_id", "halt_id", "seen").agg(F.max(F.struct("a", "z")).alias("m")).select("security_id", "halt_id", "seen", "m.*")
    w = Window.partitionBy("security_id", "halt_id").orderBy("seen")
    h = h.withColumn("next", F.lead("seen").over(w)).withColumn("s", F.greatest("seen", "a")).withColumn("e", F.least("next", "z"))
    spans = merge_intervals(h.filter("a is not null"), "security_id", F.col("s"), F.col("e")).filter("kind = 'period'")
    start = spans.select(F.col("security_id").alias("entity"), F.col("start_us").alias("t"), F.lit(1).cast("byte").alias("flag"))
    end = spans.filter("end_us <> -1").select(F.col("security_id").alias("entity"), F.col("end_us").alias("t"), F.lit(0).cast("byte").alias("flag"))
    return start.unionByName(end)


def _report(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The last change of each kind in a partition."""
    last: dict[int, tuple] = {}
    for b in batches:
        kind = b["kind"].to_numpy()
        for k in (VERSION, STATUS):
            at = np.flatnonzero(kind == k)
            if len(at):
                r = b.iloc[at[-1]]
                last[k] = tuple(None if pd.isna(r[c]) else r[c] for c in _COLS)
    rows = [(*last.get(k, (None,) * len(_COLS)), k in last, str(k)) for k in (VERSION, STATUS)]
    out = pd.DataFrame(rows, columns=[*_COLS, "there", "slot"])
    return _typed(out)


def _typed(df: pd.DataFrame) -> pd.DataFrame:
    return df.assign(t=df["t"].astype("Int64"), kind=df["kind"].astype("Int8"), num=df["num"].astype("Int64"), flag=df["flag"].astype("Int8"))


def _carry(shared: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, carries = TaskContext.get().partitionId(), shared.value
        start = [carries[pid, s] for s in (str(VERSION), str(STATUS)) if (pid, s) in carries]
        tail = _typed(pd.DataFrame([{c: r[c] for c in _COLS} for r in start], columns=_COLS)) if start else None
        for b in batches:
            if not len(b):
                continue
            work = b[_COLS] if tail is None else pd.concat([tail, _typed(b[_COLS])], ignore_index=True)
            kind, ent = work["kind"].to_numpy(), work["entity"].to_numpy()
            idx = np.arange(len(work))
            at = np.flatnonzero(kind == EVENT)
            last = {k: np.maximum.accumulate(np.where(kind == k, idx, -1)) for k in (VERSION, STATUS)}
            got = {}
            for k in (VERSION, STATUS):
                p = last[k][at]
                ok = p >= 0
                ok[ok] = ent[p[ok]] == ent[at[ok]]
                got[k] = np.where(ok, p, -1)
            ev, v, s = work.iloc[at], got[VERSION], got[STATUS]
            # a change row of kind VERSION holds the version's id in id and its value in num
            version = work["id"].to_numpy()[v].astype(object)
            version[v < 0] = None
            value = work["num"].astype("Int64").take(v).reset_index(drop=True).mask(v < 0)
            halted = (s >= 0) & (work["flag"].fillna(0).to_numpy(np.int64)[s] == 1)
            yield pd.DataFrame(
                {
                    "id": ev["id"].to_numpy(),
                    "t": ev["t"].to_numpy(np.int64),
                    "own_num": ev["num"].astype("Int64").reset_index(drop=True),
                    "own_flag": ev["flag"].astype("Int8").reset_index(drop=True),
                    "version_id": pd.array([None if x is None else int(x) for x in version], dtype="Int64"),
                    "num": value,
                    "halted": halted,
                }
            )
            tail = work.iloc[[last[k][-1] for k in (VERSION, STATUS) if last[k][-1] >= 0]]

    return run


def attributes_known_at(events: DataFrame, versions: DataFrame, status: DataFrame) -> DataFrame:
    """(id, t, own_num, own_flag, version_id, num, halted): each event with the last change of either kind before it.

    events: entity, t, id (string), num (long), flag (byte); versions: entity, t, version_id, value; status: entity, t,
    flag. Changes at an event's own instant apply to it. version_id is null where no version is valid and known.
    Events without entity or time are left out. All rows are range-partitioned together by (entity, t) and sorted, the
    last change of each kind is carried forward, over partition edges through a prefix scan: an entity may be larger
    than a task.
    """
    e = events.select("entity", "t", F.lit(EVENT).cast("byte").alias("kind"), "id", "num", "flag").filter("entity is not null and t is not null")
    v = versions.select("entity", "t", F.lit(VERSION).cast("byte").alias("kind"), F.col("version_id").cast("string").alias("id"), F.col("value").alias("num"), F.lit(None).cast("byte").alias("flag"))
    s = status.select("entity", "t", F.lit(STATUS).cast("byte").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("num"), F.col("flag"))
    rows = sorted_partitions(e.unionByName(v).unionByName(s), ["entity", "t"], ["entity", "t", "kind", "id"])
    reports = partition_reports(rows, _report, "entity string, t long, kind byte, id string, num long, flag byte, there boolean, slot string")
    carries = share_carries(prefix_scan(reports, _COLS))
    out = "id string, t long, own_num long, own_flag byte, version_id long, num long, halted boolean"
    return rows.mapInPandas(_carry(carries), out)


def stale_attributes(observations: DataFrame, instruments: DataFrame, halts: DataFrame) -> DataFrame:
    """(observation_id, version_id, halt_status) of observations whose own free_float or halt_status isn't what was
    valid and known at their instant (utc_us); null is a value. One row per observation_id."""
    own = F.when(F.col("halt_status") == "halted", 1).when(F.col("halt_status") == "not_halted", 0).when(F.col("halt_status").isNotNull(), 2)
    events = observations.select(F.col("security_id").alias("entity"), F.col("utc_us").alias("t"), F.col("observation_id").alias("id"), F.col("free_float").cast("long").alias("num"), own.cast("byte").alias("flag"))
    known = attributes_known_at(events, version_timeline(instruments, "free_float", "free_float_available_at"), known_halts(halts))
    differs = ~F.col("own_num").eqNullSafe(F.col("num")) | ~F.col("own_flag").eqNullSafe(F.col("halted").cast("byte"))
    cases = known.filter(F.col("version_id").isNotNull() & differs)
    one = cases.groupBy("id").agg(F.max(F.struct("version_id", "halted")).alias("m"))
    return one.select(F.col("id").alias("observation_id"), "m.version_id", F.when(F.col("m.halted"), "halted").otherwise("not_halted").alias("halt_status"))
