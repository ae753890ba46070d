"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Exact time units (microseconds) are bits. The bits of an entity are held in shards of 2**SHARD_BITS units, each shard a
run-length compressed bitmap (pairs of offset and length, as in a roaring bitmap's run container). An interval sets a run
in its first and its last shard; the shards between are one fill record, however many they are. Bitmaps are united per
(entity, shard), first in the map task and then after the shuffle, so an entity that holds a third of all rows is spread
over its shards. Set runs and clear runs inside a shard are final; only a shard's first and last run and the fills go
into the scan that joins runs across shard edges (at most two rows a shard, whatever the number of intervals).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.streams import change_flags, running_max, whole_groups
from tidemark.session import stored

SHARD_BITS = 36  # 2**36 us are 19 hours
OPEN = 1 << 61  # the end of an interval without end; a multiple of every shard's width


def unite_runs(key_change: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set runs of rows sorted by (key, start): index of each run's first row, its start and its end. Touching runs are one."""
    if not len(start):
        return np.empty(0, np.int64), start, end
    reach = running_max(end, key_change)
    new = key_change.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return first, start[first], reach[last]


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map side: the bitmaps of the intervals in a batch, one per (entity, shard), and its fills."""
    width = 1 << SHARD_BITS
    for b in batches:
        if not len(b):
            continue
        ent, s, e = b["entity"].to_numpy(), b["s"].to_numpy(np.int64), b["e"].to_numpy(np.int64)
        a, z = s >> SHARD_BITS, (e - 1) >> SHARD_BITS
        two = z > a
        ent2 = np.concatenate([ent, ent[two]])
        shard = np.concatenate([a, z[two]])
        lo = np.concatenate([s - (a << SHARD_BITS), np.zeros(two.sum(), np.int64)])
        hi = np.concatenate([np.where(two, width, e - (a << SHARD_BITS)), (e - (z << SHARD_BITS))[two]])
        fills = z > a + 1
        fill = pd.DataFrame({"entity": ent[fills], "shard": a[fills] + 1, "fill_to": z[fills]})
        fill = fill.groupby(["entity", "shard"], as_index=False)["fill_to"].max()
        code = pd.factorize(ent2)[0]
        order = np.lexsort((lo, shard, code))
        code, shard, lo, hi, ent2 = code[order], shard[order], lo[order], hi[order], ent2[order]
        change = np.ones(len(code), bool)
        change[1:] = (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])
        first, run_s, run_e = unite_runs(change, lo, hi)
        runs = np.stack([run_s, run_e - run_s], axis=1)
        of = np.cumsum(change)[first]
        edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ends = np.append(edges[1:], len(of))
        maps = pd.DataFrame(
            {
                "entity": ent2[first[edges]],
                "shard": shard[first[edges]],
                "runs": [runs[i:j].astype("<i8").tobytes() for i, j in zip(edges, ends)],
                "fill_to": np.zeros(len(edges), np.int64),
            }
        )
        fill["runs"] = b""
        yield pd.concat([maps, fill[["entity", "shard", "runs", "fill_to"]]], ignore_index=True)


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce side: unites the bitmaps of each (entity, shard) and extracts its set runs and clear runs.

    part F and L: a shard's first and last run; X: a fill; P and G: runs and gaps that lie inside the shard.
    """
    for g in whole_groups(batches, ["entity", "shard"]):
        ent, shard = g["entity"].to_numpy(), g["shard"].to_numpy(np.int64)
        fill = g["fill_to"].to_numpy(np.int64)
        out = []
        sizes = g["runs"].map(len).to_numpy() // 16
        if (x := sizes == 0).any():
            top = pd.DataFrame({"entity": ent[x], "shard": shard[x], "e": fill[x]})
            top = top.groupby(["entity", "shard"], as_index=False)["e"].max()
            top["s"] = top["shard"].to_numpy() << SHARD_BITS
            top["e"] = top["e"].to_numpy() << SHARD_BITS
            out.append(top.assign(part="X", inner=False)[["entity", "shard", "part", "s", "e", "inner"]])
        flat = np.frombuffer(b"".join(g["runs"]), "<i8").reshape(-1, 2)
        if len(flat):
            row = np.repeat(np.arange(len(g)), sizes)
            group = np.cumsum(change_flags(g, ["entity", "shard"]))[row]
            lo = flat[:, 0]
            order = np.lexsort((lo, group))
            group, lo, hi, row = group[order], lo[order], (flat[:, 0] + flat[:, 1])[order], row[order]
            change = np.append(True, group[1:] != group[:-1])
            first, s, e = unite_runs(change, lo, hi)
            at, of = row[first], group[first]
            base = shard[at] << SHARD_BITS
            s, e = s + base, e + base
            head = np.append(True, of[1:] != of[:-1])
            tail = np.append(of[1:] != of[:-1], True)
            part = np.where(head, "F", np.where(tail, "L", "P"))
            runs = pd.DataFrame({"entity": ent[at], "shard": shard[at], "part": part, "s": s, "e": e, "inner": head & ~tail})
            gap = ~head
            clear = pd.DataFrame({"entity": ent[at][gap], "shard": shard[at][gap], "part": "G", "s": e[np.flatnonzero(gap) - 1], "e": s[gap], "inner": False})
            out += [runs, clear]
        if out:
            yield pd.concat(out, ignore_index=True)


def merge_intervals(intervals: DataFrame, entity: str, start_us: Column, end_us: Column) -> DataFrame:
    """(entity, kind, start_us, end_us): kind ``period`` or ``gap``; end_us is -1 for a period without end.

    Intervals are half open, [start_us, end_us); a null end_us is an interval without end. Rows with a null entity or
    start and intervals whose end isn't after their start don't count. Periods that overlap or touch are one; a gap lies
    between two consecutive periods of an entity. Times must lie within +-2**60 microseconds. Empty input gives no rows;
    repeated rows change nothing.
    """
    cells = (
        intervals.select(F.col(entity).alias("entity"), start_us.alias("s"), F.coalesce(end_us, F.lit(OPEN)).alias("e"))
        .filter("entity is not null and s is not null and e > s")
        .mapInPandas(_pack, "entity string, shard long, runs binary, fill_to long")
    )
    parts = (
        cells.repartition("entity", "shard")
        .sortWithinPartitions("entity", "shard")
        .mapInPandas(_unite, "entity string, shard long, part string, s long, e long, inner boolean")
    )
    parts = stored(parts, "runs")  # five branches below read them
    # the scan over shard edges: at most a first run, a last run and a fill per (entity, shard)
    edge = parts.filter(F.col("part").isin("F", "L", "X"))
    order = Window.partitionBy("entity").orderBy("s", F.desc("e"), "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    scan = (
        edge.withColumn("reach", F.max("e").over(before))
        .withColumn("fill_reach", F.max(F.when(F.col("part") == "X", F.col("e"))).over(upto))
        .withColumn("new", F.col("reach").isNull() | (F.col("s") > F.col("reach")))
        .withColumn("island", F.sum(F.col("new").cast("long")).over(upto))
    )
    periods = scan.groupBy("entity", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    gaps = scan.filter("new and reach is not null and part <> 'L'").select("entity", F.col("reach").alias("s"), F.col("s").alias("e"))
    filled = scan.filter(F.col("inner") & (F.col("fill_reach") > F.col("shard") * F.lit(1 << SHARD_BITS))).select("entity", "shard")
    inside = parts.filter(F.col("part").isin("P", "G")).join(filled, ["entity", "shard"], "left_anti")
    kind = lambda df, k: df.select("entity", F.lit(k).alias("kind"), "s", "e")
    every = (
        kind(periods, "period")
        .unionByName(kind(gaps, "gap"))
        .unionByName(inside.select("entity", F.when(F.col("part") == "P", "period").otherwise("gap").alias("kind"), "s", "e"))
    )
    return every.select(
        F.col("entity").alias(entity),
        "kind",
        F.col("s").alias("start_us"),
        F.when(F.col("e") >= OPEN, F.lit(-1).cast("long")).otherwise(F.col("e")).alias("end_us"),
    )


def latest_observation(rows: DataFrame, key: str, seen: str, columns: list[str]) -> DataFrame:
    """Of several observations of a key the one seen last; ties are broken by the columns' values, greatest first.

    A hash aggregate with map-side combine, so a key with many observations is no hot group. Null keys are left out; a
    null time counts as earliest.
    """
    rank = F.struct(F.col(seen), *[F.col(c) for c in columns if c not in (seen, key)])
    best = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(rank).alias("_m"))
    return best.select(key, *[F.col(f"_m.{c}").alias(c) for c in dict.fromkeys([seen, *columns]) if c != key])


def halt_periods(halts: DataFrame) -> DataFrame:
    """Continuous halted periods of each security and the gaps between them, from the latest observation of each halt."""
    last = latest_observation(halts, "halt_id", "first_seen_at", ["security_id", "halt_at", "resumption_trade_at", "processing_timestamp"])
    return merge_intervals(last, "security_id", F.unix_micros("halt_at"), F.unix_micros("resumption_trade_at"))
