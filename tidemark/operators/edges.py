"""Scans over tables that are range-partitioned globally, with an exchange of records at partition edges.

A table sorted by (entity, time) over all its partitions can be scanned partition by partition, if every partition is
given the nearest record before its first row and the nearest after its last. An entity may span any number of
partitions. Each partition reports its own first and last records (one row per partition and slot); an exclusive prefix
scan over those reports, in parallel blocks, gives every partition what lies beyond its edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut

#: Partition reports that one task scans; longer tables of reports are scanned in parallel blocks.
BLOCK = 256


def sorted_partitions(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Range-partitions by ``by``, sorts within partitions and cuts the lineage, so that later passes see the same cut.

    Range partitioning runs df twice, once to sample it: give a df that is cheap to read (a written table).
    """
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*within))


def partition_reports(df: DataFrame, report: Callable[[Iterator[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """(pid, slot, ...) rows of each partition; report sees a partition's batches and gives at most a row per slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        yield report(batches).assign(pid=pid)

    return df.mapInPandas(run, f"{schema}, pid int")


def prefix_scan(reports: DataFrame, columns: list[str], backward: bool = False) -> DataFrame:
    """For each report the values of the nearest earlier (backward: later) report of its slot that has any.

    ``there`` says whether a report has values. Blocks of BLOCK partitions are scanned in parallel, then the blocks'
    totals, then both are combined: an exclusive scan.
    """
    value = F.when(F.col("there"), F.struct(*columns))
    at = F.col("pid").desc() if backward else F.col("pid").asc()
    block_at = F.col("block").desc() if backward else F.col("block").asc()
    r = reports.withColumn("block", F.floor(F.col("pid") / BLOCK)).withColumn("v", value)
    inside = Window.partitionBy("slot", "block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("mine", F.last("v", ignorenulls=True).over(inside))
    rank = F.max_by if not backward else F.min_by
    totals = r.filter("there").groupBy("slot", "block").agg(rank("v", "pid").alias("total"))
    every = r.select("slot", "block").distinct().join(totals, ["slot", "block"], "left")
    over = Window.partitionBy("slot").orderBy(block_at).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("outer", F.last("total", ignorenulls=True).over(over)).drop("total")
    both = r.join(carried, ["slot", "block"])
    return both.select("pid", "slot", F.coalesce("mine", "outer").alias("c")).filter("c is not null").select("pid", "slot", "c.*")


def share_carries(scanned: DataFrame) -> Broadcast:
    """The carries by (pid, slot), sent to each executor once: at most one row per partition and slot, whatever the number
    of records (at 100,000 partitions some tens of MB)."""
    carries = {(r["pid"], r["slot"]): r.asDict() for r in scanned.collect()}
    return scanned.sparkSession.sparkContext.broadcast(carries)
