"""Reusable kernels: as-of lookups, islands, first of duplicates, and row numbers without one hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key the row greatest in order, then in columns: a hash aggregate that combines on the map side."""
    rest = [c for c in columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(*keys, *[f"_m.{c}" for c in [*order, *rest]])


def asof_last(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], bucket: int) -> DataFrame:
    """left with the values of the right row latest in time at or before it, per key; null where there is none.

    Union, sort and the last known values carried forward: no join, whatever the ratio of the sides. A key is cut into
    buckets of time, each begun by what was last known before it (found over one row per key and bucket), so a key that
    holds a third of all rows is many tasks' work. Times are whole numbers. Of right rows of one instant the greatest
    values hold; rows of right without a time are never known, rows of left without one know nothing.
    """
    clash = [c for c in values if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    cell = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    r = right.filter(F.col(right_at).isNotNull()).select(*by, F.col(right_at).cast("long").alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_v")).withColumn("_b", cell("_at"))
    kind = r.schema["_v"].dataType
    l = left.withColumns({"_at": F.col(left_at).cast("long"), "_side": F.lit(1), "_v": F.lit(None).cast(kind)}).withColumn("_b", cell("_at"))  # noqa: E741
    ends = r.groupBy(*by, "_b").agg(F.max(F.struct("_at", "_v")).alias("_m"))
    cells = ends.unionByName(l.select(*by, "_b").distinct(), allowMissingColumns=True).groupBy(*by, "_b").agg(F.max("_m").alias("_m"))
    over = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("_c", F.last("_m", ignorenulls=True).over(over)).filter("_c is not null and _b is not null")
    start = carried.select(*by, "_c._at", F.lit(0).alias("_side"), "_c._v", "_b")
    both = l.unionByName(r.unionByName(start), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_b").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in values])


def previous_row(df: DataFrame, by: list[str], at: str, tie: str, values: list[str], bucket: int, prefix: str = "prev_") -> DataFrame:
    """df with the values of the row before each in (at, tie) of its key, as prefix + name; null for a key's first row.

    A key is cut into buckets of time, each begun by the last row of the buckets before it (one row per key and bucket),
    so a key that holds a third of all rows is many tasks' work. Rows without a time have no row before them and are
    before none; (at, tie) must be unique per key.
    """
    b = df.withColumn("_b", F.floor(F.col(at) / F.lit(bucket)).cast("long"))
    row = F.struct(at, tie, *values)
    ends = b.filter(F.col(at).isNotNull()).groupBy(*by, "_b").agg(F.max(row).alias("_m"))
    over = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_c", F.last("_m").over(over)).select(*by, "_b", "_c")
    w = Window.partitionBy(*by, "_b").orderBy(at, tie)
    inside = b.withColumn("_p", F.when(F.col(at).isNotNull(), F.lag(row).over(w)))
    out = inside.join(carried, [*by, "_b"], "left").withColumn("_p", F.coalesce("_p", "_c"))
    return out.select(*df.columns, *[F.col(f"_p.{c}").alias(prefix + c) for c in dict.fromkeys([at, *values])])


def numbered(df: DataFrame, by: list[str], at: str, order: list[Column], bucket: int, name: str = "position") -> DataFrame:
    """df with the number from 1 of each row in its key's order, which begins with at (a whole number, not null).

    A key is cut into buckets of time that are numbered on their own; the rows before each are a running count over one
    row per key and bucket.
    """
    b = df.withColumn("_b", F.floor(F.col(at) / F.lit(bucket)).cast("long"))
    over = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = b.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(F.col(at), *order))
    return b.withColumn("_k", local).join(before, [*by, "_b"]).withColumn(name, F.col("_k") + F.col("_before")).drop("_b", "_k", "_before")


def islands(df: DataFrame, by: list[str], at: str, step: int) -> DataFrame:
    """(by..., first, last, n): runs of values that are exactly a step apart. Values must be distinct per key."""
    w = Window.partitionBy(*by).orderBy(at)
    runs = df.withColumn("_run", F.col(at) - F.row_number().over(w) * F.lit(step))
    return runs.groupBy(*by, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_run")


def repeats(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The second and later rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(w)).filter("occurrence > 1")


def global_row_numbers(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Row numbers from 1 in a total order, without sorting everything in one task.

    Range partitions are sorted and numbered locally; the rows before each partition are added from its count (a row
    per partition). Ties in order are numbered in no particular order: give a total one.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_p", F.spark_partition_id())
    sizes = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}  # a row per partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    start = df.sparkSession.createDataFrame(before, "_p int, _before long")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_n", local).join(F.broadcast(start), "_p").withColumn(name, F.col("_n") + F.col("_before")).drop("_p", "_n", "_before")


def running_totals(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with name, the sum of value up to and including each row in order, without sorting everything in one task:
    range partitions add up locally, what comes before each is added from its total (a row per partition)."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_p", F.spark_partition_id())
    sums = {r["_p"]: r["s"] for r in parts.groupBy("_p").agg(F.sum(value).alias("s")).collect()}
    before, total = [], 0
    for p in sorted(sums):
        before.append((p, total))
        total += sums[p]
    start = df.sparkSession.createDataFrame(before, "_p int, _before long")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_s", F.sum(value).over(w)).join(F.broadcast(start), "_p").withColumn(name, F.col("_s") + F.col("_before")).drop("_p", "_s", "_before")
