"""Messages delivered at least once: one delivery is kept per message."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.jsoncanon import json_digest
from tidemark.session import scratch_path, stored

#: Deliveries are of one message if these are equal.
MESSAGE = ["source_family", "source_id", "message_digest"]


def identify(deliveries: DataFrame) -> DataFrame:
    """Adds the message identity: (source_family, source_id, digest of the payload's JSON value).

    Rows without source_id belong to no message and are left out. A null payload equals a null payload.
    """
    return (
        deliveries.filter(F.col("source_id").isNotNull())
        .select("delivery_id", "source_family", "source_id", F.unix_micros("first_seen_at").alias("first_seen_us"), "payload")
        .withColumn("message_digest", json_digest("payload"))
        .drop("payload")
    )


def keep_first(identified: DataFrame, seen: str = "first_seen_us", ident: str = "delivery_id") -> DataFrame:
    """Ranks the deliveries of each message by arrival (null last), then delivery_id, and keeps the first.

    The filter on row_number lets Spark keep one row per message and map task before the shuffle (WindowGroupLimit),
    so a message that holds a third of all rows sends a handful of rows to its reducer.
    """
    w = Window.partitionBy(*MESSAGE).orderBy(F.col(seen).asc_nulls_last(), F.col(ident).asc())
    return identified.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


class DeliveryLedger:
    """The delivery kept of every message so far, as a Parquet table of batches.

    ``accept(batch, number)`` digests each payload once (a written table), ranks the batch within itself, and joins its
    first deliveries with the stored identifiers: those of unknown messages are appended, and so are those that arrived
    before the stored one (a batch may come late). It returns the repeats the batch brings to light: its deliveries that
    aren't kept, and stored ones that no longer are. Over all batches, in whatever order, each delivery that isn't kept
    comes out exactly once. Rows without source_id belong to no message; exact copies of one delivery row (same
    delivery_id) are that delivery. A batch accepted again under its number replaces its own entries; batches accepted
    after it aren't revised, so replay the last one.

    A stored identifier is a row of three key columns; of a batch that is small Spark broadcasts the new keys, so the
    table is scanned but not shuffled. ``compact()`` leaves one entry a message.
    """

    SCHEMA = "source_family string, source_id string, message_digest binary, first_seen_us long, delivery_id long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def kept(self) -> DataFrame:
        """One entry per message: the delivery kept."""
        return keep_first(self._entries()).drop("batch")

    def accept(self, batch: DataFrame, number: int) -> DataFrame:
        every = stored(identify(batch), "deliveries")
        first = keep_first(every)
        known = self._entries().filter(F.col("batch") != number)
        same = reduce(and_, [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in MESSAGE])
        met = first.alias("n").join(known.alias("k"), same, "left").select(*[f"n.{c}" for c in first.columns], F.col("k.first_seen_us").alias("old_us"), F.col("k.delivery_id").alias("old_id"))
        # a message that several batches improved has several entries: the best of them counts
        met = stored(keep_first(met, "old_us", "old_id"), "met")
        far = F.lit((1 << 63) - 1)
        better = F.col("old_id").isNull() | (F.struct(F.coalesce("first_seen_us", far), F.col("delivery_id")) < F.struct(F.coalesce("old_us", far), F.col("old_id")))
        met.filter(better).select(*MESSAGE, "first_seen_us", "delivery_id").write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        stays = met.filter(better | (F.col("delivery_id") == F.col("old_id"))).select("delivery_id")
        displaced = met.filter(better & F.col("old_id").isNotNull()).select(F.col("old_id").alias("delivery_id"))
        return every.select("delivery_id").join(stays, "delivery_id", "left_anti").unionByName(displaced).distinct()

    def compact(self, number: int) -> None:
        """Rewrites the entries as batch number (one that isn't in use) and drops the others."""
        whole = stored(self.kept(), "ledger")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(fs_path(self.path)) if s.getPath().getName() != f"batch={number}"]
        whole.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        for p in old:
            fs.delete(p, True)


def repeated_deliveries(deliveries: DataFrame, waves: list[DataFrame] | None = None) -> DataFrame:
    """delivery_id of every delivery with a source_id that isn't the one kept, found wave by wave through a ledger.

    waves: the parts of deliveries in the order in which they came (by default one). Empty input gives no rows.
    """
    spark = deliveries.sparkSession
    ledger = DeliveryLedger(spark, scratch_path(spark, "ledger"))
    found = [ledger.accept(w, k) for k, w in enumerate(waves or [deliveries])]
    return reduce(DataFrame.unionByName, found).distinct()  # a copy of a delivery may come in a later wave
