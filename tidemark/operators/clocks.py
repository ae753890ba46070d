"""One UTC instant per clock text, through a dictionary of the distinct texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clocktext import clock_instant, clock_instants
from tidemark.session import scratch_path

#: Texts already in the one unambiguous form; read by Spark's own cast.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"
#: Feeds up to this many are broadcast; the zone table of a larger federation is joined by shuffle.
MAX_BROADCAST_FEEDS = 10_000


def with_zone(rows: DataFrame, feed_zones: DataFrame, feed: str = "feed") -> DataFrame:
    """Adds ``zone`` of each row's feed, in place of a column of that name; null for an unknown feed. A feed listed twice
    takes its greatest zone name."""
    zones = feed_zones.groupBy(F.col("feed").alias("_feed")).agg(F.max("zone").alias("zone"))
    small = feed_zones.limit(MAX_BROADCAST_FEEDS + 1).count() <= MAX_BROADCAST_FEEDS
    return rows.drop("zone", "_feed").join(F.broadcast(zones) if small else zones, F.col(feed) == F.col("_feed"), "left").drop("_feed")


def may_denote(text: Column) -> Column:
    """False for texts too short or without the digits that any reading needs (``pending``, ``n/a``, blanks)."""
    return text.isNotNull() & (F.length(text) >= 10) & text.rlike("[0-9]")


class ClockDictionary:
    """Distinct (text, feed, zone) with the instants they denote, as a Parquet table of batches.

    ``extend(rows, batch)`` reduces the batch to its distinct texts (map-side combine), drops those that other batches
    stored and parses each of the rest once; a batch that is given again replaces its own entries. ``table()`` has one
    row per key, also where two writers stored the same text at once. Texts that denote nothing are stored too, so they
    aren't parsed again.
    """

    KEY = ["text", "feed", "zone"]
    SCHEMA = "text string, feed string, zone string, early long, late long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def table(self) -> DataFrame:
        # what a text denotes follows from its key alone, so entries of one key are equal
        return self._entries().groupBy(*self.KEY).agg(F.max("early").alias("early"), F.max("late").alias("late"))

    def exists(self) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)

    def extend(self, rows: DataFrame, batch: int = 0) -> None:
        new = rows.select(*self.KEY).distinct()
        if self.exists():
            new = _minus(new, self._entries().filter(F.col("batch") != batch).select(*self.KEY), self.KEY)
        read = new.withColumn("i", clock_instants(F.col("text"), F.col("zone")))
        read.select(*self.KEY, "i.early", "i.late").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def _minus(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    # texts are never null here; equality on them is what the join is hashed on
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}") == F.col(f"s.{k}") if k == "text" else F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return new.alias("n").join(stored.alias("s"), same, "left_anti")


def _readable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in canonical form and other rows that may denote an instant."""
    plain = F.col("text").rlike(CANONICAL)
    some = rows.filter(may_denote(F.col("text")))
    return some.filter(plain), some.filter(~plain)


def normalise(rows: DataFrame, dictionary: ClockDictionary, keep: list[str], batches: list[DataFrame] | None = None) -> DataFrame:
    """(keep..., utc_us) of every row whose text denotes an instant.

    rows: text, feed, zone, first_seen_us and the columns to keep. Null texts and texts that denote nothing give no row.
    Texts in canonical form are read by Spark's cast; all others go through the dictionary: distinct, parsed once,
    stored, joined back. batches: the parts of rows in the order in which the dictionary meets them (by default all at
    once); each adds the texts that no earlier one had. What a local time that occurs twice means depends on the row, so
    the dictionary holds both instants and the join picks. A text that a third of all rows share is one dictionary row;
    on the rows' side Spark's adaptive skew join splits it.
    """
    cast, other = _readable(rows)
    for k, part in enumerate(batches or [rows]):
        dictionary.extend(_readable(part)[1], k)
    cast = cast.withColumn("utc_us", F.expr("unix_micros(try_cast(text as timestamp))")).filter("utc_us is not null")
    entries = dictionary.table().filter("early is not null").withColumnsRenamed({"text": "_t", "feed": "_f", "zone": "_z"})
    same = (F.col("text") == F.col("_t")) & F.col("feed").eqNullSafe(F.col("_f")) & F.col("zone").eqNullSafe(F.col("_z"))
    joined = other.join(entries, same)
    late = F.col("late").isNotNull() & (F.col("late") <= F.col("first_seen_us"))
    return cast.select(*keep, "utc_us").unionByName(joined.select(*keep, F.when(late, F.col("late")).otherwise(F.col("early")).alias("utc_us")))


#: table: (record key, feed column, text column)
CLOCK_TEXTS = {
    "raw_source_items": ("delivery_id", "provider", "source_timestamp"),
    "market_observations": ("observation_id", "feed", "source_timestamp"),
    "source_documents": ("document_id", "provider", "accepted_at"),
}


def clock_rows(tables: dict[str, DataFrame], feed_zones: DataFrame) -> dict[str, DataFrame]:
    """The clock texts of each table as (record_table, record_key, feed, zone, text, first_seen_us)."""
    parts = {}
    for name, (key, feed, text) in CLOCK_TEXTS.items():
        rows = tables[name].select(
            F.lit(name).alias("record_table"),
            F.col(key).cast("string").alias("record_key"),
            F.col(feed).alias("feed"),
            F.col(text).alias("text"),
            F.unix_micros("first_seen_at").alias("first_seen_us"),
        )
        parts[name] = with_zone(rows, feed_zones)
    return parts


def records_to_normalise(tables: dict[str, DataFrame], feed_zones: DataFrame, dictionary: str | None = None) -> DataFrame:
    """(record_table, record_key, utc_us) of every record whose text denotes an instant and isn't canonical already.

    One row per record; of copies that differ the earliest instant holds. dictionary: folder of the dictionary, which
    later calls go on with; by default one of its own in the shared folder. Each table is a batch: it adds the texts the
    tables before it didn't have.
    """
    spark = feed_zones.sparkSession
    parts = [r.filter(~F.col("text").rlike(CANONICAL)) for r in clock_rows(tables, feed_zones).values()]
    store = ClockDictionary(spark, dictionary or scratch_path(spark, "clock-dictionary"))
    keys = ["record_table", "record_key"]
    return normalise(reduce(DataFrame.unionByName, parts), store, keys, parts).groupBy(*keys).agg(F.min("utc_us").alias("utc_us"))


def observation_instants(observations: DataFrame, feed_zones: DataFrame, text: str = "source_timestamp") -> DataFrame:
    """observations with ``utc_us``, the instant of each row's clock text; null where it denotes none."""
    zoned = with_zone(observations, feed_zones)
    plain = F.col(text).rlike(CANONICAL)
    read = clock_instant(F.when(~plain & may_denote(F.col(text)), F.col(text)), F.col("zone"), F.unix_micros("first_seen_at"))
    return zoned.withColumn("utc_us", F.when(plain, F.expr(f"unix_micros(try_cast({text} as timestamp))")).otherwise(read)).drop("zone")
