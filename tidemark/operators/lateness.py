"""Per-period aggregates by event time, corrected as late records arrive, until a cut-off."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
CUT_OFF_HOURS = 48


def arrivals(documents: DataFrame) -> DataFrame:
    """(document_id, ticker, period_day, published_us, known_us): a document is known at available_at, or first_seen_at
    where that is null. Rows without published_at, either time or document_id don't count."""
    known = F.coalesce("available_at", "first_seen_at")
    return documents.select(
        "document_id",
        "ticker",
        F.to_date("published_at").alias("period_day"),
        F.unix_micros("published_at").alias("published_us"),
        F.unix_micros(known).alias("known_us"),
    ).filter("document_id is not null and period_day is not null and known_us is not null")


def _close() -> Column:
    return (F.unix_date("period_day").cast("long") + 1) * (24 * HOUR_US)


def in_time(cut_off_hours: int) -> Column:
    """Whether a row was known by the cut-off of its period."""
    return F.col("known_us") <= _close() + cut_off_hours * HOUR_US


def first_known(events: DataFrame) -> DataFrame:
    """One row per document: that of its earliest known time, then the earliest publication, then the smallest ticker.
    Combines on the map side, so a document fetched very often is no one task's."""
    one = events.groupBy("document_id").agg(F.min(F.struct("known_us", "published_us", "ticker", "period_day")).alias("m"))
    return one.select("document_id", "m.*")


def period_counts(events: DataFrame, cut_off_hours: int = CUT_OFF_HOURS) -> DataFrame:
    """(ticker, period_day, docs_at_close, docs_final, docs_dropped) of raw events; see first_known."""
    late = ~in_time(cut_off_hours)
    return first_known(events).groupBy("ticker", "period_day").agg(
        F.count_if(F.col("known_us") <= _close()).alias("docs_at_close"), F.count_if(~late).alias("docs_final"), F.count_if(late).alias("docs_dropped")
    )


class PeriodStore:
    """Retained raw events and the counts of each period, as Parquet tables in a shared folder.

    ``apply(batch, number)`` adds the batch to the raw events, finds the days it touches, recomputes those days entirely
    from the raw events and publishes them together. A document counts once, whichever batches its rows came in and in
    whatever order: a batch also touches the days on which its documents are already stored.

    A day has two files of counts. *final* (docs_at_close, docs_final) is rewritten only by rows known by the day's
    cut-off; what was known later goes into *dropped* (docs_dropped), so past the cut-off a day's final file stays as it
    is. Files aren't changed: a commit writes new ones, and then a manifest that names for each day and kind the commit
    that holds and for each batch the attempt that holds. Readers follow the latest complete manifest, so they see all
    of a commit or nothing of it. A batch applied again under its number replaces its rows and touches the days of both.

    A batch and a commit are folders of a few files each, sorted by day, so that days are found by the files' statistics;
    the manifest has a row per batch and two per calendar day. ``compact()`` makes one batch and one commit of all.
    """

    RAW = "document_id string, ticker string, period_day date, published_us long, known_us long"
    AGG = "ticker string, period_day date, docs_at_close long, docs_final long, docs_dropped long"
    MANIFEST = "kind string, key string, value string"

    def __init__(self, spark: SparkSession, path: str, cut_off_hours: int = CUT_OFF_HOURS):
        self.spark, self.path, self.cut_off_hours = spark, path.rstrip("/"), cut_off_hours

    def _manifest(self) -> tuple[int, dict[tuple[str, str], str]]:
        """Number and entries of the latest complete manifest; (0, {}) before the first."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [int(p.getName()) for p in folders if fs.exists(hadoop(p, "_SUCCESS"))]
        if not done:
            return 0, {}
        # a row per batch and two per calendar day
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/{max(done)}").collect()
        return max(done), {(r["kind"], r["key"]): r["value"] for r in rows}

    def _publish(self, number: int, entries: dict[tuple[str, str], str]) -> None:
        rows = [(kind, key, value) for (kind, key), value in sorted(entries.items())]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")

    def _raw(self, entries: dict[tuple[str, str], str], but: str | None = None) -> DataFrame:
        """Raw events of all batches but one."""
        paths = [f"{self.path}/raw/{value}" for (kind, key), value in entries.items() if kind == "batch" and key != but]
        return self.spark.read.schema(self.RAW).parquet(*paths) if paths else self.spark.createDataFrame([], self.RAW)

    def _days(self, days: set[str] | dict[str, set[str]]) -> DataFrame:
        """Days, or kinds and days, as a table: a row or two per calendar day."""
        if isinstance(days, set):
            return F.broadcast(self.spark.createDataFrame([(d,) for d in sorted(days)], "d string").select(F.to_date("d").alias("period_day")))
        rows = [(kind, d) for kind, some in days.items() for d in sorted(some)]
        return F.broadcast(self.spark.createDataFrame(rows, "kind string, d string").select("kind", F.to_date("d").alias("period_day")))

    def counts(self) -> DataFrame:
        """Counts of all periods as of the latest commit."""
        _, entries = self._manifest()
        commits = sorted({v for (kind, _), v in entries.items() if kind in ("final", "dropped")})
        if not commits:
            return self.spark.createDataFrame([], self.AGG)
        # two rows per calendar day
        valid = self.spark.createDataFrame([(kind, key, value) for (kind, key), value in entries.items() if kind != "batch"], "kind string, d string, commit string")
        valid = valid.select("kind", F.to_date("d").alias("period_day"), F.col("commit").cast("long"))
        parts = self.spark.read.option("basePath", f"{self.path}/agg").schema(f"{self.AGG}, kind string, commit long").parquet(*[f"{self.path}/agg/commit={c}" for c in commits])
        whole = parts.join(F.broadcast(valid), ["kind", "period_day", "commit"], "left_semi").groupBy("ticker", "period_day")
        out = whole.agg(*[F.sum(c).alias(c) for c in ("docs_at_close", "docs_final", "docs_dropped")])
        return out.filter("docs_final > 0 or docs_dropped > 0")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Applies a batch of arrivals (see arrivals)."""
        last, entries = self._manifest()
        attempt = f"{number}-{uuid.uuid4().hex}"
        batch.select("document_id", "ticker", "period_day", "published_us", "known_us").sortWithinPartitions("period_day").write.parquet(f"{self.path}/raw/{attempt}")
        fresh = self.spark.read.schema(self.RAW).parquet(f"{self.path}/raw/{attempt}")
        was = entries.get(("batch", str(number)))
        ours = fresh.unionByName(self.spark.read.schema(self.RAW).parquet(f"{self.path}/raw/{was}")) if was else fresh
        others = self._raw(entries, str(number))
        met = others.join(ours.select("document_id").distinct(), "document_id", "left_semi")
        # documents published on several days: looked up on all days whenever one of these is recomputed
        several = ours.unionByName(met).groupBy("document_id").agg(F.min("period_day").alias("a"), F.max("period_day").alias("z")).filter("a <> z")
        several.select("document_id").write.parquet(f"{self.path}/strays/{attempt}")
        strays = self.spark.read.schema("document_id string").parquet(f"{self.path}/strays/{attempt}")
        # days of the batch, and stored days of its documents whose counts may move: late rows, which one in time replaces,
        # and all rows of documents on several days. A late row of a document that was known in time touches no final file
        met = met.withColumn("t", in_time(self.cut_off_hours))
        moved = met.filter(~F.col("t")).unionByName(met.join(strays, "document_id", "left_semi"))
        touched = ours.withColumn("t", in_time(self.cut_off_hours)).unionByName(moved).select(F.col("period_day").cast("string").alias("d"), "t").distinct()
        sides = touched.collect()  # two rows per calendar day
        days = {"final": {r["d"] for r in sides if r["t"]}, "dropped": {r["d"] for r in sides if not r["t"]}}
        entries = entries | {("batch", str(number)): attempt}
        if any(days.values()):
            self._recompute(entries, days, last + 1)
            entries |= {(kind, d): str(last + 1) for kind, some in days.items() for d in some}
        self._publish(last + 1, entries)

    def _recompute(self, entries: dict[tuple[str, str], str], days: dict[str, set[str]], commit: int) -> None:
        """Counts of the given days from all their raw events, and from the other rows of documents that were published
        on several days."""
        raw, every = self._raw(entries), self._days(days["final"] | days["dropped"])
        rows = raw.join(every, "period_day", "left_semi")
        strays = self.spark.read.schema("document_id string").parquet(*[f"{self.path}/strays/{v}" for (kind, _), v in entries.items() if kind == "batch"])
        if not strays.isEmpty():
            rows = rows.unionByName(raw.join(every, "period_day", "left_anti").join(strays.distinct(), "document_id", "left_semi"))
        counted = period_counts(rows, self.cut_off_hours)
        # a day's row goes to the file of each kind the batch touched, with that kind's counts
        kinds = F.array(*[F.lit(k) for k in days])
        each = counted.select("*", F.explode(kinds).alias("kind")).join(self._days(days), ["kind", "period_day"], "left_semi")
        only = lambda c, kind: F.when(F.col("kind") == kind, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
        out = each.select("ticker", "period_day", only("docs_at_close", "final"), only("docs_final", "final"), only("docs_dropped", "dropped"), "kind")
        out = out.filter("docs_final > 0 or docs_dropped > 0").sortWithinPartitions("kind", "period_day")
        out.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/agg/commit={commit}")

    def compact(self) -> None:
        """Makes one batch, number 0, of all raw events and one commit of all counts; the folders before it may be deleted
        once no reader follows an earlier manifest."""
        last, entries = self._manifest()
        if entries:
            attempt = f"0-{uuid.uuid4().hex}"
            self._raw(entries).repartitionByRange("period_day").sortWithinPartitions("period_day").write.parquet(f"{self.path}/raw/{attempt}")
            strays = self.spark.read.schema("document_id string").parquet(*[f"{self.path}/strays/{v}" for (kind, _), v in entries.items() if kind == "batch"])
            strays.distinct().write.parquet(f"{self.path}/strays/{attempt}")
            days = {kind: {d for k, d in entries if k == kind} for kind in ("final", "dropped")}
            entries = {("batch", "0"): attempt}
            self._recompute(entries, days, last + 1)
            self._publish(last + 1, entries | {(kind, d): str(last + 1) for kind, some in days.items() for d in some})


def corrected_periods(counts: DataFrame) -> DataFrame:
    """Tickers and days that late documents corrected or came too late for; period_day as yyyy-MM-dd."""
    late = counts.filter("docs_final > docs_at_close or docs_dropped > 0")
    return late.select("ticker", F.date_format("period_day", "yyyy-MM-dd").alias("period_day"), "docs_at_close", "docs_final", "docs_dropped")
