"""Sinks: JSON lines, write-once run folders, and an append-only store of keyed records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import exists


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with columns in alphabetic order and instants as UTC with Z; an existing folder is an error."""
    stamps = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    out = df.withColumns(stamps) if stamps else df
    out.select(*sorted(out.columns)).write.mode("errorifexists").json(path)


def run_summary(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key with the number of its rows."""
    rest = [c for c in rows.columns if c not in keys + order]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.max(F.struct(*order, *rest)).alias("m")).select(*keys, "rows", "m.*")


def write_run(path: str, rows: DataFrame, issues: DataFrame, keys: list[str], order: list[str], at: str) -> dict:
    """Writes a run's rows, quality report and summary as JSON lines below path, and returns its manifest: counts of rows,
    errors and warnings, and the number of keys. A path that exists is an error."""
    counts = issues.groupBy("code", "severity").count()
    write_jsonl(rows, f"{path}/rows")
    write_jsonl(issues, f"{path}/quality_report")
    write_jsonl(run_summary(rows, keys, order), f"{path}/run_summary")
    by = {(r["code"], r["severity"]): r["count"] for r in counts.collect()}  # a row per code
    total = lambda kind: sum(n for (_, sev), n in by.items() if sev == kind)
    manifest = {"at": at, "rows": rows.count(), "keys": rows.select(*keys).distinct().count(), "errors": total("error"), "warnings": total("warning"), "codes": {c: n for (c, _), n in sorted(by.items())}}
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/run_manifest")
    return manifest


class ConflictError(ValueError):
    """A record under a known key with another content."""


class RecordStore:
    """Append-only Parquet table of (key, content_hash, body, batch): a key is written once.

    The same content again is no new record; another content under a known key raises, before anything is written.
    A batch written again under its number replaces its own rows.
    """

    SCHEMA = "key string, content_hash string, body string, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def append(self, records: DataFrame, batch: int) -> None:
        """records: key, body (canonical JSON)."""
        new = records.filter("key is not null").select("key", "body", F.sha2("body", 256).alias("content_hash"))
        clash = new.groupBy("key").agg(F.count_distinct("content_hash").alias("n")).filter("n > 1")
        known = self.table().filter(F.col("batch") != batch).select("key", F.col("content_hash").alias("old"))
        met = new.join(known, "key", "left")
        bad = met.filter("old is not null and old <> content_hash").select("key").unionByName(clash.select("key")).limit(5).collect()
        if bad:
            raise ConflictError(f"another content under {[r['key'] for r in bad]}")
        fresh = met.filter("old is null").drop("old").dropDuplicates(["key"]).withColumn("batch", F.lit(batch).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)
