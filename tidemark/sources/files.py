"""File sources: directories of CSV and JSON-lines files with strict typing, and their composition."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import schemas as S


@dataclass(frozen=True)
class Dataset:
    """Named tables with the manifest they came with."""

    tables: dict[str, DataFrame]
    manifest: dict = field(default_factory=dict)


class SourceError(ValueError):
    """A source that lacks a file or key, or holds a value that can't be read."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_manifest(spark: SparkSession, root: str, required: tuple[str, ...]) -> dict:
    if not exists(spark, f"{root}/metadata.json"):
        raise SourceError(f"no metadata.json in {root}")
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/metadata.json", wholetext=True).collect())  # one small file
    manifest = json.loads(text)
    lost = [k for k in required if k not in manifest]
    if lost:
        raise SourceError(f"metadata.json lacks {lost}")
    return manifest


def strict_timestamp(text: Column, name: str) -> Column:
    """UTC instant of a text with an explicit offset; blank is null, anything else raises."""
    t = F.nullif(F.trim(text), F.lit(""))
    ok = t.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    at = F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"))
    return F.when(t.isNull(), None).when(ok & at.isNotNull(), at).otherwise(F.raise_error(F.concat(F.lit(f"{name}: no instant with an offset: "), t)))


def typed(text: Column, kind: T.DataType, name: str) -> Column:
    """A text column as its type: blanks are null, words of TRUE_WORDS true, values that can't be read raise."""
    t = F.nullif(F.trim(text), F.lit(""))
    if isinstance(kind, T.TimestampType):
        return strict_timestamp(text, name)
    if isinstance(kind, T.BooleanType):
        return F.lower(t).isin(*S.TRUE_WORDS)
    if isinstance(kind, T.StringType):
        return t
    return F.when(t.isNull(), None).otherwise(F.coalesce(t.try_cast(kind), F.raise_error(F.concat(F.lit(f"{name}: not a {kind.simpleString()}: "), t)).cast(kind)))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """A CSV file with header, columns by name. Extra columns are ignored, missing optional files are empty tables."""
    if not exists(spark, path):
        if optional:
            return spark.createDataFrame([], schema)
        raise SourceError(f"no {path}")
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    cols = [typed(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return raw.select(*cols)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """A file of JSON lines; blank lines are skipped, a line that is no object of the schema raises."""
    if not exists(spark, path):
        if optional:
            return spark.createDataFrame([], schema)
        raise SourceError(f"no {path}")
    stamps = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in stamps else f.dataType) for f in schema.fields])
    raw = spark.read.schema(texts).option("mode", "FAILFAST").json(path)
    return raw.withColumns({c: strict_timestamp(F.col(c), c) for c in stamps}) if stamps else raw


def market_directory(spark: SparkSession, root: str) -> Dataset:
    """Instruments and bars of one and the other timeframe; actions and halts if there are any."""
    manifest = read_manifest(spark, root, ("provider", "dataset_kind", "retrieved_at", "minute_dates"))
    bars = [read_csv(spark, f"{root}/bars_{t}.csv", S.BAR).withColumn("timeframe", F.lit(t)) for t in ("1m", "1d")]
    return Dataset(
        {
            "instruments": read_csv(spark, f"{root}/instruments.csv", S.INSTRUMENT),
            "bars": reduce(DataFrame.unionByName, bars),
            "corporate_actions": read_csv(spark, f"{root}/corporate_actions.csv", S.ACTION, optional=True),
            "halts": read_csv(spark, f"{root}/halts.csv", S.HALT, optional=True),
        },
        manifest,
    )


def document_directory(spark: SparkSession, root: str) -> Dataset:
    manifest = read_manifest(spark, root, ("provider", "dataset_kind", "fetched_at"))
    return Dataset({"documents": read_jsonl(spark, f"{root}/documents.jsonl", S.DOCUMENT)}, manifest)


def mention_directory(spark: SparkSession, root: str) -> Dataset:
    """Mentions with the monitored securities and the sources' descriptors of the manifest; catalysts and price context if
    there are any."""
    manifest = read_manifest(spark, root, ("provider", "dataset_kind", "fetched_at", "monitored_securities", "sources"))
    securities = [(s["security_id"], s["ticker"]) for s in manifest["monitored_securities"]]
    rows = [tuple(None if d.get(f.name) is None else str(d[f.name]) for f in S.DESCRIPTOR.fields) for d in manifest["sources"]]
    texts = spark.createDataFrame(rows, T.StructType([T.StructField(f.name, T.StringType()) for f in S.DESCRIPTOR.fields]))
    return Dataset(
        {
            "mentions": read_jsonl(spark, f"{root}/mentions.jsonl", S.MENTION),
            "catalysts": read_jsonl(spark, f"{root}/catalysts.jsonl", S.CATALYST, optional=True),
            "price_context": read_jsonl(spark, f"{root}/price_context.jsonl", S.PRICE_CONTEXT, optional=True),
            "securities": spark.createDataFrame(securities, "security_id string, ticker string"),
            "descriptors": texts.select(*[typed(F.col(f.name), f.dataType, f.name).alias(f.name) for f in S.DESCRIPTOR.fields]),
        },
        manifest,
    )


def broken_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, text) of lines that are no object of the schema, for the message after a read has failed: lines are
    numbered within their file, which is read whole for it."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split("value", "\n").alias("lines"))
    each = whole.select("file", F.posexplode("lines").alias("line", "text")).filter(F.trim("text") != "")
    texts = T.StructType([*[T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema.fields], T.StructField("_bad", T.StringType())])
    parsed = each.withColumn("p", F.from_json("text", texts, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    return parsed.filter(F.col("p._bad").isNotNull()).select("file", (F.col("line") + 1).alias("line"), "text")


def model_directory(spark: SparkSession, root: str) -> Dataset:
    manifest = read_manifest(spark, root, ("provider", "dataset_kind", "feature_names"))
    return Dataset({"rows": read_jsonl(spark, f"{root}/rows.jsonl", S.MODEL_ROW)}, manifest)


def composite(sets: list[Dataset]) -> Dataset:
    """Tables of several sources one after another; the latest fetch, provider names joined, notes in order."""
    if not sets:
        raise SourceError("no source")
    names = dict.fromkeys(n for s in sets for n in s.tables)
    tables = {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.tables[n] for s in sets if n in s.tables]) for n in names}
    names = [str(s.manifest.get("provider", "")) for s in sets]
    return Dataset(tables, replace(sets[0]).manifest | {"provider": "+".join(names), "dataset_kind": "composite:" + "+".join(names), "fetched_at": max(str(s.manifest.get("fetched_at", "")) for s in sets), "notes": [x for s in sets for x in s.manifest.get("notes", [])]})
