"""Polled snapshots of the market as observations, joined with halts and gathered with other sources in one cycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "map<string, struct<minuteBar: struct<t: string, c: double, v: bigint>, latestQuote: struct<t: string, bp: double, ap: double>>>"


def _flags(**conditions: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in conditions.items()])))


def snapshots(raw: DataFrame, securities: DataFrame, feed: str, delayed: bool = False) -> DataFrame:
    """Observations of polled payloads: one per security and poll, with the flags of what is missing.

    raw: payload (JSON by ticker, see PAYLOAD), received_at. A ticker the payload lacks gives an observation without
    values; a bar is complete once its minute is over at the poll; only the sip feed covers all exchanges. Observations
    have no halt status and no float yet.
    """
    p = raw.withColumn("p", F.from_json("payload", PAYLOAD))
    s = securities.select("security_id", F.upper("ticker").alias("ticker"))
    x = p.join(F.broadcast(s.limit(100_001)), how="cross") if s.limit(100_001).count() <= 100_000 else p.join(s, how="cross")
    b, q = F.col("p")[F.col("ticker")]["minuteBar"], F.col("p")[F.col("ticker")]["latestQuote"]
    at = F.coalesce(F.try_to_timestamp(b["t"]), F.col("received_at"))
    x = x.select("security_id", "ticker", "received_at", b.alias("b"), q.alias("q"), at.alias("source_timestamp"))
    complete = F.col("b").isNotNull() & (F.col("received_at") >= F.col("source_timestamp") + F.expr("interval 1 minute"))
    flags = _flags(
        MISSING_BAR=F.col("b").isNull(), INCOMPLETE_BAR=F.col("b").isNotNull() & ~complete, MISSING_QUOTES=F.col("q").isNull(), NON_CONSOLIDATED_COVERAGE=F.lit(feed != "sip"),
        DELAYED_COVERAGE=F.lit(delayed), MISSING_HALT_STATUS=F.lit(True), MISSING_FLOAT=F.lit(True),
    )
    ident = F.sha2(F.concat_ws("|", F.lit(feed), "ticker", F.unix_micros("source_timestamp").cast("string")), 256)
    return x.select(
        ident.alias("observation_id"), "security_id", "ticker", "source_timestamp", F.col("received_at").alias("first_seen_at"), F.lit(feed).alias("feed"), complete.alias("bar_complete"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"),
        F.col("q.bp").alias("bid"), F.col("q.ap").alias("ask"), F.lit(feed == "sip").alias("consolidated_coverage"), F.lit(None).cast("string").alias("halt_status"), F.lit(None).cast("long").alias("free_float"), flags.alias("missing_flags"),
    )


def with_halt_status(observations: DataFrame, halts: DataFrame | None, current: bool, now_us: int) -> DataFrame:
    """observations with halt_status and its flag, as far as halts are covered.

    Without a halt source (None) nothing changes; a source that is stale (not current) says nothing: the status is null and
    flagged. Else it is that of the ticker's latest halt that had begun: halted until trading resumes.
    """
    if halts is None:
        return observations
    flag = F.lit("MISSING_HALT_STATUS")
    if not current:
        return observations.withColumns({"halt_status": F.lit(None).cast("string"), "missing_flags": F.array_sort(F.array_union("missing_flags", F.array(flag)))})
    begun = halts.filter((F.unix_micros("halt_at") <= now_us) & F.col("ticker").isNotNull())
    last = begun.groupBy("ticker").agg(F.max(F.struct(F.unix_micros("halt_at").alias("a"), F.unix_micros("first_seen_at").alias("s"), F.unix_micros("resumption_trade_at").alias("z"))).alias("_h"))
    j = observations.join(last, "ticker", "left")
    halted = F.col("_h").isNotNull() & (F.col("_h.z").isNull() | (F.col("_h.z") > now_us))
    return j.withColumns({"halt_status": F.when(halted, "halted").otherwise("not_halted"), "missing_flags": F.array_remove("missing_flags", "MISSING_HALT_STATUS")}).drop("_h").select(*observations.columns)


def alert_context(events: DataFrame, observations: DataFrame, features: DataFrame) -> DataFrame:
    """events with the observation and feature of their ticker in the cycle: security_id (``unresolved:`` and the ticker
    where there is no observation), reference_price, feature_id and flags (MISSING_MARKET_OBSERVATION).

    observations and features have one row per ticker in a cycle; features: ticker, feature_id, flags (null: none).
    """
    o = observations.select("ticker", "security_id", F.col("close").alias("reference_price"))
    j = events.join(o, "ticker", "left").join(features.select("ticker", "feature_id", F.col("flags").alias("_flags")), "ticker", "left")
    none = F.array().cast("array<string>")
    flags = F.when(F.col("security_id").isNull(), F.array(F.lit("MISSING_MARKET_OBSERVATION"))).otherwise(F.coalesce("_flags", none))
    return j.withColumns({"security_id": F.coalesce("security_id", F.concat(F.lit("unresolved:"), "ticker")), "flags": flags}).drop("_flags")


def one_cycle(sources: dict[str, DataFrame]) -> DataFrame:
    """(source_family, record) rows of several sources, batch or streaming, one after another; each source's columns become
    one JSON record."""
    if not sources:
        raise ValueError("no source")
    parts = [df.select(F.lit(family).alias("source_family"), F.to_json(F.struct("*")).alias("record")) for family, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def watermarks(items: DataFrame, at: str) -> DataFrame:
    """(source_family, watermark): the latest time of each family's items."""
    return items.groupBy("source_family").agg(F.max(at).alias("watermark"))
