"""Provider records as domain rows: paged bars, halt feeds, columnar submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import US_EQUITY, SessionCalendar
from tidemark.sources.files import strict_timestamp


def normalise_bars(raw: DataFrame, securities: DataFrame, timeframe: str, calendar: SessionCalendar = US_EQUITY, source: str = "", source_url: str = "", feed: str = "", adjustment: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(bars, dropped) of provider bars: one-minute bars outside the sessions are dropped; an unknown symbol raises.
    See reconcile for the count of both against the pages."""
    s = securities.select("security_id", F.col("ticker").alias("symbol"))
    ts = strict_timestamp(F.col("t"), "t")
    x = raw.join(s, "symbol", "left").withColumn("timestamp", ts).withColumn("session", calendar.classify(F.col("timestamp")) if timeframe == "1m" else F.lit("regular"))
    known = F.when(F.col("security_id").isNull(), F.raise_error(F.concat(F.lit("unknown symbol "), F.col("symbol")))).otherwise(F.col("security_id"))
    x = x.withColumn("security_id", known).withColumn("kept", (F.lit(timeframe != "1m")) | (F.col("session") != "outside"))
    available = F.col("timestamp") + F.expr("interval 1 minute") if timeframe == "1m" else F.to_utc_timestamp(F.date_trunc("day", calendar.local(F.col("timestamp"))) + F.expr("interval 961 minutes"), calendar.zone)
    bars = x.filter("kept").select("security_id", "timestamp", F.lit(timeframe).alias("timeframe"), "session", F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"), available.alias("available_at"), F.col("vw").alias("vwap"), F.col("n").alias("trade_count"), F.lit(source).alias("source"), F.lit(source_url).alias("source_url"), F.lit(feed).alias("feed"), F.lit(adjustment).alias("adjustment"))
    return bars, x.filter(~F.col("kept"))


def reconcile(pages: int, written: DataFrame, dropped: DataFrame) -> DataFrame:
    """(raw, kept, dropped, reconciled): rows the pages had, as the reader counted them, against rows of the written table
    and dropped ones. They differ where rows were lost or doubled on the way."""
    kept, gone = written.agg(F.count("*").alias("kept")), dropped.agg(F.count("*").alias("dropped"))
    one = kept.crossJoin(gone).select(F.lit(pages).cast("long").alias("raw"), "kept", "dropped")  # one row each
    return one.withColumn("reconciled", F.col("raw") == F.col("kept") + F.col("dropped"))


def submissions(raw: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """(issuer_id, accession_number, form_type, first_public_at, available_at) of columnar submission payloads.

    raw: issuer_id, payload (JSON with parallel arrays), received_at. Arrays of different lengths are read to the
    shortest one's end; a document is available once it is public and received.
    """
    s = "struct<accessionNumber:array<string>,form:array<string>,acceptanceDateTime:array<string>>"
    p = raw.withColumn("p", F.from_json("payload", s))
    n = F.least(F.size("p.accessionNumber"), F.size("p.form"), F.size("p.acceptanceDateTime"))
    z = F.slice(F.arrays_zip("p.accessionNumber", "p.form", "p.acceptanceDateTime"), 1, F.greatest(F.lit(0), n))
    x = p.select("issuer_id", "received_at", F.explode(z).alias("d")).select("issuer_id", "received_at", F.col("d.accessionNumber").alias("accession_number"), F.col("d.form").alias("form_type"), F.try_to_timestamp("d.acceptanceDateTime").alias("first_public_at"))
    return x.filter(F.col("form_type").isin(*forms)).withColumn("available_at", F.greatest("first_public_at", "received_at")).drop("received_at")


def halt_feed(feed: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """(ticker, reason_code, halt_at, resumption_quote_at, resumption_trade_at, halt_id) of a halt feed's items.

    feed: one XML document a row in column ``xml``. Prefixes of names don't matter; items without symbol, date or time
    are skipped; clocks are exchange-local.
    """
    bare = F.regexp_replace(F.regexp_replace("xml", r"(</?)[A-Za-z0-9]+:", "$1"), r"\sxmlns(:[A-Za-z0-9]+)?=\"[^\"]*\"", "")
    item = F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)<item\b.*?</item>"), F.lit(0)))
    tag = lambda n: F.nullif(F.trim(F.regexp_extract("i", f"(?s)<{n}>(.*?)</{n}>", 1)), F.lit(""))
    at = lambda d, t: F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", tag(d), F.regexp_replace(tag(t), r"\.[0-9]+$", "")), F.lit("MM/dd/yyyy HH:mm:ss")), zone)
    x = feed.select(item.alias("i")).select(
        tag("IssueSymbol").alias("ticker"),
        tag("ReasonCode").alias("reason_code"),
        at("HaltDate", "HaltTime").alias("halt_at"),
        at("ResumptionDate", "ResumptionQuoteTime").alias("resumption_quote_at"),
        at("ResumptionDate", "ResumptionTradeTime").alias("resumption_trade_at"),
    )
    x = x.filter("ticker is not null and halt_at is not null")
    return x.withColumn("halt_id", F.sha2(F.concat_ws("|", "ticker", F.unix_micros("halt_at").cast("string"), "reason_code"), 256))
