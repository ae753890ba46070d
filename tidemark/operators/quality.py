"""Data quality as queries: row rules that give issue rows, and a gate that fails closed.

The codes are fixed values: whoever reads the issues knows them by these names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "code string, severity string, entity_id string, us long"


@dataclass(frozen=True)
class Rule:
    """A condition that makes a row an issue; a null condition doesn't. A number instead gives so many issues."""

    code: str
    broken: Column
    severity: str = "error"
    counts: bool = False


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def row_issues(rows: DataFrame, rules: list[Rule], entity: Column, us: Column) -> DataFrame:
    """(code, severity, entity_id, us) of all broken rules, in one scan of the rows."""
    issue = lambda r: F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))
    found = [F.array_repeat(issue(r), F.coalesce(r.broken.cast("int"), F.lit(0))) for r in rules]
    x = F.explode(F.flatten(F.array(*found)))
    return rows.select(x.alias("i"), entity.cast("string").alias("entity_id"), us.alias("us")).select("i.*", "entity_id", "us")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("issues"), F.count_distinct("entity_id").alias("entities"))


class QualityError(ValueError):
    """Raised by the gate, with the codes and counts of the errors."""


def gate(issues: list[DataFrame]) -> DataFrame:
    """The issues, unless there are errors: then it raises with a row per code, never with the rows themselves."""
    every = reduce(DataFrame.unionByName, issues)
    errors = every.filter("severity = 'error'").groupBy("code").count().orderBy("code").collect()  # a row per code
    if errors:
        raise QualityError(", ".join(f"{r['code']}: {r['count']}" for r in errors))
    return every


def batch_issues(spark: SparkSession, broken: dict[str, bool], warnings: tuple[str, ...] = ()) -> DataFrame:
    """Issues of a batch as a whole, from its description: a row per code that is broken."""
    return spark.createDataFrame([(c, "warning" if c in warnings else "error", None, None) for c, b in broken.items() if b], ISSUE)


def not_utc(text: str) -> Column:
    """Whether a timestamp's text lacks a UTC designator; only texts can, typed timestamps are instants."""
    return F.col(text).isNotNull() & ~F.trim(text).rlike(r"(?i)(Z|[+-]00:?00|\bUTC|\bGMT)$")


def bar_rules(computed_session: Column) -> list[Rule]:
    """Rules on single bars."""
    prices = [finite(c) & (F.col(c) > 0) for c in ("open", "high", "low", "close")]
    sane = reduce(lambda a, b: a & b, prices)
    minute = F.col("timeframe") == "1m"
    us, known = F.unix_micros("timestamp"), F.unix_micros("available_at")
    ohlc = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return [
        Rule("MISSING_SOURCE_URL", F.trim(F.coalesce("source_url", F.lit(""))) == ""),
        Rule("BAR_NOT_MINUTE_ALIGNED", minute & (us % 60_000_000 != 0)),
        Rule("INCORRECT_SESSION_BOUNDARY", minute & (F.col("session") != computed_session)),
        Rule("BAR_AVAILABLE_TOO_EARLY", minute & (known < us + 60_000_000)),
        Rule("IMPOSSIBLE_PRICE", ~sane),
        Rule("IMPOSSIBLE_OHLC", sane & ohlc),
        Rule("IMPOSSIBLE_VOLUME", F.col("volume") < 0),
        Rule("IMPOSSIBLE_BID", F.col("bid") <= 0),
        Rule("IMPOSSIBLE_ASK", F.col("ask") <= 0),
        Rule("CROSSED_QUOTE", F.col("bid") > F.col("ask")),
    ]


def instrument_rules(as_of_us: int, stale_days: int = 120) -> list[Rule]:
    stock = F.col("security_type") == "common_stock"
    age = F.lit(as_of_us) - F.unix_micros("free_float_as_of")
    return [
        Rule("FLOAT_UNAVAILABLE", stock & F.col("free_float").isNull(), "warning"),
        Rule("FLOAT_DATE_MISSING", stock & F.col("free_float").isNotNull() & (F.col("free_float_as_of").isNull() | F.col("free_float_available_at").isNull())),
        Rule("STALE_FLOAT", stock & F.col("free_float").isNotNull() & (age > stale_days * 86_400_000_000), "warning"),
        Rule("FLOAT_EXCEEDS_SHARES", F.col("free_float") > F.col("shares_outstanding")),
        Rule("MISSING_SOURCE_URL", F.trim(F.coalesce("source_url", F.lit(""))) == ""),
    ]


def missing_bar_issues(runs: DataFrame, trades_only: bool = False) -> DataFrame:
    """Issues of the runs of bars.missing_runs: MISSING_BARS, or for a feed that only reports trades
    UNOBSERVED_TRADE_BAR_INTERVALS."""
    code = "UNOBSERVED_TRADE_BAR_INTERVALS" if trades_only else "MISSING_BARS"
    return runs.select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col("security_id").alias("entity_id"), F.col("first_us").alias("us"))


def missing_daily_issues(securities: DataFrame, daily: DataFrame) -> DataFrame:
    """An issue for every expected security without any daily bar."""
    lost = securities.select("security_id").filter("security_id is not null").distinct().join(daily.select("security_id").distinct(), "security_id", "left_anti")
    return lost.select(F.lit("MISSING_DAILY_BARS").alias("code"), F.lit("error").alias("severity"), F.col("security_id").alias("entity_id"), F.lit(None).cast("long").alias("us"))


def document_rules(link_ok: Column, regulator_host: Column, fetched_us: int, text: Column) -> list[Rule]:
    """regulator_host: whether the link is the regulator's own; text: the document's text, null or blank without one."""
    t = {c: F.unix_micros(c) for c in ("published_at", "first_public_at", "first_seen_at", "ingested_at", "available_at")}
    return [
        Rule("PUBLIC_TIME_AFTER_DISCOVERY", t["first_public_at"] > t["first_seen_at"]),
        Rule("PUBLISHED_TIME_AFTER_DISCOVERY", t["published_at"] > t["first_seen_at"]),
        Rule("INGESTED_BEFORE_DISCOVERY", t["ingested_at"] < t["first_seen_at"]),
        Rule("AVAILABLE_BEFORE_PUBLIC", t["available_at"] < t["first_public_at"]),
        Rule("UNVERIFIED_TIME_USED_EARLY", ~F.col("source_timestamp_verified") & (t["available_at"] < t["first_seen_at"])),
        Rule("INVALID_TICKER", ~F.coalesce(F.col("ticker"), F.lit("")).rlike("^[A-Z][A-Z0-9.]{0,9}$")),
        Rule("MISSING_TITLE", F.trim(F.coalesce("title", F.lit(""))) == ""),
        Rule("INVALID_SOURCE_URL", ~link_ok),
        Rule("DOCUMENT_AFTER_BATCH_FETCH", t["ingested_at"] > fetched_us),
        Rule("SEC_SOURCE_DOMAIN_MISMATCH", (F.col("source_kind") == "sec_filing") & ~F.coalesce(F.col("source_url").startswith("fixture:"), F.lit(False)) & ~F.coalesce(regulator_host, F.lit(False))),
        Rule("MISSING_TEXT_EXTRACT", ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), "warning"),
        Rule("SEC_FORM_MISSING", (F.col("source_kind") == "sec_filing") & F.col("form_type").isNull(), "warning"),
        Rule("PRIMARY_TIMESTAMP_UNVERIFIED", F.col("source_kind").isin("sec_filing", "company_investor_relations", "exchange_announcement", "regulator_announcement") & ~F.col("source_timestamp_verified"), "warning"),
    ]


def split_behaviour(daily: DataFrame, actions: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """(security_id, effective_us, code) of splits across which prices don't behave as their adjustment says.

    The last close before against the first open from the split on: raw prices jump by 1 / ratio, adjusted ones don't.
    daily: security_id, us, open, close, adjustment; actions: security_id, effective_us, ratio (few per security).
    """
    a = actions.filter("ratio > 0").select("security_id", "effective_us", "ratio").distinct()
    j = daily.join(a, "security_id")
    before = F.col("us") < F.col("effective_us")
    g = j.groupBy("security_id", "effective_us", "ratio").agg(
        F.max_by(F.when(before, F.col("close")), F.when(before, F.col("us"))).alias("c"),
        F.min_by(F.when(~before, F.struct("open", "adjustment")), F.when(~before, F.col("us"))).alias("n"),
    )
    seen = F.try_divide(F.col("n.open"), F.col("c"))
    raw, adjusted = F.abs(seen - 1 / F.col("ratio")), F.abs(seen - 1)
    code = F.when((F.col("n.adjustment") == "raw") & (adjusted + tolerance < raw), "RAW_LOOKS_ADJUSTED").when((F.col("n.adjustment") == "split_adjusted") & (raw + tolerance < adjusted), "ADJUSTED_LOOKS_RAW")
    return g.select("security_id", "effective_us", code.alias("code")).filter("code is not null")


def split_issues(daily: DataFrame, actions: DataFrame) -> DataFrame:
    """split_behaviour as issues."""
    return split_behaviour(daily, actions).select(F.lit("SPLIT_ADJUSTMENT_ERROR").alias("code"), F.lit("error").alias("severity"), F.col("security_id").alias("entity_id"), F.col("effective_us").alias("us"))


def repeated_key(rows: DataFrame, keys: list[str], code: str, us: Column) -> DataFrame:
    """An issue for every second and later row of a key; the counts come from one aggregate, no group is sorted."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(us).alias("_us")).filter("_n > 1")
    many = n.withColumn("_k", F.explode(F.sequence(F.lit(2), F.col("_n"))))
    return many.select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.concat_ws("|", *keys).alias("entity_id"), F.col("_us").alias("us"))


def unknown_reference(rows: DataFrame, key: str, known: DataFrame, known_key: str, code: str, us: Column, severity: str = "error") -> DataFrame:
    """An issue for every row whose key isn't among the known ones."""
    lost = rows.join(known.select(F.col(known_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return lost.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("entity_id"), us.alias("us"))
