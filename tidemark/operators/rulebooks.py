"""Quality rules of attention batches and of labelled model rows. The codes are fixed values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import valid_link
from tidemark.operators.quality import Rule, batch_issues, finite, repeated_key, row_issues

_NONE = "cast(null as bigint)"


def _us(c: str) -> Column:
    return F.unix_micros(c)


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _bad_link(c: Column) -> Column:
    return ~F.coalesce(valid_link(c), F.lit(False))


def hash_ok(digest: Column) -> Column:
    """Whether a text is the hexadecimal form of a SHA-256 digest."""
    return F.coalesce(digest.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def attention_issues(descriptors: DataFrame, securities: DataFrame, mentions: DataFrame, catalysts: DataFrame, contexts: DataFrame, fetched_at: Column) -> DataFrame:
    """(code, severity, entity_id, us) of a batch of mentions and what came with it.

    descriptors: a row per source; securities: the monitored ones (security_id, ticker); mentions, catalysts, contexts as
    in sources.schemas. Of a source or security described twice the greatest row holds for the others' rules. Nulls in a
    comparison break no rule; arrays that are null are empty. Counts of a row's links and snapshots are counted one each.
    """
    null_us = F.expr(_NONE)
    terms, start, end = F.col("terms_reviewed_at"), F.col("coverage_started_at"), F.col("coverage_ended_at")
    of_source = [
        Rule("COLLECTION_NOT_AUTHORIZED", ~F.coalesce("collection_authorization_confirmed", F.lit(False))),
        Rule("TERMS_REVIEW_AFTER_BATCH_FETCH", terms > fetched_at),
        Rule("INVALID_SOURCE_COVERAGE_INTERVAL", end <= start),
        Rule("TERMS_URL_MISSING", (F.col("access_method") != "engineering_fixture") & (F.coalesce("terms_url", F.lit("")) == "")),
        Rule("SOURCE_COVERAGE_UNDOCUMENTED", _blank("coverage_note"), "warning"),
        Rule("RATE_LIMIT_POLICY_MISSING", _blank("rate_limit_policy")),
    ]
    named = (F.coalesce("security_id", F.lit("")) == "") | (F.coalesce("ticker", F.lit("")) == "") | (F.upper("ticker") != F.col("ticker"))
    # eight sources at most by their domain, so their table is small whatever the mentions
    rights = descriptors.groupBy("source").agg(F.max(F.struct("text_analysis_permitted", "content_storage", "author_metrics_permitted")).alias("_d"))
    known = securities.groupBy("security_id").agg(F.max("ticker").alias("_ticker"))
    m = mentions.join(F.broadcast(rights), "source", "left").join(known, "security_id", "left")
    text, quality, digest = F.col("text").isNotNull(), F.col("account_quality_score"), F.col("content_hash")
    undeclared = F.col("_d").isNull()
    forbidden = ~undeclared & text & ~F.coalesce(F.col("_d.text_analysis_permitted"), F.lit(False))
    links = F.concat(F.coalesce("outbound_urls", F.array().cast("array<string>")), F.coalesce("linked_catalyst_urls", F.array().cast("array<string>")))
    shots = F.coalesce("engagement_snapshots", F.array().cast(mentions.schema["engagement_snapshots"].dataType))
    some = lambda cond: F.size(F.filter(shots, cond))
    unordered = F.size(F.filter(F.transform(shots, lambda x, i: (i > 0) & (x["observed_at"] <= F.try_element_at(shots, i)["observed_at"])), lambda b: b))
    negative = lambda x: reduce(lambda a, b: a + b, [F.coalesce((x[c] < 0).cast("int"), F.lit(0)) for c in ("likes", "replies", "reposts", "views")])
    of_mention = [
        Rule("SOURCE_ACCESS_UNDECLARED", undeclared),
        Rule("TEXT_USE_NOT_PERMITTED", forbidden),
        Rule("TEXT_STORAGE_NOT_PERMITTED", ~undeclared & text & ~forbidden & F.col("_d.content_storage").isin("none", "hash_only")),
        Rule("AUTHOR_METRICS_NOT_PERMITTED", ~undeclared & quality.isNotNull() & ~F.coalesce(F.col("_d.author_metrics_permitted"), F.lit(False))),
        Rule("PUBLISHED_AFTER_FIRST_SEEN", F.col("published_at") > F.col("first_seen_at")),
        Rule("AVAILABLE_BEFORE_FIRST_SEEN", F.col("available_at") < F.col("first_seen_at")),
        Rule("AVAILABLE_BEFORE_PUBLISHED", F.col("available_at") < F.col("published_at")),
        Rule("INGESTED_BEFORE_FIRST_SEEN", F.col("ingested_at") < F.col("first_seen_at")),
        Rule("MENTION_AFTER_BATCH_FETCH", F.col("ingested_at") > fetched_at),
        Rule("SECURITY_NOT_MONITORED", F.col("_ticker").isNull()),
        Rule("TICKER_IDENTITY_MISMATCH", ~F.col("_ticker").eqNullSafe(F.col("ticker")) & F.col("_ticker").isNotNull()),
        Rule("INVALID_SOURCE_URL", _bad_link(F.col("source_url"))),
        Rule("INVALID_SUPPORTING_URL", F.size(F.filter(links, _bad_link)), counts=True),
        Rule("INVALID_CONTENT_HASH", ~hash_ok(digest)),
        Rule("CONTENT_HASH_MISMATCH", hash_ok(digest) & text & (F.sha2("text", 256) != F.lower(digest))),
        Rule("INVALID_ACCOUNT_QUALITY", quality.isNotNull() & ~quality.between(0.0, 1.0)),
        Rule("ACCOUNT_QUALITY_BASIS_MISSING", quality.isNotNull() & (F.coalesce("account_quality_basis", F.lit("")) == "")),
        Rule("REPOST_ORIGIN_MISSING", F.col("is_repost") & (F.coalesce("repost_of_source_record_id", F.lit("")) == ""), "warning"),
        Rule("ENGAGEMENT_AVAILABLE_TOO_EARLY", some(lambda x: x["available_at"] < x["observed_at"]), counts=True),
        Rule("ENGAGEMENT_SNAPSHOTS_UNORDERED", unordered, counts=True),
        Rule("ENGAGEMENT_AFTER_BATCH_FETCH", some(lambda x: x["available_at"] > fetched_at), counts=True),
        Rule("NEGATIVE_ENGAGEMENT", F.aggregate(shots, F.lit(0), lambda n, x: n + negative(x)), counts=True),
    ]
    c = catalysts.join(known, "security_id", "left")
    of_catalyst = [
        Rule("CATALYST_AVAILABLE_TOO_EARLY", F.col("available_at") < F.col("first_public_at")),
        Rule("CATALYST_AFTER_BATCH_FETCH", F.col("available_at") > fetched_at),
        Rule("CATALYST_SECURITY_NOT_MONITORED", F.col("_ticker").isNull()),
        Rule("INVALID_CATALYST_URL", _bad_link(F.col("source_url"))),
    ]
    of_context = [
        Rule("PRICE_REFERENCE_AFTER_OBSERVATION", F.col("reference_at") > F.col("observed_at")),
        Rule("PRICE_CONTEXT_AVAILABLE_TOO_EARLY", F.col("available_at") < F.col("observed_at")),
        Rule("PRICE_CONTEXT_AFTER_BATCH_FETCH", F.col("available_at") > fetched_at),
        Rule("INVALID_PRICE_RETURN", ~finite("cumulative_return_pct")),
        Rule("INVALID_PRICE_SOURCE_URL", _bad_link(F.col("source_url"))),
    ]
    parts = [
        repeated_key(descriptors, ["source"], "DUPLICATE_SOURCE_DESCRIPTOR", null_us),
        row_issues(descriptors, of_source, F.col("source"), null_us),
        repeated_key(securities, ["security_id"], "DUPLICATE_MONITORED_SECURITY", null_us),
        row_issues(securities, [Rule("INVALID_MONITORED_SECURITY", named)], F.col("security_id"), null_us),
        repeated_key(mentions, ["mention_id"], "DUPLICATE_MENTION_ID", _us("available_at")),
        repeated_key(mentions, ["source", "source_record_id"], "DUPLICATE_SOURCE_RECORD", _us("available_at")),
        row_issues(m, of_mention, F.col("mention_id"), _us("available_at")),
        row_issues(c, of_catalyst, F.col("catalyst_id"), _us("available_at")),
        row_issues(contexts, of_context, F.col("security_id"), _us("available_at")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Excursions in per cent at which a touch label is set.
UP, DOWN = {"touch_up_05": 5.0, "touch_up_10": 10.0, "touch_up_20": 20.0}, {"touch_down_05": -5.0, "touch_down_10": -10.0}
CATEGORIES = ["catalyst_category", "float_category", "market_cap_category", "market_regime", "time_of_day", "gap_size_category", "relative_volume_category", "retail_attention_stage", "label_policy_version", "fill_policy_version"]


def model_row_rules(features: list[str], fetched_us: int, tolerance: float = 1e-8) -> list[Rule]:
    """Rules on single labelled rows; features is an array of (key, value), times are *_us."""
    keys = F.transform("features", lambda f: f["key"])
    odd = lambda f: f["value"].isNotNull() & (F.isnan(f["value"]) | (F.abs(f["value"]) == float("inf")))
    filled = F.col("fill_status") == "filled"
    net, gross = F.col("net_return_after_cost_pct"), F.col("gross_return_pct")
    cost = F.col("spread_cost_pct") + F.col("slippage_cost_pct")
    numbers = ["mfe_pct", "mae_pct", "spread_cost_pct", "slippage_cost_pct", "data_quality_score"]
    return [
        Rule("FEATURE_AVAILABLE_AFTER_PREDICTION", F.col("features_available_us") > F.col("as_of_us")),
        Rule("OUTCOME_AVAILABLE_AT_PREDICTION", F.col("outcome_us") <= F.col("as_of_us")),
        Rule("OUTCOME_NOT_MATURED_AT_FETCH", F.col("outcome_us") > fetched_us),
        Rule("MISSING_STABLE_IDENTITY", reduce(or_, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in ("observation_id", "event_id", "security_id")])),
        Rule("INVALID_TICKER", (F.coalesce("ticker", F.lit("")) == "") | (F.upper("ticker") != F.col("ticker"))),
        Rule("INVALID_SOURCE_URL", _bad_link(F.col("source_url"))),
        Rule("DUPLICATE_ROW_FEATURE", F.size(keys) != F.size(F.array_distinct(keys))),
        Rule("FEATURE_SCHEMA_MISMATCH", F.array_sort(F.array_distinct(keys)) != F.array(*[F.lit(f) for f in sorted(features)])),
        Rule("NONFINITE_FEATURE", F.size(F.filter("features", odd)), counts=True),
        Rule("NONMONOTONIC_UPSIDE_LABELS", ~((F.col("touch_up_20") <= F.col("touch_up_10")) & (F.col("touch_up_10") <= F.col("touch_up_05")))),
        Rule("NONMONOTONIC_DOWNSIDE_LABELS", F.col("touch_down_10") > F.col("touch_down_05")),
        Rule("TARGET_FIRST_WITHOUT_TARGET_TOUCH", F.col("target_before_stop") & ~F.col("touch_up_10")),
        Rule("MFE_TOUCH_INCONSISTENCY", reduce(or_, [(F.col("mfe_pct") >= x) != F.col(c) for c, x in UP.items()])),
        Rule("MAE_TOUCH_INCONSISTENCY", reduce(or_, [(F.col("mae_pct") <= x) != F.col(c) for c, x in DOWN.items()])),
        Rule("INVALID_EXCURSION_SIGN", (F.col("mfe_pct") < 0) | (F.col("mae_pct") > 0)),
        Rule("NONFINITE_OUTCOME_VALUE", reduce(lambda a, b: a + b, [(~finite(c)).cast("int") for c in numbers]), counts=True),
        Rule("NEGATIVE_EXECUTION_COST", (F.col("spread_cost_pct") < 0) | (F.col("slippage_cost_pct") < 0)),
        Rule("INVALID_DATA_QUALITY_SCORE", ~F.col("data_quality_score").between(0, 100)),
        Rule("FILLED_RETURN_MISSING", filled & (gross.isNull() | net.isNull())),
        Rule("NET_RETURN_COST_MISMATCH", filled & (F.abs(net - (gross - cost)) > tolerance)),
        Rule("UNFILLED_RETURN_PRESENT", ~filled & (gross.isNotNull() | net.isNotNull())),
        Rule("MISSING_CATEGORY_OR_POLICY", reduce(or_, [_blank(c) for c in CATEGORIES])),
    ]


def model_issues(rows: DataFrame, features: list[str], fetched_us: int, target_pct: float, stop_pct: float, survivorship_safe: bool) -> DataFrame:
    """(code, severity, entity_id, us) of a set of labelled rows; see model_row_rules."""
    whole = {
        "DUPLICATE_FEATURE_NAME": len(set(features)) != len(features),
        "NO_MODEL_FEATURES": not features,
        "INVALID_BARRIER_PAIR": target_pct <= 0 or stop_pct >= 0,
        "LIMITED_UNIVERSE_NOT_SURVIVORSHIP_SAFE": not survivorship_safe,
        "EMPTY_MODEL_DATASET": rows.isEmpty(),
    }
    batch = batch_issues(rows.sparkSession, whole, ("LIMITED_UNIVERSE_NOT_SURVIVORSHIP_SAFE",))
    repeated = repeated_key(rows, ["observation_id"], "DUPLICATE_OBSERVATION_ID", F.col("as_of_us"))
    return batch.unionByName(repeated).unionByName(row_issues(rows, model_row_rules(sorted(set(features)), fetched_us), F.col("observation_id"), F.col("as_of_us")))
