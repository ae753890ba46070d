"""Schemas of the landing files and enum domains."""

from __future__ import annotations

from pyspark.sql import types as T

_KIND = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "t": T.TimestampType(), "b": T.BooleanType(), "D": T.DateType()}


def fields(spec: str) -> T.StructType:
    """``name:kind`` words; kinds s string, d double, l long, t timestamp, b boolean, D date."""
    return T.StructType([T.StructField(n, _KIND[k]) for n, k in (w.split(":") for w in spec.split())])


BAR = fields("security_id:s timestamp:t session:s open:d high:d low:d close:d volume:l available_at:t source:s source_url:s feed:s adjustment:s vwap:d bid:d ask:d trade_count:l")
INSTRUMENT = fields(
    "security_id:s ticker:s exchange:s security_type:s source:s source_url:s available_at:t effective_from:t effective_to:t sector:s sector_available_at:t sector_status:s shares_outstanding:l shares_outstanding_as_of:t "
    "shares_outstanding_available_at:t shares_outstanding_status:s free_float:l free_float_as_of:t free_float_available_at:t free_float_status:s reported_market_cap:d market_cap_as_of:t market_cap_status:s is_delisted:b delisted_at:t"
)
ACTION = fields("security_id:s action_type:s effective_at:t announced_at:t available_at:t source:s source_url:s split_ratio:d cash_amount:d old_ticker:s new_ticker:s")
HALT = fields("security_id:s started_at:t resumed_at:t reason:s available_at:t source:s source_url:s")
DETAIL = T.ArrayType(fields("kind:s label:s raw_text:s value:d unit:s"))
DOCUMENT = T.StructType(
    fields("document_id:s ticker:s issuer_id:s title:s text:s source_url:s source_kind:s published_at:t first_public_at:t first_seen_at:t ingested_at:t available_at:t source_timestamp_verified:b source_record_id:s form_type:s accession_number:s expected_catalyst_date:D related_primary_document_id:s").fields
    + [T.StructField("form_items", T.ArrayType(T.StringType())), T.StructField("structured_numerical_details", DETAIL)]
)
SNAPSHOT = T.ArrayType(fields("observed_at:t available_at:t likes:l replies:l reposts:l views:l"))
MENTION = T.StructType(
    fields("mention_id:s security_id:s ticker:s source:s source_record_id:s source_url:s published_at:t first_seen_at:t ingested_at:t available_at:t content_hash:s text:s author_key:s is_repost:b repost_of_source_record_id:s account_quality_score:d account_quality_basis:s affiliate_or_paid_promotion:b language:s").fields
    + [T.StructField("outbound_urls", T.ArrayType(T.StringType())), T.StructField("linked_catalyst_urls", T.ArrayType(T.StringType())), T.StructField("engagement_snapshots", SNAPSHOT)]
)
CATALYST = fields("catalyst_id:s security_id:s ticker:s source_url:s first_public_at:t available_at:t is_primary_source:b")
PRICE_CONTEXT = fields("security_id:s ticker:s reference_at:t observed_at:t available_at:t cumulative_return_pct:d source_url:s")
DESCRIPTOR = fields("source:s access_method:s collection_authorization_confirmed:b terms_url:s terms_reviewed_at:t rate_limit_policy:s coverage_started_at:t coverage_ended_at:t text_analysis_permitted:b content_storage:s author_metrics_permitted:b coverage_note:s")
_LABELS = "target_before_stop:b touch_up_05:b touch_up_10:b touch_up_20:b touch_down_05:b touch_down_10:b mfe_pct:d mae_pct:d continuation:b fill_status:s gross_return_pct:d spread_cost_pct:d slippage_cost_pct:d net_return_after_cost_pct:d"
_CATEGORIES = "catalyst_category:s float_category:s market_cap_category:s market_regime:s time_of_day:s gap_size_category:s relative_volume_category:s retail_attention_stage:s data_quality_score:d label_policy_version:s fill_policy_version:s"
MODEL_ROW = T.StructType(fields(f"observation_id:s event_id:s security_id:s ticker:s prediction_as_of:t features_available_at:t outcome_available_at:t source_url:s {_LABELS} {_CATEGORIES}").fields + [T.StructField("features", T.MapType(T.StringType(), T.DoubleType(), True))])
RAW_ITEM = fields("source_family:s source_id:s source_url:s source_timestamp:s first_seen_at:t payload:s")

# fixed values: what counts as true in text columns
TRUE_WORDS = ("1", "true", "yes", "y")
DOMAINS = {"exchange": ("NASDAQ", "NYSE", "OTHER"), "session": ("premarket", "regular", "outside"), "adjustment": ("raw", "split_adjusted"), "action_type": ("split", "cash_dividend", "symbol_change", "delisting")}
