"""Queries of the quality rules on whole batches: mentions with what came with them, and labelled rows.

The tables hold neither mentions nor labels, so both are laid over tables that exist (events, catalyst_events, bars;
lineitem with orders), with faults of every kind at fixed places; the SQL states the faults, not the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators import rulebooks as R
from tidemark.operators import signals as G
from tidemark.plans.tables import table

FETCHED_US = 1_706_572_800_000_000  # 2024-01-30
FEATURES = ["f_disc", "f_qty", "f_tax"]
MODEL_FETCHED_US = 883_612_800_000_000  # 1998-01-01

_DESCRIPTORS = [
    ("reddit", "approved_api", True, "https://t.example/a", 0, 1, 10**15, None, "p", True, "full_text_approved", True, "note"),
    ("stocktwits", "approved_api", False, None, FETCHED_US + 1, 5, 5, None, " ", False, "none", False, ""),
    ("x_public", "engineering_fixture", True, None, None, 1, None, None, "p", True, "hash_only", True, "note"),
]
_DESCRIPTOR = "source string, access_method string, collection_authorization_confirmed boolean, terms_url string, terms_us long, start_us long, end_us long, x string, rate_limit_policy string, text_analysis_permitted boolean, content_storage string, author_metrics_permitted boolean, coverage_note string"
_SECURITIES = [("click", "CLICK"), ("error", "ERROR"), ("purchase", "PURCHASE"), ("signup", "signup"), ("view", "VIEW"), ("view", "VIEW")]


def _mentions(spark, d):
    t = "timestamp_micros"
    e = table(spark, d, "events").selectExpr("event_id e", "unix_micros(ts) t", "event_type ty", "cast(get_json_object(props, '$.k') as int) % 4 src")
    e = e.selectExpr("*", "t + if(e % 113 = 0, -60000000, 60000000) seen", "t + if(e % 173 = 0, -60000000, 60000000) t2")
    return e.selectExpr(
        "concat('m', if(e % 101 = 0, 0, e)) mention_id", "element_at(array('reddit', 'stocktwits', 'x_public', 'youtube'), src + 1) source", "concat('r', if(e % 103 = 0, 0, e)) source_record_id",
        "if(e % 107 = 0, 'none', ty) security_id", "if(e % 109 = 0, 'ZZZ', upper(ty)) ticker", f"{t}(t) published_at", f"{t}(seen) first_seen_at", f"{t}(seen + if(e % 127 = 0, -30000000, 1000000)) available_at",
        f"{t}(seen + if(e % 131 = 0, -1000000, 2000000)) ingested_at", "if(e % 137 = 0, 'ftp://x', concat('https://x.example/', e)) source_url",
        "if(e % 139 = 0, array('bad', 'https://a.example/1'), array()) outbound_urls", "if(e % 149 = 0, array('nope', 'nope2'), null) linked_catalyst_urls", "if(e % 3 = 0, concat('text ', e), null) text",
        "case when e % 151 = 0 then 'xyz' when e % 157 = 0 then sha2('other', 256) else sha2(concat('text ', e), 256) end content_hash", "case when e % 163 = 0 then 1.5D when e % 5 = 0 then 0.5D end account_quality_score",
        "if(e % 167 = 0, null, 'b') account_quality_basis", "e % 11 = 0 is_repost", "if(e % 22 = 0, 'r1', null) repost_of_source_record_id",
        f"array(named_struct('observed_at', {t}(t), 'available_at', {t}(t + 1), 'likes', 1L, 'replies', 1L, 'reposts', 1L, 'views', 1L), named_struct('observed_at', {t}(t2), 'available_at', {t}(t2 + if(e % 179 = 0, -1, 1)), 'likes', if(e % 181 = 0, -1L, 2L), 'replies', if(e % 362 = 0, -1L, null), 'reposts', 2L, 'views', 2L)) engagement_snapshots",
    )


def dq_attention(spark, d):
    us = lambda c, name: F.timestamp_micros(c).alias(name)
    rows = spark.createDataFrame([*_DESCRIPTORS, _DESCRIPTORS[0]], _DESCRIPTOR)
    rows = rows.select("*", us("terms_us", "terms_reviewed_at"), us("start_us", "coverage_started_at"), us("end_us", "coverage_ended_at"))
    catalysts = table(spark, d, "catalyst_events").selectExpr("event_id catalyst_id", "if(source_kind = 'sec_filing', 'view', 'none') security_id", "first_public_at", "available_at", "source_url")
    minute = "interval 1 minute"
    contexts = table(spark, d, "bars").filter("timeframe = '1m'")
    contexts = contexts.selectExpr("security_id", "available_at reference_at", f"timestamp + 2 * {minute} observed_at", f"timestamp + if(volume % 7 = 0, 1, 3) * {minute} available_at", "close cumulative_return_pct", "source_url")
    fetched = F.timestamp_micros(F.lit(FETCHED_US))
    return Q.issue_counts(R.attention_issues(rows, spark.createDataFrame(_SECURITIES, "security_id string, ticker string"), _mentions(spark, d), catalysts, contexts, fetched))


def _labelled(spark, d):
    """A row per line of an order, and every 809th order's again."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.selectExpr("l_orderkey o", "l_linenumber l", "l_suppkey sup", "l_returnflag flag", "cast(l_quantity as double) q", "round(cast(l_discount as double) * 100) disc", "round(cast(l_tax as double) * 100) tax", "unix_date(to_date(l_shipdate)) * 86400000000L us", "o_orderpriority pr")
    x = x.unionByName(x.filter("o % 809 = 0"))
    x = x.selectExpr("*", "(q - 1) / 2 - if(o % 97 = 0, 1, 0) mfe", "-tax mae", "l % 7 <> 0 filled", "if(o % 601 = 0, -1, 1) * tax / 2 cost")
    net = "disc - cost - cost"
    return x.selectExpr(
        "concat(o, '-', l) observation_id", "if(o % 797 = 0, '', string(o)) event_id", "sup security_id", "if(o % 751 = 0, lower(flag), flag) ticker", "us as_of_us", "us + if(o % 739 = 0, 1, -1) * 86400000000L features_available_us",
        "us + if(o % 743 = 0, 0, 5) * 86400000000L outcome_us", "if(o % 757 = 0, 'ftp:/x', 'https://m.example/1') source_url",
        "filter(array(if(o % 769 = 0, null, struct('f_qty' as key, if(l % 5 = 0, null, if(o % 773 = 0, double('NaN'), q)) as value)), struct('f_disc' as key, disc as value), struct('f_tax' as key, tax as value), if(o % 761 = 0, struct('f_tax' as key, tax as value), null)), f -> f is not null) features",
        "mfe >= 5 touch_up_05", "(mfe >= 10) <> (o % 211 = 0) touch_up_10", "mfe >= 20 or o % 307 = 0 touch_up_20", "mae <= -5 touch_down_05", "mae <= -10 or o % 401 = 0 touch_down_10", "(mfe >= 10 and l % 2 = 0) or o % 503 = 0 target_before_stop",
        "mfe mfe_pct", "mae mae_pct", "cost spread_cost_pct", "cost slippage_cost_pct", "case when o % 733 = 0 then double('NaN') when o % 727 = 0 then 101.0D else q end data_quality_score", "if(filled, 'filled', 'unfilled') fill_status",
        "if(filled or o % 719 = 0, disc, null) gross_return_pct", f"case when o % 709 = 0 then null when filled then {net} + if(o % 701 = 0, 1, 0) end net_return_after_cost_pct",
        "pr catalyst_category", "if(o % 787 = 0, ' ', 'c') float_category", *[f"'c' {c}" for c in R.CATEGORIES[2:]],
    )


def dq_model_rows(spark, d):
    issues = R.model_issues(_labelled(spark, d), [*FEATURES, "f_tax"], MODEL_FETCHED_US, 0.0, -5.0, survivorship_safe=False)
    return Q.issue_counts(issues)


_SIGNALS = G.Settings(1_706_054_400_000_000, 6 * 3_600_000_000, least_coverage=0.25, notes=("synthetic",))
_NUMBERS = ["velocity", "acceleration", "baseline_mean", "baseline_score", "author_coverage", "duplicate_ratio", "text_coverage", "independence", "engagement_velocity", "engagement_coverage", "sentiment", "sentiment_coverage", "account_quality", "account_coverage", "original_ratio", "repost_coverage", "concentration", "diversity"]


def attention_signals(spark, d):
    s, as_of = _SIGNALS, _SIGNALS.as_of_us
    e = table(spark, d, "events").selectExpr("event_id e", "unix_micros(ts) t", "event_type ty", "user_id u", "cast(get_json_object(props, '$.k') as int) % 4 src")
    words = "concat_ws(' ', 'strong growth in', element_at(array('alpha', 'beta', 'gamma', 'delta', 'omega'), cast(e % 5 as int) + 1), 'unit', if(e % 4 = 0, 'halt', 'plan'), if(e % 9 = 0, concat('x', e), null))"
    m = e.selectExpr(
        "ty security_id", "e mention_id", "t published_us", "t + 61000000 available_us", "t + 60000000 first_seen_us", "src source", "if(u % 11 <> 0, u, null) author", f"if(e % 3 = 0, {words}, null) text",
        "if(e % 5 < 2, (e % 10) / 10, null) quality", "if(e % 4 = 0, null, e % 11 = 0) is_repost", "concat('https://s.example/', e % 40) source_url", "array(concat('https://p.example/', e % 50)) urls",
        "array(named_struct('observed_us', t, 'available_us', t + 1, 'likes', 1L, 'replies', cast(null as bigint), 'reposts', 0L), named_struct('observed_us', t + 600000000, 'available_us', t + 600000001, 'likes', e % 13, 'replies', 0L, 'reposts', 0L)) snapshots",
    )
    kinds = ["click", "error", "purchase", "signup", "view"]
    securities = spark.createDataFrame([(k,) for k in [*kinds, "quiet"]], "security_id string")
    descriptors = spark.createDataFrame([(as_of - 15 * s.width_us // 2, None), (0, as_of)], "started_us long, ended_us long")
    links = [(k, f"https://p.example/{i}", i % 2 == 0, as_of - 3_600_000_000, as_of + (20 if i == 8 else -20)) for k in kinds[:3] for i in range(10)]
    catalysts = spark.createDataFrame(links, "security_id string, url string, is_primary boolean, public_us long, available_us long")
    contexts = spark.createDataFrame([("click", as_of - 5), ("view", as_of + 5)], "security_id string, available_us long")
    g = G.attention_signals(m, securities, descriptors, catalysts, contexts, s)
    short = lambda c: F.regexp_replace(F.array_join(c, ","), "https://[a-z].example/", "").alias(c)
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ",").alias("counts")
    return g.select("security_id", "current_count", "previous_count", "baseline_intervals", "unique_authors", "sources", counts, *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in _NUMBERS], short("primary_links"), short("supporting_links"), F.array_join("warnings", ",").alias("warnings"))


QUERIES = {q.__name__: q for q in (dq_attention, dq_model_rows, attention_signals)}


def _sql(ctes: str, parts: list[tuple[str, str, str, str]], more: list[str] = ()) -> str:
    """Counts of issues: (code, entity, relation, condition or number of issues)."""
    rows = [f"SELECT '{c}' AS code, CAST({e} AS VARCHAR) AS entity_id, CAST(coalesce(CAST(({n}) AS INTEGER), 0) AS BIGINT) AS n FROM {r}" for c, e, r, n in parts]
    warnings = "'SOURCE_COVERAGE_UNDOCUMENTED', 'REPOST_ORIGIN_MISSING', 'LIMITED_UNIVERSE_NOT_SURVIVORSHIP_SAFE'"
    every = " UNION ALL ".join([*rows, *more])
    return f"WITH {ctes} SELECT code, CASE WHEN code IN ({warnings}) THEN 'warning' ELSE 'error' END AS severity, CAST(sum(n) AS BIGINT) AS issues, count(DISTINCT entity_id) AS entities FROM ({every}) WHERE n > 0 GROUP BY 1"


def _again(code: str, keys: str, relation: str) -> str:
    return f"SELECT '{code}' AS code, concat_ws('|', {keys}) AS entity_id, count(*) - 1 AS n FROM {relation} GROUP BY {keys}"


_M = """x0 AS (SELECT event_id e, epoch_us(CAST(ts AS TIMESTAMP)) t, event_type ty, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 src FROM events),
x AS (SELECT *, 'm' || CASE WHEN e % 101 = 0 THEN 0 ELSE e END AS id, 'r' || CASE WHEN e % 103 = 0 THEN 0 ELSE e END AS rec, t + CASE WHEN e % 113 = 0 THEN -60000000 ELSE 60000000 END AS seen, t + CASE WHEN e % 173 = 0 THEN -60000000 ELSE 60000000 END AS t2, (e % 163 = 0 OR e % 5 = 0) AS q FROM x0),
m AS (SELECT *, seen + CASE WHEN e % 127 = 0 THEN -30000000 ELSE 1000000 END AS av, seen + CASE WHEN e % 131 = 0 THEN -1000000 ELSE 2000000 END AS ing, t2 + CASE WHEN e % 179 = 0 THEN -1 ELSE 1 END AS a2 FROM x),
c AS (SELECT * FROM catalyst_events), b AS (SELECT *, epoch_us(timestamp) + CASE WHEN volume % 7 = 0 THEN 60000000 ELSE 180000000 END AS av FROM bars WHERE timeframe = '1m')"""
_ATTENTION = [
    ("SOURCE_ACCESS_UNDECLARED", "id", "m", "src = 3"),
    ("TEXT_USE_NOT_PERMITTED", "id", "m", "src = 1 AND e % 3 = 0"),
    ("TEXT_STORAGE_NOT_PERMITTED", "id", "m", "src = 2 AND e % 3 = 0"),
    ("AUTHOR_METRICS_NOT_PERMITTED", "id", "m", "src = 1 AND q"),
    ("PUBLISHED_AFTER_FIRST_SEEN", "id", "m", "e % 113 = 0"),
    ("AVAILABLE_BEFORE_FIRST_SEEN", "id", "m", "e % 127 = 0"),
    ("AVAILABLE_BEFORE_PUBLISHED", "id", "m", "e % 113 = 0"),
    ("INGESTED_BEFORE_FIRST_SEEN", "id", "m", "e % 131 = 0"),
    ("MENTION_AFTER_BATCH_FETCH", "id", "m", f"ing > {FETCHED_US}"),
    ("SECURITY_NOT_MONITORED", "id", "m", "e % 107 = 0"),
    ("TICKER_IDENTITY_MISMATCH", "id", "m", "e % 107 <> 0 AND (e % 109 = 0 OR ty = 'signup')"),
    ("INVALID_SOURCE_URL", "id", "m", "e % 137 = 0"),
    ("INVALID_SUPPORTING_URL", "id", "m", "CASE WHEN e % 139 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 149 = 0 THEN 2 ELSE 0 END"),
    ("INVALID_CONTENT_HASH", "id", "m", "e % 151 = 0"),
    ("CONTENT_HASH_MISMATCH", "id", "m", "e % 151 <> 0 AND e % 157 = 0 AND e % 3 = 0"),
    ("INVALID_ACCOUNT_QUALITY", "id", "m", "e % 163 = 0"),
    ("ACCOUNT_QUALITY_BASIS_MISSING", "id", "m", "q AND e % 167 = 0"),
    ("REPOST_ORIGIN_MISSING", "id", "m", "e % 11 = 0 AND e % 22 <> 0"),
    ("ENGAGEMENT_AVAILABLE_TOO_EARLY", "id", "m", "e % 179 = 0"),
    ("ENGAGEMENT_SNAPSHOTS_UNORDERED", "id", "m", "e % 173 = 0"),
    ("ENGAGEMENT_AFTER_BATCH_FETCH", "id", "m", f"(t + 1 > {FETCHED_US})::INTEGER + (a2 > {FETCHED_US})::INTEGER"),
    ("NEGATIVE_ENGAGEMENT", "id", "m", "(e % 181 = 0)::INTEGER + (e % 362 = 0)::INTEGER"),
    ("CATALYST_AVAILABLE_TOO_EARLY", "event_id", "c", "available_at < first_public_at"),
    ("CATALYST_AFTER_BATCH_FETCH", "event_id", "c", f"epoch_us(available_at) > {FETCHED_US}"),
    ("CATALYST_SECURITY_NOT_MONITORED", "event_id", "c", "source_kind <> 'sec_filing'"),
    ("INVALID_CATALYST_URL", "event_id", "c", "NOT coalesce(regexp_matches(source_url, '^https?://[^/?#]+'), false)"),
    ("PRICE_REFERENCE_AFTER_OBSERVATION", "security_id", "b", "epoch_us(available_at) > epoch_us(timestamp) + 120000000"),
    ("PRICE_CONTEXT_AVAILABLE_TOO_EARLY", "security_id", "b", "volume % 7 = 0"),
    ("PRICE_CONTEXT_AFTER_BATCH_FETCH", "security_id", "b", f"av > {FETCHED_US}"),
    ("INVALID_PRICE_RETURN", "security_id", "b", "close IS NULL OR isnan(close) OR isinf(close)"),
    ("INVALID_PRICE_SOURCE_URL", "security_id", "b", "NOT coalesce(regexp_matches(source_url, '^https?://[^/?#]+'), false)"),
]
_OF_BATCH = [f"SELECT '{c}', '{e}', 1" for c, e in [("DUPLICATE_SOURCE_DESCRIPTOR", "reddit"), ("DUPLICATE_MONITORED_SECURITY", "view"), ("INVALID_MONITORED_SECURITY", "signup"), *[(c, "stocktwits") for c in ("COLLECTION_NOT_AUTHORIZED", "TERMS_REVIEW_AFTER_BATCH_FETCH", "INVALID_SOURCE_COVERAGE_INTERVAL", "TERMS_URL_MISSING", "SOURCE_COVERAGE_UNDOCUMENTED", "RATE_LIMIT_POLICY_MISSING")]]]
_L = f"""l0 AS (SELECT l_orderkey o, l_linenumber l, l_quantity::DOUBLE q, round(l_discount::DOUBLE * 100) disc, round(l_tax::DOUBLE * 100) tax, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000000 us FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
l1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l0 WHERE o % 809 = 0),
r AS (SELECT *, o || '-' || l AS id, (q - 1) / 2 - CASE WHEN o % 97 = 0 THEN 1 ELSE 0 END AS mfe, -tax AS mae, l % 7 <> 0 AS filled, (mfe >= 10) <> (o % 211 = 0) AS up10, (mfe >= 20 OR o % 307 = 0) AS up20, (mae <= -10 OR o % 401 = 0) AS dn10, us + CASE WHEN o % 743 = 0 THEN 0 ELSE 5 END * 86400000000 AS out FROM l1)"""
_MODEL = [
    ("FEATURE_AVAILABLE_AFTER_PREDICTION", "o % 739 = 0"),
    ("OUTCOME_AVAILABLE_AT_PREDICTION", "o % 743 = 0"),
    ("OUTCOME_NOT_MATURED_AT_FETCH", f"out > {MODEL_FETCHED_US}"),
    ("MISSING_STABLE_IDENTITY", "o % 797 = 0"),
    ("INVALID_TICKER", "o % 751 = 0"),
    ("INVALID_SOURCE_URL", "o % 757 = 0"),
    ("DUPLICATE_ROW_FEATURE", "o % 761 = 0"),
    ("FEATURE_SCHEMA_MISMATCH", "o % 769 = 0"),
    ("NONFINITE_FEATURE", "o % 773 = 0 AND o % 769 <> 0 AND l % 5 <> 0"),
    ("NONMONOTONIC_UPSIDE_LABELS", "(up20 AND NOT up10) OR (up10 AND NOT mfe >= 5)"),
    ("NONMONOTONIC_DOWNSIDE_LABELS", "dn10 AND NOT mae <= -5"),
    ("TARGET_FIRST_WITHOUT_TARGET_TOUCH", "((mfe >= 10 AND l % 2 = 0) OR o % 503 = 0) AND NOT up10"),
    ("MFE_TOUCH_INCONSISTENCY", "o % 211 = 0 OR (o % 307 = 0 AND mfe < 20)"),
    ("MAE_TOUCH_INCONSISTENCY", "o % 401 = 0 AND mae > -10"),
    ("INVALID_EXCURSION_SIGN", "mfe < 0"),
    ("NONFINITE_OUTCOME_VALUE", "o % 733 = 0"),
    ("NEGATIVE_EXECUTION_COST", "o % 601 = 0 AND tax > 0"),
    ("INVALID_DATA_QUALITY_SCORE", "o % 727 = 0 OR o % 733 = 0"),
    ("FILLED_RETURN_MISSING", "filled AND o % 709 = 0"),
    ("NET_RETURN_COST_MISMATCH", "filled AND o % 709 <> 0 AND o % 701 = 0"),
    ("UNFILLED_RETURN_PRESENT", "NOT filled AND o % 719 = 0"),
    ("MISSING_CATEGORY_OR_POLICY", "o % 787 = 0"),
]

_AS_OF, _W = _SIGNALS.as_of_us, _SIGNALS.width_us
_POS, _NEG = (", ".join(f"'{w}'" for w in ws) for ws in (G.POSITIVE, G.NEGATIVE))
_SIGNAL_SQL = f"""WITH x AS (SELECT event_id e, epoch_us(CAST(ts AS TIMESTAMP)) t, event_type k, user_id u, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 src FROM events),
m AS (SELECT *, t + 61000000 AS av, CASE WHEN e % 3 = 0 THEN concat_ws(' ', 'strong growth in', ['alpha', 'beta', 'gamma', 'delta', 'omega'][e % 5 + 1], 'unit', CASE WHEN e % 4 = 0 THEN 'halt' ELSE 'plan' END, CASE WHEN e % 9 = 0 THEN 'x' || e END) END AS tx FROM x WHERE t + 61000000 <= {_AS_OF}),
sec AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'quiet']) AS k),
bk AS (SELECT sec.k, b, count(m.e) n FROM sec CROSS JOIN (SELECT unnest(range(9)) b) LEFT JOIN m ON m.k = sec.k AND av >= {_AS_OF - 9 * _W} AND least(8, (av - {_AS_OF - 9 * _W}) // {_W}) = b GROUP BY 1, 2),
h AS (SELECT k, CAST(sum(n) FILTER (b = 7) AS BIGINT) pv, avg(n) FILTER (b BETWEEN 2 AND 7) mu, var_pop(n) FILTER (b BETWEEN 2 AND 7) va FROM bk GROUP BY 1),
lb AS (SELECT *, list_distinct(regexp_extract_all(lower(tx), '[a-z0-9]+')) tk FROM m WHERE av >= {_AS_OF - 4 * _W} AND tx IS NOT NULL),
du AS (SELECT a.e, EXISTS (SELECT 1 FROM lb p WHERE p.k = a.k AND (p.av, p.e) < (a.av, a.e) AND len(list_intersect(p.tk, a.tk)) >= {_SIGNALS.similar} * (len(p.tk) + len(a.tk) - len(list_intersect(p.tk, a.tk)))) cp FROM lb a),
c AS (SELECT m.*, du.cp, CASE WHEN t + 600000001 <= {_AS_OF} THEN greatest(0, (e % 13 - 1) * 6) END AS rate,
 CASE WHEN tx IS NOT NULL THEN (len(list_filter(regexp_extract_all(lower(tx), '[a-z0-9]+'), lambda w: w IN ({_POS}))) - len(list_filter(regexp_extract_all(lower(tx), '[a-z0-9]+'), lambda w: w IN ({_NEG})))) / (len(list_filter(regexp_extract_all(lower(tx), '[a-z0-9]+'), lambda w: w IN ({_POS}) OR w IN ({_NEG})))) END AS tone,
 CASE WHEN e % 5 < 2 THEN (e % 10) / 10 END AS ql, CASE WHEN e % 4 <> 0 THEN e % 11 = 0 END AS rp, CASE WHEN u % 11 <> 0 THEN u END AS au FROM m LEFT JOIN du USING (e) WHERE av >= {_AS_OF - _W}),
p AS (SELECT k, count(*) n, count(cp) cm, count(*) FILTER (cp) dp, sum(rate) rt, count(rate) rn, avg(tone) tn, count(tone) tc, avg(ql) ql, count(ql) qc, count(rp) rc, count(*) FILTER (NOT rp) og FROM c GROUP BY 1),
a AS (SELECT k, count(*) ua, sum(n) wa, max(n) mx FROM (SELECT k, au, count(*) n FROM c WHERE au IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT k, count(*) sc, string_agg(src || ':' || n, ',' ORDER BY src) cts, sum(n * n) / (sum(n) * sum(n)) hh FROM (SELECT k, src, count(*) n FROM c GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT k, string_agg(i, ',' ORDER BY 'https://p.example/' || i) pl FROM (SELECT DISTINCT k, e % 50 AS i FROM c WHERE k IN ('click', 'error', 'purchase') AND e % 50 IN (0, 2, 4, 6)) GROUP BY 1),
f1 AS (SELECT k, e % 40 AS i, min((coalesce(rp, false), t)) o FROM c GROUP BY 1, 2), f AS (SELECT k, string_agg(i, ',' ORDER BY o, 'https://s.example/' || i) sl FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, 'https://s.example/' || i) rk FROM f1) WHERE rk <= 10 GROUP BY 1),
z AS (SELECT h.*, coalesce(n, 0) n, p.* EXCLUDE (k, n), ua, wa, mx, sc, cts, hh, coalesce(pl, '') pl, coalesce(sl, '') sl, CASE WHEN cm / n >= 0.25 THEN dp / n END dr FROM h LEFT JOIN p USING (k) LEFT JOIN a USING (k) LEFT JOIN s USING (k) LEFT JOIN l USING (k) LEFT JOIN f USING (k)),
w AS (SELECT *, coalesce(wa / n, 0) ac, coalesce(cm / n, 0) xc, coalesce(rn / n, 0) ec, coalesce(tc / n, 0) sc_, coalesce(qc / n, 0) qc_, coalesce(rc / n, 0) rc_ FROM z)
SELECT k AS security_id, n AS current_count, pv AS previous_count, 6 AS baseline_intervals, ua AS unique_authors, sc AS sources, cts AS counts, round(n / 6.0 + 1e-7, 4) AS velocity, round((n - pv) / 36.0 + 1e-7, 4) AS acceleration, round(mu + 1e-7, 4) AS baseline_mean, round(greatest(0, least(100, 50 + 10 * (n - mu) / greatest(1, sqrt(va + mu + 1)))) + 1e-7, 4) AS baseline_score,
 round(ac + 1e-7, 4) AS author_coverage, round(dr + 1e-7, 4) AS duplicate_ratio, round(xc + 1e-7, 4) AS text_coverage, CASE WHEN n > 0 AND ac >= 0.25 AND dr IS NOT NULL THEN round(100 * (ua / wa) * (1 - dr) * (1 - 0.5 * mx / wa) * least(1, ua / 3) + 1e-7, 4) END AS independence,
 round(rt + 1e-7, 4) AS engagement_velocity, round(ec + 1e-7, 4) AS engagement_coverage, round(tn + 1e-7, 4) AS sentiment, round(sc_ + 1e-7, 4) AS sentiment_coverage, round(ql + 1e-7, 4) AS account_quality, round(qc_ + 1e-7, 4) AS account_coverage, round(og / nullif(rc, 0) + 1e-7, 4) AS original_ratio, round(rc_ + 1e-7, 4) AS repost_coverage,
 round(hh + 1e-7, 4) AS concentration, round(100 * (1 - hh) + 1e-7, 4) AS diversity, pl AS primary_links, sl AS supporting_links,
 array_to_string(list_sort(list_filter([CASE WHEN n > 0 AND ac < 0.25 THEN 'UNIQUE_AUTHOR_COVERAGE_LOW' END, CASE WHEN n > 0 AND xc < 0.25 THEN 'TEXT_ANALYSIS_COVERAGE_LOW' END, CASE WHEN n > 0 AND ec < 0.25 THEN 'ENGAGEMENT_VELOCITY_COVERAGE_LOW' END, CASE WHEN n > 0 AND qc_ < 0.25 THEN 'ACCOUNT_QUALITY_COVERAGE_LOW' END,
 CASE WHEN n > 0 AND rc_ < 0.25 THEN 'REPOST_STATUS_COVERAGE_LOW' END, CASE WHEN n > 0 AND sc < 2 THEN 'SINGLE_SOURCE_ATTENTION' END, CASE WHEN n > 0 AND pl = '' THEN 'NO_VERIFIED_PRIMARY_CATALYST_LINK' END, CASE WHEN n > 0 AND k <> 'click' THEN 'PRICE_MOVE_CONTEXT_UNAVAILABLE' END, 'PROVIDER_NOTE:synthetic'], lambda v: v IS NOT NULL)), ',') AS warnings FROM w"""

SQL = {
    "attention_signals": _SIGNAL_SQL,
    "dq_attention": _sql(_M, _ATTENTION, [*_OF_BATCH, _again("DUPLICATE_MENTION_ID", "id", "m"), _again("DUPLICATE_SOURCE_RECORD", "src, rec", "m")]),
    "dq_model_rows": _sql(_L, [(c, "id", "r", n) for c, n in _MODEL], [_again("DUPLICATE_OBSERVATION_ID", "id", "r"), *[f"SELECT '{c}', NULL, 1" for c in ("DUPLICATE_FEATURE_NAME", "INVALID_BARRIER_PAIR", "LIMITED_UNIVERSE_NOT_SURVIVORSHIP_SAFE")]]),
}
