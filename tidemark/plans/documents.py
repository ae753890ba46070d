"""Queries over documents, events and quality rules, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions.calendar import US_EQUITY
from tidemark.operators import quality as Q
from tidemark.operators import similarity
from tidemark.operators.asof import numbered
from tidemark.plans import bars as bar_plans
from tidemark.plans.tables import table

FETCHED_US = 1_775_000_000_000_000  # 2026-03-31: when the documents' batch was fetched
WEEK_US = 7 * 86_400_000_000
AS_OF_US = 1_777_593_600_000_000  # 2026-05-01
#: Similarity of two documents' token sets from which they are near duplicates.
NEAR = 0.8
PRIMARY = ("sec_filing", "company_investor_relations", "exchange_announcement", "regulator_announcement")


def norm_text_tokens(spark, d):
    t = table(spark, d, "documents")
    tokens = X.token_set(F.col("text"))
    return t.select("doc_id", F.size(tokens).alias("tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


def numeric_extract(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.numeric_details(F.col("text")).alias("n"))
    of = lambda kind: F.filter("n", lambda x: x["kind"] == kind)
    total = lambda kind: F.round(F.aggregate(of(kind), F.lit(0.0), lambda a, x: a + x["value"]), 2)
    return t.select("doc_id", *[f(k).alias(f"{k}_{n}") for k in ("money", "percentage", "shares") for n, f in (("count", lambda k: F.size(of(k))), ("sum", total))])


def link_checks(spark, d):
    """Links as they come and in five broken forms, by the document's number."""
    k = F.regexp_extract("document_id", "([0-9]+)$", 1).cast("long") % 6
    t = table(spark, d, "source_documents")
    url = F.when(k == 0, F.col("source_url")).when(k == 1, F.regexp_replace("source_url", "^https?", "ftp")).when(k == 2, "https://").when(k == 3, F.concat(F.lit("HTTPS://News.Example.invalid/"), "document_id")).when(k == 4, None).otherwise("https://example.invalid.evil/x")
    t = t.withColumns({"k": k, "u": url})
    return t.groupBy("k", X.valid_link(F.col("u")).alias("valid"), X.host_within(F.col("u"), "example.invalid").alias("within")).agg(F.count("*").alias("n"))


def document_scalars(spark, d):
    """Scalars of documents: plain title, age at discovery, verification, the index's address, and of their text the
    expected date, the tone and the number of tokens that tell copies apart."""
    s = table(spark, d, "source_documents").withColumn("cor", F.col("related_primary_document_id").isNotNull())
    digits = F.regexp_extract("document_id", "([0-9]+)$", 1)
    acc = F.concat(F.lpad(digits, 10, "0"), F.lit("-26-"), F.lpad(digits, 6, "0"))
    packed = F.date_format("ingested_at", "yyyyMMddHHmmss")
    one = s.select(
        "document_id", F.md5(X.normalised(F.col("title"), F.col("provider"))).alias("plain"), F.coalesce(X.stale(F.col("first_seen_at"), F.col("first_public_at")), F.lit(False)).alias("stale"), X.verification(F.col("source_kind"), PRIMARY, F.col("cor")).alias("verification"),
        X.padded_issuer(digits).alias("issuer"), X.filing_index(digits, acc).alias("index"), F.unix_micros(X.packed_instant(packed)).alias("packed_us"),
    ).distinct()
    t = table(spark, d, "documents").filter("document_id is not null").groupBy("document_id").agg(F.max("text").alias("text"))
    said = F.concat(F.lit("Results expected about "), F.date_format("ingested_at", "yyyy-MM"), F.lit("-31."))
    when = s.groupBy("document_id").agg(F.date_format(X.expected_date(F.max(said)), "yyyy-MM-dd").alias("expected"))
    tone = t.select("document_id", F.round(X.lexicon_score(F.col("text"), ("growth", "strong", "plan"), ("loss", "risk", "halted")) + 1e-7, 4).alias("tone"), F.size(X.mention_tokens(F.col("text"))).alias("tokens"))
    return one.join(when, "document_id").join(tone, "document_id", "left")


def event_ids(spark, d):
    e = table(spark, d, "catalyst_events")
    return e.select("event_id", X.short_id(F.col("document_id"), F.col("catalyst_category"), F.lit("rules-v1")).alias("digest_id")).distinct()


def document_order(spark, d):
    """Processing order within a ticker: available, then kinds by priority, then id."""
    s = table(spark, d, "source_documents").groupBy("document_id", "ticker", "source_kind").agg(F.min(F.unix_micros("available_at")).alias("us")).filter("us is not null")
    rank = F.when(F.col("source_kind").isin(*PRIMARY), 0).otherwise(1)
    return numbered(s, ["ticker"], "us", [rank, F.col("document_id")], WEEK_US).select("document_id", "ticker", F.col("position").cast("int").alias("position"))


def corroboration(spark, d):
    """Documents whose related primary document was available by then."""
    s = table(spark, d, "source_documents")
    own = s.groupBy("document_id", "related_primary_document_id").agg(F.min(F.unix_micros("available_at")).alias("us")).filter("related_primary_document_id is not null and us is not null")
    primary = s.filter(F.col("source_kind").isin(*PRIMARY)).groupBy(F.col("document_id").alias("related_primary_document_id")).agg(F.min(F.unix_micros("available_at")).alias("p_us"))
    j = own.join(primary, "related_primary_document_id", "left")
    return j.select("document_id", F.coalesce(F.col("p_us") <= F.col("us"), F.lit(False)).alias("corroborated"))


def recent_same_category(spark, d):
    """Events with an event of the same ticker and category, known before, at most a week earlier.

    A range frame over public time; the frame's first in processing order tells whether any was known before. Time is cut
    into weeks: an event is laid into its own week and, for those that look back, into the next, so a hot ticker and
    category is spread over its weeks.
    """
    e = table(spark, d, "catalyst_events").select(F.upper(F.trim("ticker")).alias("ticker"), "catalyst_category", "event_id", F.unix_micros("first_public_at").alias("fp"), F.unix_micros("available_at").alias("av")).filter("fp is not null").distinct()
    week = F.floor(F.col("fp") / WEEK_US)
    laid = e.withColumn("_w", F.explode(F.array(week, week + 1))).withColumn("_own", F.col("_w") == week)
    w = Window.partitionBy("ticker", "catalyst_category", "_w").orderBy("fp").rangeBetween(-WEEK_US, 0)
    first = F.min(F.struct("av", "event_id")).over(w)
    return laid.withColumn("_f", first).filter("_own").select("event_id", (F.col("_f") < F.struct("av", "event_id")).alias("recent"))


def near_dup_jaccard(spark, d):
    """Per document its class of equal token sets, the number of near duplicates of its ticker and the latest before it.

    A text without tokens (other scripts, ignored words only) is equal to those of the same text but for case and
    blanks; null, empty and blank texts and documents without ticker are like no other. A document without time is
    counted but is neither before nor after another.
    """
    t = table(spark, d, "documents").select("ticker", "doc_id", F.unix_micros("published_at").alias("us"), "text", X.token_set(F.col("text")).alias("t"))
    plain = X.normalised(F.col("text"))
    # a stand-in that no token can equal: tokens are letters and digits
    alone = F.when(plain != "", F.concat(F.lit("#"), F.sha2(plain, 256))).otherwise(F.concat(F.lit("##"), F.col("doc_id").cast("string")))
    t = t.withColumn("t", F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(alone))).drop("text")
    placed, rest = t.filter("ticker is not null"), t.filter("ticker is null")
    members, pairs = similarity.similar_sets(placed, ["ticker"], "doc_id", "t", NEAR)
    n = similarity.links(members, pairs, ["ticker"])
    timed = placed.filter("us is not null").select("ticker", F.col("doc_id").alias("id"), "us")
    p = similarity.latest_similar_before(members, pairs, timed, ["ticker"], ["us"])
    found = n.join(p, ["ticker", "id"], "left").select(F.col("id").alias("doc_id"), "class_id", "links", "prior")
    none = rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("prior"))
    return found.unionByName(none)


def supporting_links_topn(spark, d):
    """The ten links of a ticker seen first; of several rows of one link the first counts."""
    s = table(spark, d, "source_documents").select("ticker", "source_url", F.unix_micros("first_seen_at").alias("us"), "document_id").filter("us is not null")
    s = s.withColumn("link", F.concat_ws("#", "source_url", "document_id")).groupBy("ticker", "link").agg(F.min("us").alias("us"))
    w = Window.partitionBy("ticker").orderBy("us", "link")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("ticker", "rank", "link")


def dq_market(spark, d):
    b, i = table(spark, d, "bars"), table(spark, d, "instruments")
    us = F.unix_micros("timestamp")
    halts = table(spark, d, "halt_observations")
    seen = table(spark, d, "market_observations")
    parts = [
        Q.batch_issues(spark, {"HISTORICAL_UNIVERSE_INCOMPLETE": True, "QUOTE_COVERAGE_NOT_CONSOLIDATED": True}, ("HISTORICAL_UNIVERSE_INCOMPLETE", "QUOTE_COVERAGE_NOT_CONSOLIDATED")),
        Q.row_issues(b, Q.bar_rules(US_EQUITY.classify(F.col("timestamp"))), F.col("security_id"), us),
        Q.row_issues(i, Q.instrument_rules(AS_OF_US), F.col("version_id"), F.unix_micros("available_at")),
        Q.repeated_key(b, ["security_id", "timeframe", "timestamp"], "DUPLICATE_BAR", us),
        Q.unknown_reference(b, "security_id", i, "security_id", "BAR_SECURITY_UNKNOWN", us),
        Q.row_issues(halts, [Q.Rule("INVALID_HALT_INTERVAL", F.col("resumption_trade_at") <= F.col("halt_at"))], F.col("halt_id"), F.unix_micros("halt_at")),
        Q.row_issues(seen, [Q.Rule("TIMEZONE_NOT_UTC", Q.not_utc("source_timestamp"))], F.col("observation_id"), F.unix_micros("first_seen_at")),
        Q.missing_bar_issues(bar_plans.expected_grid_gaps(spark, d)),
        Q.missing_daily_issues(i, b.filter("timeframe = '1d'")),
        Q.split_issues(bar_plans._daily(spark, d), bar_plans._actions(spark, d)),
    ]
    return Q.issue_counts(reduce(DataFrame.unionByName, parts))


def dq_documents(spark, d):
    """The text of a document is that of documents under its id, where there is one."""
    text = table(spark, d, "documents").filter("document_id is not null").groupBy("document_id").agg(F.max("text").alias("_text"))
    s = table(spark, d, "source_documents").join(text, "document_id", "left")
    us = F.unix_micros("ingested_at")
    rules = Q.document_rules(X.valid_link(F.col("source_url")), X.host_within(F.col("source_url"), "sec.gov"), FETCHED_US, F.col("_text"))
    parts = [
        Q.row_issues(s, rules, F.col("document_id"), us),
        Q.repeated_key(s, ["document_id"], "DUPLICATE_DOCUMENT_ID", us),
        Q.unknown_reference(s.filter("related_primary_document_id is not null"), "related_primary_document_id", s, "document_id", "CORROBORATING_DOCUMENT_MISSING", us, "warning"),
    ]
    return Q.issue_counts(reduce(DataFrame.unionByName, parts))


QUERIES = {q.__name__: q for q in (norm_text_tokens, numeric_extract, link_checks, document_scalars, event_ids, document_order, corroboration, recent_same_category, near_dup_jaccard, supporting_links_topn, dq_market, dq_documents)}

_TOK = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: len(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.IGNORED_TOKENS) + "))))"
_PRIM = "(" + ", ".join(f"'{k}'" for k in PRIMARY) + ")"


# RE2 has ASCII word edges and blanks only: letters of other scripts become x, other blanks a blank
_ASCII = r"regexp_replace(regexp_replace(coalesce(text, ''), '[\p{Han}\p{Thai}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Arabic}\p{Cyrillic}\p{Hangul}à-öø-ÿß]', 'x', 'g'), '[\p{Z}]', ' ', 'g')"


def _num(pattern: str, group: str) -> str:
    p = pattern.replace("'", "''").replace("U)", ")").replace("(?)", "")
    raw = f"regexp_extract_all({_ASCII}, '{p}', 1)"
    if not group:
        return f"list_distinct(list_transform({raw}, lambda v: CAST(v AS DOUBLE)))"
    scale = "CASE lower({s}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.SCALES.items()) + " ELSE 1.0 END"
    suffix = f"regexp_extract_all({_ASCII}, '{p}', 2)"
    return f"list_distinct(list_transform(list_zip({raw}, {suffix}), lambda z: CAST(replace(z[1], ',', '') AS DOUBLE) * {scale.format(s='z[2]')}))"


def _counts(parts: list[str]) -> str:
    return "SELECT code, severity, count(*) AS issues, count(DISTINCT entity_id) AS entities FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1, 2"


def _rule(code: str, cond: str, entity: str, frm: str, severity: str = "error") -> str:
    return f"SELECT '{code}' AS code, '{severity}' AS severity, CAST({entity} AS VARCHAR) AS entity_id FROM {frm} WHERE {cond}"


def _bar(code: str, cond: str) -> str:
    return _rule(code, cond, "security_id", "bb")


_SANE = " AND ".join(f"({c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c}) AND {c} > 0)" for c in ("open", "high", "low", "close"))
_STOCK = "security_type = 'common_stock'"
_DOC = lambda code, cond, sev="error": _rule(code, cond, "document_id", "source_documents", sev)

_SPLIT_ERRORS = f"""WITH {bar_plans._CLEAN}, a AS (SELECT DISTINCT security_id, epoch_us(effective_from) e, 1.0::DOUBLE + version_id % 3 AS ratio FROM instruments),
j AS (SELECT a.*, dly.us, dly.open, dly.close, dly.adjustment FROM a JOIN dly ON dly.security_id = a.security_id), g AS (SELECT security_id, e, ratio, arg_max(close, us) FILTER (us < e) c, arg_min(open, us) FILTER (us >= e) o, arg_min(adjustment, us) FILTER (us >= e) ad FROM j GROUP BY 1, 2, 3)
SELECT security_id FROM g WHERE (ad = 'raw' AND abs(o / c - 1) + 0.12 < abs(o / c - 1 / ratio)) OR (ad = 'split_adjusted' AND abs(o / c - 1 / ratio) + 0.12 < abs(o / c - 1))"""

SQL = {
    "norm_text_tokens": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOK} t FROM documents)",
    "numeric_extract": f"""WITH x AS (SELECT doc_id, {_num(X.MONEY, "s")} m, {_num(X.PERCENT, "")} p, {_num(X.SHARES, "s")} s FROM documents)
SELECT doc_id, CAST(len(m) AS INTEGER) AS money_count, round(coalesce(list_sum(m), 0), 2) AS money_sum, CAST(len(p) AS INTEGER) AS percentage_count, round(coalesce(list_sum(p), 0), 2) AS percentage_sum, CAST(len(s) AS INTEGER) AS shares_count, round(coalesce(list_sum(s), 0), 2) AS shares_sum FROM x""",
    "link_checks": """WITH x AS (SELECT CAST(regexp_extract(document_id, '([0-9]+)$', 1) AS BIGINT) % 6 k, source_url FROM source_documents)
SELECT k, k IN (0, 3, 5) AND (k <> 0 OR regexp_matches(source_url, '^https?://[^/?#]+')) AS valid, k = 3 OR (k IN (0, 1) AND regexp_matches(source_url, '^[a-z]+://([^/?#:]*[.])?example[.]invalid([:/?#]|$)')) AS within, count(*) AS n FROM x GROUP BY ALL""",
    "document_scalars": f"""WITH s AS (SELECT *, regexp_extract(document_id, '([0-9]+)$', 1) g FROM source_documents),
o AS (SELECT DISTINCT document_id, md5(trim(regexp_replace(lower(concat_ws(' ', title, provider)), '[\\s\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+', ' ', 'g'))) AS plain, coalesce(epoch_us(first_seen_at) - epoch_us(first_public_at) > 86400000000, false) AS stale,
 CASE WHEN source_kind = 'social_unverified' THEN 'unverified' WHEN source_kind IN {_PRIM} OR related_primary_document_id IS NOT NULL THEN 'verified' ELSE 'unverified' END AS verification, lpad(g, 10, '0') AS issuer,
 'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(g AS BIGINT) AS VARCHAR) || '/' || lpad(g, 10, '0') || '26' || lpad(g, 6, '0') || '/' || lpad(g, 10, '0') || '-26-' || lpad(g, 6, '0') || '-index.html' AS index, epoch_us(date_trunc('second', ingested_at)) AS packed_us FROM s),
w AS (SELECT document_id, TRY_CAST(strftime(max(timezone('UTC', date_trunc('month', ingested_at))), '%Y-%m') || '-31' AS DATE) e FROM s GROUP BY 1),
t AS (SELECT document_id, regexp_extract_all(lower(coalesce(max(text), '')), '[a-z0-9]+') k FROM documents WHERE document_id IS NOT NULL GROUP BY 1),
c AS (SELECT document_id, len(list_filter(k, lambda x: x IN ('growth', 'strong', 'plan'))) p, len(list_filter(k, lambda x: x IN ('loss', 'risk', 'halted'))) n, len(list_distinct(k)) u FROM t)
SELECT o.*, strftime(e, '%Y-%m-%d') AS expected, round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END + CASE WHEN u IS NULL THEN NULL ELSE 1e-7 END, 4) AS tone, CAST(CASE WHEN u >= 4 THEN u WHEN u IS NOT NULL THEN 0 END AS INTEGER) AS tokens FROM o JOIN w USING (document_id) LEFT JOIN c USING (document_id)""",
    "event_ids": "SELECT DISTINCT event_id, substr(sha256(concat_ws('|', document_id, catalyst_category, 'rules-v1')), 1, 24) AS digest_id FROM catalyst_events",
    "document_order": f"""WITH s AS (SELECT document_id, ticker, source_kind, min(available_at) us FROM source_documents GROUP BY ALL HAVING min(available_at) IS NOT NULL)
SELECT document_id, ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY us, CASE WHEN source_kind IN {_PRIM} THEN 0 ELSE 1 END, document_id) AS INTEGER) AS position FROM s""",
    "corroboration": f"""WITH o AS (SELECT document_id, related_primary_document_id r, min(available_at) us FROM source_documents WHERE related_primary_document_id IS NOT NULL GROUP BY ALL HAVING min(available_at) IS NOT NULL),
p AS (SELECT document_id r, min(available_at) pus FROM source_documents WHERE source_kind IN {_PRIM} GROUP BY 1) SELECT document_id, coalesce(pus <= us, false) AS corroborated FROM o LEFT JOIN p USING (r)""",
    "recent_same_category": f"""WITH e AS (SELECT DISTINCT upper(trim(ticker)) t, catalyst_category c, event_id, epoch_us(first_public_at) fp, epoch_us(available_at) av FROM catalyst_events WHERE first_public_at IS NOT NULL)
SELECT event_id, EXISTS (SELECT 1 FROM e p WHERE p.t = e.t AND p.c = e.c AND p.fp <= e.fp AND p.fp >= e.fp - {WEEK_US} AND (p.av, p.event_id) < (e.av, e.event_id)) AS recent FROM e""",
    "near_dup_jaccard": f"""WITH x0 AS (SELECT ticker, doc_id, epoch_us(published_at) us, {_TOK} t, trim(regexp_replace(lower(coalesce(text, '')), '[\\s\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+', ' ', 'g')) pl FROM documents),
x AS (SELECT ticker, doc_id, us, CASE WHEN len(t) > 0 THEN t WHEN pl <> '' THEN ['#' || pl] ELSE ['##' || doc_id] END t FROM x0), n AS (SELECT * FROM x WHERE ticker IS NOT NULL),
c AS (SELECT ticker, t, min(doc_id) class_id FROM n GROUP BY ALL),
pr AS (SELECT a.doc_id a, b.doc_id b, coalesce(b.us < a.us OR (b.us = a.us AND b.doc_id < a.doc_id), false) AS before, b.us bus FROM n a JOIN n b ON a.ticker = b.ticker AND a.doc_id <> b.doc_id WHERE len(list_intersect(a.t, b.t)) >= {NEAR} * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) - 1e-9),
g AS (SELECT a, count(*) links, arg_max(b, (bus, b)) FILTER (before) prior FROM pr GROUP BY 1)
SELECT n.doc_id, c.class_id, coalesce(g.links, 0) AS links, g.prior FROM n JOIN c ON c.ticker = n.ticker AND c.t = n.t LEFT JOIN g ON g.a = n.doc_id UNION ALL SELECT doc_id, doc_id, 0, NULL FROM x WHERE ticker IS NULL""",
    "supporting_links_topn": """WITH s AS (SELECT ticker, concat_ws('#', source_url, document_id) link, min(first_seen_at) us FROM source_documents WHERE first_seen_at IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY us, link) k FROM s) SELECT ticker, CAST(k AS INTEGER) AS rank, link FROM r WHERE k <= 10""",
    "dq_market": "WITH bl AS (SELECT *, timezone('America/New_York', timestamp) lt FROM bars), bb AS (SELECT *, CASE WHEN isodow(lt) > 5 THEN 'outside' WHEN hour(lt) * 60 + minute(lt) >= 240 AND hour(lt) * 60 + minute(lt) < 570 THEN 'premarket' WHEN hour(lt) * 60 + minute(lt) >= 570 AND hour(lt) * 60 + minute(lt) < 960 THEN 'regular' ELSE 'outside' END cs FROM bl), "
    + "db AS (SELECT security_id, timeframe, timestamp, unnest(generate_series(2, count(*))) k FROM bars GROUP BY 1, 2, 3 HAVING count(*) > 1) "
    + _counts(
        [
            _bar("MISSING_SOURCE_URL", "trim(coalesce(source_url, '')) = ''"),
            _bar("BAR_NOT_MINUTE_ALIGNED", "timeframe = '1m' AND epoch_us(timestamp) % 60000000 <> 0"),
            _bar("INCORRECT_SESSION_BOUNDARY", "timeframe = '1m' AND session <> cs"),
            _bar("BAR_AVAILABLE_TOO_EARLY", "timeframe = '1m' AND epoch_us(available_at) < epoch_us(timestamp) + 60000000"),
            _bar("IMPOSSIBLE_PRICE", f"NOT ({_SANE})"),
            _bar("IMPOSSIBLE_OHLC", f"({_SANE}) AND (high < greatest(open, close, low) OR low > least(open, close, high))"),
            _bar("IMPOSSIBLE_VOLUME", "volume < 0"),
            _bar("IMPOSSIBLE_BID", "bid <= 0"),
            _bar("IMPOSSIBLE_ASK", "ask <= 0"),
            _bar("CROSSED_QUOTE", "bid > ask"),
            _rule("FLOAT_UNAVAILABLE", f"{_STOCK} AND free_float IS NULL", "version_id", "instruments", "warning"),
            _rule("FLOAT_DATE_MISSING", f"{_STOCK} AND free_float IS NOT NULL AND (free_float_as_of IS NULL OR free_float_available_at IS NULL)", "version_id", "instruments"),
            _rule("STALE_FLOAT", f"{_STOCK} AND free_float IS NOT NULL AND {AS_OF_US} - epoch_us(free_float_as_of) > {120 * 86_400_000_000}", "version_id", "instruments", "warning"),
            _rule("FLOAT_EXCEEDS_SHARES", "free_float > shares_outstanding", "version_id", "instruments"),
            _rule("MISSING_SOURCE_URL", "trim(coalesce(source_url, '')) = ''", "version_id", "instruments"),
            _rule("TIMEZONE_NOT_UTC", "source_timestamp IS NOT NULL AND NOT regexp_matches(trim(source_timestamp), '([Zz]|[+-]00:?00|\\b[Uu][Tt][Cc]|\\b[Gg][Mm][Tt])$')", "observation_id", "market_observations"),
            "SELECT 'HISTORICAL_UNIVERSE_INCOMPLETE', 'warning', NULL",
            "SELECT 'QUOTE_COVERAGE_NOT_CONSOLIDATED', 'warning', NULL",
            f"SELECT 'MISSING_BARS', 'error', security_id FROM ({bar_plans.SQL['expected_grid_gaps']})",
            "SELECT 'MISSING_DAILY_BARS', 'error', security_id FROM (SELECT DISTINCT security_id FROM instruments WHERE security_id IS NOT NULL) s WHERE NOT EXISTS (SELECT 1 FROM bars z WHERE z.security_id = s.security_id AND timeframe = '1d')",
            f"SELECT 'SPLIT_ADJUSTMENT_ERROR', 'error', security_id FROM ({_SPLIT_ERRORS})",
            "SELECT 'DUPLICATE_BAR', 'error', concat_ws('|', security_id, timeframe, CAST(timestamp AS VARCHAR)) FROM db",
            "SELECT 'BAR_SECURITY_UNKNOWN', 'error', security_id FROM bars WHERE NOT EXISTS (SELECT 1 FROM instruments i WHERE i.security_id = bars.security_id)",
            _rule("INVALID_HALT_INTERVAL", "resumption_trade_at <= halt_at", "halt_id", "halt_observations"),
        ]
    ),
    "dq_documents": "WITH dd AS (SELECT document_id, unnest(generate_series(2, count(*))) k FROM source_documents GROUP BY 1 HAVING count(*) > 1) "
    + _counts(
        [
            _DOC("PUBLIC_TIME_AFTER_DISCOVERY", "first_public_at > first_seen_at"),
            _DOC("PUBLISHED_TIME_AFTER_DISCOVERY", "published_at > first_seen_at"),
            _DOC("INGESTED_BEFORE_DISCOVERY", "ingested_at < first_seen_at"),
            _DOC("AVAILABLE_BEFORE_PUBLIC", "available_at < first_public_at"),
            _DOC("UNVERIFIED_TIME_USED_EARLY", "NOT source_timestamp_verified AND available_at < first_seen_at"),
            _DOC("INVALID_TICKER", "NOT regexp_full_match(coalesce(ticker, ''), '[A-Z][A-Z0-9.]{0,9}')"),
            _DOC("MISSING_TITLE", "trim(coalesce(title, '')) = ''"),
            _DOC("INVALID_SOURCE_URL", "NOT coalesce(regexp_matches(source_url, '^https?://[^/?#]+'), false)"),
            _DOC("DOCUMENT_AFTER_BATCH_FETCH", f"epoch_us(ingested_at) > {FETCHED_US}"),
            _DOC("SEC_SOURCE_DOMAIN_MISMATCH", "source_kind = 'sec_filing' AND NOT starts_with(source_url, 'fixture:') AND NOT regexp_matches(source_url, '^[a-z]+://([^/?#]*[.])?sec[.]gov([/?#:]|$)')"),
            _DOC("MISSING_TEXT_EXTRACT", r"regexp_replace(coalesce((SELECT max(text) FROM documents t WHERE t.document_id = source_documents.document_id), ''), '[\s\p{Z}\x{85}\x1c-\x1f]', '', 'g') = ''", "warning"),
            _DOC("SEC_FORM_MISSING", "source_kind = 'sec_filing' AND form_type IS NULL", "warning"),
            _DOC("PRIMARY_TIMESTAMP_UNVERIFIED", f"source_kind IN {_PRIM} AND NOT source_timestamp_verified", "warning"),
            "SELECT 'DUPLICATE_DOCUMENT_ID', 'error', document_id FROM dd",
            "SELECT 'CORROBORATING_DOCUMENT_MISSING', 'warning', related_primary_document_id FROM source_documents s WHERE related_primary_document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_documents p WHERE p.document_id = s.related_primary_document_id)",
        ]
    ),
}
