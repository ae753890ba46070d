"""Every code of the rulebooks fires in the queries' fixtures, and clean rows give none."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators import rulebooks as R
from tidemark.plans import batches

DATA = "/root/testdata/sf0.01"
NOW = datetime(2026, 5, 1, tzinfo=UTC)


def codes(df):
    return {r["code"] for r in df.collect()}


def test_every_attention_code_fires(spark):
    want = {c for c, *_ in batches._ATTENTION} | {x.split("'")[1] for x in batches._OF_BATCH} | {"DUPLICATE_MENTION_ID", "DUPLICATE_SOURCE_RECORD"}
    got = codes(batches.dq_attention(spark, DATA))
    assert len(want) == 42 and want - got == {"CATALYST_AVAILABLE_TOO_EARLY", "INVALID_CATALYST_URL", "INVALID_PRICE_SOURCE_URL"}
    odd = spark.createDataFrame([("c", "s", datetime(2026, 5, 2, tzinfo=UTC), NOW, "x")], "catalyst_id string, security_id string, first_public_at timestamp, available_at timestamp, source_url string")
    ctx = spark.createDataFrame([("s", NOW, NOW, NOW, 1.0, None)], "security_id string, reference_at timestamp, observed_at timestamp, available_at timestamp, cumulative_return_pct double, source_url string")
    m = batches._mentions(spark, DATA).limit(0)
    rows = spark.createDataFrame([], batches._DESCRIPTOR).select("*", *[F.timestamp_micros(F.lit(0)).alias(c) for c in ("terms_reviewed_at", "coverage_started_at", "coverage_ended_at")])
    s = spark.createDataFrame([("s", "S")], "security_id string, ticker string")
    assert codes(R.attention_issues(rows, s, m, odd, ctx, F.lit(NOW))) == {"CATALYST_AVAILABLE_TOO_EARLY", "INVALID_CATALYST_URL", "INVALID_PRICE_SOURCE_URL"}


def test_every_model_row_code_fires(spark):
    want = {c for c, _ in batches._MODEL} | {"DUPLICATE_OBSERVATION_ID", "DUPLICATE_FEATURE_NAME", "INVALID_BARRIER_PAIR", "LIMITED_UNIVERSE_NOT_SURVIVORSHIP_SAFE"}
    assert len(want) == 26 and codes(batches.dq_model_rows(spark, DATA)) == want
    rows = batches._labelled(spark, DATA)
    assert codes(R.model_issues(rows.limit(0), [], 0, 10.0, -5.0, True)) == {"NO_MODEL_FEATURES", "EMPTY_MODEL_DATASET"}
    clean = rows.filter("observation_id = '2-1'")
    if not clean.isEmpty():
        assert codes(R.model_issues(clean, batches.FEATURES, batches.MODEL_FETCHED_US * 2, 10.0, -5.0, True)) == set()


def test_texts_without_a_utc_mark(spark):
    texts = ["2026-01-01T00:00:00Z", "2026-01-01 00:00:00+00:00", "2026-01-01 00:00 UTC", "2026-01-01T00:00:00", "2026-01-01T00:00:00-05:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(Q.not_utc("t")).collect()] == [False, False, False, True, True, False]
