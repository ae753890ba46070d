"""Queries of problems 5 and 8 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, nearest, sentences
from tidemark.operators import clocks
from tidemark.plans.clocksql import OBSERVATIONS
from tidemark.plans.tables import spread, table
from tidemark.session import stored

#: A catalyst's observation lies at most this far from it.
TOLERANCE_US = 120_000_000


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cols = ["ticker", "source_timestamp", "first_seen_at", "feed", "observation_id"]
    seen = clocks.observation_instants(spread(table(spark, d, "market_observations").select(*cols)), table(spark, d, "feed_zones"))
    right = stored(seen.select(nearest.ticker_key(F.col("ticker")).alias("entity"), F.col("utc_us").alias("t"), F.col("observation_id").alias("id")), "instants")
    events = table(spark, d, "catalyst_events")
    left = events.select(nearest.ticker_key(F.col("ticker")).alias("entity"), F.unix_micros("first_public_at").alias("t"), F.col("event_id").alias("id"))
    return nearest.nearest_in_time(left, right, TOLERANCE_US).select(F.col("id").alias("event_id"), F.col("partner").alias("observation_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(spread(table(spark, d, "documents")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(spread(table(spark, d, "documents")))


QUERIES = {q.__name__: q for q in (p5_found, p8_ids, p9_mix, p9_shares, p10_found)}
_P5 = f"""WITH {OBSERVATIONS}, o AS (SELECT upper(trim(ticker)) tk, us, observation_id FROM ob WHERE us IS NOT NULL AND nullif(trim(ticker), '') IS NOT NULL),
e AS (SELECT DISTINCT event_id, upper(trim(ticker)) tk, epoch_us(first_public_at) t FROM catalyst_events WHERE first_public_at IS NOT NULL AND nullif(trim(ticker), '') IS NOT NULL)
SELECT event_id, arg_min(observation_id, (abs(us - t), us, observation_id)) AS observation_id FROM e JOIN o ON o.tk = e.tk AND us BETWEEN t - 120000000 AND t + 120000000 GROUP BY 1"""
#: The text queries aren't expressible in SQL; tests/llm holds them against brute force, round trips and known cases.
SQL: dict[str, str] = {"p5_found": _P5}
