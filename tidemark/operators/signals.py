"""The attention row of a security: everything its mentions say at a point in time, with the coverage of each number."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import attention as A
from tidemark.operators import similarity

# fixed values: words that count for and against in a text
POSITIVE = ("beat", "growth", "approved", "contract", "partnership", "launch", "strong", "positive", "bullish", "upside")
NEGATIVE = ("miss", "offering", "dilution", "lawsuit", "halt", "weak", "negative", "bearish", "downside", "bankruptcy")


@dataclass(frozen=True)
class Settings:
    """Windows, and the coverage a number needs to be given."""

    as_of_us: int
    width_us: int = 15 * 60_000_000
    baseline: int = 8
    least_complete: int = 4
    least_coverage: float = 0.5
    similar: float = 0.82
    look_back: int = 4
    most_links: int = 10
    notes: tuple[str, ...] = field(default=())
    positive: tuple[str, ...] = POSITIVE
    negative: tuple[str, ...] = NEGATIVE


def repeated_language(mentions: DataFrame, settings: Settings) -> DataFrame:
    """(security_id, mention_id, repeats): mentions of the look-back with enough words, and whether one that was available
    before (then by id) says nearly the same. Exact: classes of equal token sets and a prefix-filter join within a
    security; see similarity."""
    tokens = X.mention_tokens(F.col("text"))
    t = mentions.select("security_id", "mention_id", "available_us", tokens.alias("t")).filter(F.size("t") > 0)
    t = t.groupBy("security_id", "mention_id").agg(F.min(F.struct("available_us", "t")).alias("m")).select("security_id", "mention_id", "m.*")
    members, pairs = similarity.similar_sets(t, ["security_id"], "mention_id", "t", settings.similar)
    times = t.select("security_id", F.col("mention_id").alias("id"), "available_us")
    prior = similarity.latest_similar_before(members, pairs, times, ["security_id"], ["available_us"])
    return prior.select("security_id", F.col("id").alias("mention_id"), F.col("prior").isNotNull().alias("repeats"))


def attention_signals(mentions: DataFrame, securities: DataFrame, descriptors: DataFrame, catalysts: DataFrame, contexts: DataFrame, settings: Settings) -> DataFrame:
    """A row per monitored security, also without any mention, as known at settings.as_of_us.

    mentions: security_id, mention_id, published_us, available_us, first_seen_us, source, author, text, quality,
    is_repost, source_url, urls (array), snapshots (see attention.engagement_velocity); mention_id is unique.
    descriptors: started_us, ended_us; catalysts: security_id, url, is_primary, public_us, available_us; contexts:
    security_id, available_us. A mention counts from its own availability. Numbers whose coverage is below
    least_coverage are given where the mean exists, but named in warnings; the independence and the duplicate ratio
    need it. All aggregates combine on the map side; authors, sources and links are counted on their own level first.
    """
    s = settings
    n = s.baseline + 1
    start, current_start = s.as_of_us - n * s.width_us, s.as_of_us - s.width_us
    known = mentions.filter((F.col("published_us") <= s.as_of_us) & (F.col("available_us") <= s.as_of_us))
    window = known.filter(F.col("available_us") >= start)
    counts = A.buckets(window, securities, s.as_of_us, s.width_us, s.baseline)
    now = window.filter(F.col("available_us") >= current_start)
    lately = known.filter(F.col("available_us") >= s.as_of_us - s.look_back * s.width_us)
    said = repeated_language(lately, s)
    rate, tone = A.engagement_velocity("snapshots", s.as_of_us), F.when(F.col("text").isNotNull(), X.lexicon_score(F.col("text"), s.positive, s.negative))
    rows = now.join(said, ["security_id", "mention_id"], "left").withColumns({"_rate": rate, "_tone": tone})
    per = rows.groupBy("security_id").agg(
        F.count("*").alias("current_count"), F.count("repeats").alias("_comparable"), F.count_if("repeats").alias("_copies"),
        F.sum("_rate").alias("_rate"), F.count("_rate").alias("_rates"), F.avg("_tone").alias("_tone"), F.count("_tone").alias("_tones"),
        F.avg("quality").alias("_quality"), F.count("quality").alias("_qualities"), F.count("is_repost").alias("_reposts"), F.count_if(~F.col("is_repost")).alias("_originals"),
    )
    authors = rows.filter("author is not null").groupBy("security_id", "author").agg(F.count("*").alias("_n")).groupBy("security_id").agg(F.count("*").alias("unique_authors"), F.sum("_n").alias("_with_author"), F.max("_n").alias("_most"))
    sources = A.source_diversity(rows).select("security_id", "sources", "counts", "concentration", "diversity")
    public = catalysts.filter(F.col("public_us") <= s.as_of_us)
    linked = A.linked_primary(rows.select("security_id", "urls"), public, s.as_of_us).withColumnRenamed("links", "primary_links")
    support = A.first_links(rows.select("security_id", F.col("source_url").alias("url"), "is_repost", "first_seen_us"), s.most_links).withColumnRenamed("links", "supporting_links")
    priced = contexts.filter(F.col("available_us") <= s.as_of_us).select("security_id").distinct().withColumn("_priced", F.lit(True))
    history = _history(counts, descriptors, s)
    out = history.join(per, "security_id", "left").fillna(0, ["current_count"])
    for part in (authors, sources, linked, support, priced):
        out = out.join(part, "security_id", "left")
    c = F.col("current_count")
    share = lambda x: F.when(c > 0, F.coalesce(F.col(x), F.lit(0)) / F.when(c > 0, c)).otherwise(0.0)
    hours = s.width_us / 3.6e9
    cover = {"author": share("_with_author"), "text": share("_comparable"), "engagement": share("_rates"), "sentiment": share("_tones"), "account": share("_qualities"), "repost": share("_reposts")}
    copies = F.when((c > 0) & (cover["text"] >= s.least_coverage), F.col("_copies") / F.when(c > 0, c))
    enough = (c > 0) & (cover["author"] >= s.least_coverage) & copies.isNotNull()
    largest = F.col("_most") / F.col("_with_author")
    independence = 100 * (F.col("unique_authors") / F.col("_with_author")) * (1 - copies) * (1 - 0.5 * largest) * F.least(F.lit(1.0), F.col("unique_authors") / 3)
    low = lambda name, k: F.when((c > 0) & (cover[k] < s.least_coverage), name)
    warnings = F.array(
        F.when(~F.col("usable"), "INCOMPLETE_OR_CHANGING_BASELINE_SOURCE_COVERAGE"), low("UNIQUE_AUTHOR_COVERAGE_LOW", "author"), low("TEXT_ANALYSIS_COVERAGE_LOW", "text"),
        low("ENGAGEMENT_VELOCITY_COVERAGE_LOW", "engagement"), low("ACCOUNT_QUALITY_COVERAGE_LOW", "account"), low("REPOST_STATUS_COVERAGE_LOW", "repost"), F.when((c > 0) & (F.col("sources") < 2), "SINGLE_SOURCE_ATTENTION"),
        F.when((c > 0) & F.col("primary_links").isNull(), "NO_VERIFIED_PRIMARY_CATALYST_LINK"), F.when((c > 0) & F.col("_priced").isNull(), "PRICE_MOVE_CONTEXT_UNAVAILABLE"), *[F.lit(f"PROVIDER_NOTE:{x}") for x in s.notes],
    )
    none = F.array().cast("array<string>")
    return out.select(
        "security_id", F.col("current_count"), "previous_count", (c / hours).alias("velocity"), ((c - F.col("previous_count")) / hours**2).alias("acceleration"), "baseline_intervals", "baseline_mean", _score(c).alias("baseline_score"),
        "unique_authors", cover["author"].alias("author_coverage"), copies.alias("duplicate_ratio"), cover["text"].alias("text_coverage"), F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(100.0), independence))).alias("independence"),
        F.when(F.col("_rates") > 0, F.col("_rate")).alias("engagement_velocity"), cover["engagement"].alias("engagement_coverage"), F.col("_tone").alias("sentiment"), cover["sentiment"].alias("sentiment_coverage"),
        F.col("_quality").alias("account_quality"), cover["account"].alias("account_coverage"), F.try_divide(F.col("_originals"), F.col("_reposts")).alias("original_ratio"), cover["repost"].alias("repost_coverage"),
        "sources", "counts", "concentration", "diversity", F.coalesce("primary_links", none).alias("primary_links"), F.coalesce("supporting_links", none).alias("supporting_links"), F.array_sort(F.array_distinct(F.array_compact(warnings))).alias("warnings"),
    )


def _history(counts: DataFrame, descriptors: DataFrame, s: Settings) -> DataFrame:
    """(security_id, previous_count, baseline_intervals, usable, baseline_mean, _variance) from the buckets.

    The baseline is usable if the current interval is covered (by at least one source), enough earlier ones are, and those
    are the latest ones without a hole.
    """
    spark = counts.sparkSession
    first = s.as_of_us - (s.baseline + 1) * s.width_us
    spans = spark.range(s.baseline + 1).select(F.col("id").cast("int").alias("bucket"), (F.lit(first) + F.col("id") * s.width_us).alias("start_us")).withColumn("end_us", F.col("start_us") + s.width_us)
    whole = {r["start_us"]: r["complete"] for r in A.covered(spans, descriptors).collect()}  # a row per interval
    complete = [whole[first + k * s.width_us] for k in range(s.baseline)]
    many, now = sum(complete), whole[s.as_of_us - s.width_us] and not descriptors.isEmpty()
    usable = bool(now and many >= s.least_complete and all(complete[s.baseline - many :]))
    inside = (F.col("bucket") >= s.baseline - many) & (F.col("bucket") < s.baseline)
    per = counts.groupBy("security_id").agg(
        F.sum(F.when(F.col("bucket") == s.baseline - 1, F.col("mentions"))).alias("previous_count"), F.avg(F.when(inside, F.col("mentions"))).alias("_mean"), F.var_pop(F.when(inside, F.col("mentions"))).alias("_variance")
    )
    given = F.lit(usable)
    return per.select("security_id", "previous_count", F.lit(many).alias("baseline_intervals"), given.alias("usable"), F.when(given, F.col("_mean")).alias("baseline_mean"), F.when(given, F.col("_variance")).alias("_variance"))


def _score(current: Column) -> Column:
    raw = 50 + 10 * (current - F.col("baseline_mean")) / F.greatest(F.lit(1.0), F.sqrt(F.col("_variance") + F.col("baseline_mean") + 1))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(F.col("baseline_mean").isNotNull(), raw))) * F.when(F.col("baseline_mean").isNotNull(), 1.0)
