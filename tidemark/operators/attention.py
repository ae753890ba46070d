"""Counts of mentions per security in fixed buckets that end at a point in time, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def eligible(mentions: DataFrame, as_of_us: int, start_us: int) -> DataFrame:
    """Mentions that were available in [start, as_of], both ends included."""
    return mentions.filter((F.col("available_us") >= start_us) & (F.col("available_us") <= as_of_us))


def buckets(mentions: DataFrame, securities: DataFrame, as_of_us: int, width_us: int, baseline: int) -> DataFrame:
    """(security_id, bucket, mentions): baseline + 1 buckets that end at as_of, empty ones with 0, for every security.

    A mention available at as_of itself falls into the last bucket.
    """
    n = baseline + 1
    start = as_of_us - n * width_us
    at = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col("available_us") - start) / width_us))).cast("int")
    counted = eligible(mentions, as_of_us, start).groupBy("security_id", at.alias("bucket")).agg(F.count("*").alias("n"))
    grid = securities.select("security_id").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(counted, ["security_id", "bucket"], "left").select("security_id", "bucket", F.coalesce("n", F.lit(0)).alias("mentions"))


def covered(intervals: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(start_us, end_us, complete): whether every descriptor covers the whole interval; complete without descriptors.

    descriptors: started_us, ended_us (null: still running), a row per source of mentions. All cover an interval if the
    latest start and the earliest end do, so two numbers are compared, not every pair.
    """
    ends = descriptors.agg(F.max("started_us").alias("_a"), F.min(F.coalesce("ended_us", F.lit((1 << 63) - 1))).alias("_z"))
    x = intervals.crossJoin(F.broadcast(ends))  # one row
    whole = (F.col("_a") <= F.col("start_us")) & (F.col("_z") >= F.col("end_us"))
    return x.select("start_us", "end_us", (F.col("_a").isNull() | whole).alias("complete"))


def linked_primary(mentions: DataFrame, catalysts: DataFrame, as_of_us: int) -> DataFrame:
    """(security_id, links): links of mentions that are primary catalyst links known by then, sorted.

    mentions: security_id, urls array; catalysts: security_id, url, is_primary, available_us.
    """
    known = catalysts.filter((F.col("available_us") <= as_of_us) & F.col("is_primary")).select("security_id", "url").distinct()
    said = mentions.select("security_id", F.explode("urls").alias("url")).distinct()
    return said.join(known, ["security_id", "url"], "left_semi").groupBy("security_id").agg(F.array_sort(F.collect_set("url")).alias("links"))


def baseline_scores(counts: DataFrame, baseline: int, hours: float) -> DataFrame:
    """(security_id, current, previous, velocity, acceleration, mean, variance, score) from the buckets of a security.

    The score is 50 + 10 * (current - mean) / max(1, sqrt(variance + mean + 1)), within 0 and 100.
    """
    past = F.col("bucket") < baseline
    pick = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("mentions")))
    s = counts.groupBy("security_id").agg(pick(baseline).alias("current"), pick(baseline - 1).alias("previous"), F.avg(F.when(past, F.col("mentions"))).alias("mean"), F.var_pop(F.when(past, F.col("mentions"))).alias("variance"))
    raw = 50 + 10 * (F.col("current") - F.col("mean")) / F.greatest(F.lit(1.0), F.sqrt(F.col("variance") + F.col("mean") + 1))
    return s.withColumns({"velocity": F.col("current") / hours, "acceleration": (F.col("current") - F.col("previous")) / (hours * hours), "score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))})


def author_independence(mentions: DataFrame, copies: Column) -> DataFrame:
    """(security_id, mentions, authors, coverage, largest_share, independence): two levels, authors then securities.

    independence is 100 * (authors / n) * (1 - share of copies) * (1 - half the largest author's share) * min(1, authors / 3),
    over mentions with an author; null without any. The first level spreads a hot security over its authors.
    """
    per = mentions.groupBy("security_id", "author").agg(F.count("*").alias("n"), F.count_if(copies).alias("c"))
    known = F.col("author").isNotNull()
    s = per.groupBy("security_id").agg(F.sum("n").alias("mentions"), F.count_if(known).alias("authors"), F.sum(F.when(known, F.col("n"))).alias("k"), F.max(F.when(known, F.col("n"))).alias("m"), F.sum("c").alias("copies"))
    share = F.col("m") / F.col("k")
    ind = 100 * (F.col("authors") / F.col("k")) * (1 - F.col("copies") / F.col("mentions")) * (1 - 0.5 * share) * F.least(F.lit(1.0), F.col("authors") / 3)
    return s.select("security_id", "mentions", "authors", (F.coalesce("k", F.lit(0)) / F.col("mentions")).alias("coverage"), share.alias("largest_share"), ind.alias("independence"))


def source_diversity(mentions: DataFrame) -> DataFrame:
    """(security_id, sources, counts, concentration, diversity): Herfindahl index of the sources' shares."""
    per = mentions.groupBy("security_id", "source").agg(F.count("*").alias("n"))
    s = per.groupBy("security_id").agg(F.count("*").alias("sources"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("counts"))
    h = F.col("q") / (F.col("t") * F.col("t"))
    return s.select("security_id", "sources", "counts", h.alias("concentration"), (100 * (1 - h)).alias("diversity"))


def engagement_velocity(snapshots: str, as_of_us: int) -> Column:
    """Interactions per hour between a mention's first and last eligible snapshot in array order; never below 0.

    Interactions are likes, replies and reposts as far as known; null with fewer than two eligible snapshots, without
    interactions, or without time between them.
    """
    ok = F.filter(snapshots, lambda s: (s["observed_us"] <= as_of_us) & (s["available_us"] <= as_of_us))
    n = lambda s: F.when(s["likes"].isNotNull() | s["replies"].isNotNull() | s["reposts"].isNotNull(), F.coalesce(s["likes"], F.lit(0)) + F.coalesce(s["replies"], F.lit(0)) + F.coalesce(s["reposts"], F.lit(0)))
    first, last = F.try_element_at(ok, F.lit(1)), F.try_element_at(ok, F.lit(-1))
    hours = (last["observed_us"] - first["observed_us"]) / 3.6e9
    rate = (n(last) - n(first)) / F.when(hours > 0, hours)
    # greatest skips nulls, so unknown interactions are told apart first
    return F.when((F.size(ok) >= 2) & (hours > 0) & rate.isNotNull(), F.greatest(F.lit(0.0), rate))


def first_links(mentions: DataFrame, most: int) -> DataFrame:
    """(security_id, links): distinct links, originals before reposts, then as first seen, most of them at most."""
    one = mentions.filter("url is not null").groupBy("security_id", "url").agg(F.min(F.struct(F.coalesce("is_repost", F.lit(False)).alias("r"), F.col("first_seen_us").alias("t"))).alias("o"))
    w = Window.partitionBy("security_id").orderBy("o", "url")
    top = one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return top.groupBy("security_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("links"))


def two_clock_last(left: DataFrame, right: DataFrame, by: list[str], cell_us: int = 86_400_000_000) -> DataFrame:
    """left with the value of the right row of its key that was observed last, among those observed by left's event_us
    and available by left's known_us, however long before.

    left: by, id, event_us, known_us; right: by, observed_us, available_us, value. Rows meet in time cells of cell_us,
    which bound no result: an event looks at its own cell and at the latest earlier cell in which any row was available
    by its known_us, found from one (cell, first availability) per key and cell. Earlier cells can't hold a later row. A
    hot key is spread over its cells and a join meets two cells of rows, not a key's whole history. Of rows observed at
    one instant the greatest value holds.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(cell_us)).cast("long")
    r = right.dropna(subset=["observed_us", "available_us"]).withColumn("_c", cell("observed_us"))
    firsts = r.groupBy(*by, "_c").agg(F.min("available_us").alias("_a")).groupBy(*by).agg(F.collect_list(F.struct("_c", "_a")).alias("_cells"))
    own = left.withColumn("_own", cell("event_us")).join(firsts, by, "left")
    known = F.filter("_cells", lambda x: (x["_c"] < F.col("_own")) & (x["_a"] <= F.col("known_us")))
    before = F.array_max(F.transform(known, lambda x: x["_c"]))
    l = own.withColumn("_c", F.explode(F.array("_own", before))).drop("_own", "_cells")  # noqa: E741
    met = l.join(r, [*by, "_c"]).filter((F.col("observed_us") <= F.col("event_us")) & (F.col("available_us") <= F.col("known_us")))
    best = met.groupBy("id").agg(F.max(F.struct("observed_us", "value")).alias("m"))
    return left.join(best, "id", "left").select(*left.columns, F.col("m.observed_us").alias("observed_us"), F.col("m.value").alias("value"))
