"""Set-similarity self-join within blocks, exact, by prefix filtering over classes of equal sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import stored


def similar_sets(rows: DataFrame, block: list[str], ident: str, tokens: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of rows with equal or similar token sets in one block.

    members: block, id, class_id (the smallest id with the same tokens in the block), size (rows of the class).
    pairs: block, _a, _b with _a < _b: representatives of classes whose Jaccard similarity is at least the threshold.
    Rows of equal sets are one class and never expanded into pairs. Every two similar sets share a token among the
    first ``n - ceil(threshold * n) + 1`` in order of rarity (prefix filter), so only classes that share such a token
    meet, and only where their sizes allow the threshold; none is lost. Empty and null sets belong to no class.
    """
    keyed = rows.filter(F.size(tokens) > 0).select(*block, F.col(ident).alias("id"), F.array_sort(tokens).alias("t"))
    classes = keyed.groupBy(*block, "t").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    members = keyed.join(classes, [*block, "t"]).select(*block, "id", "class_id", "size")
    # rarity of tokens over the block's classes
    reps = stored(classes.select(*block, "class_id", "t"), "classes")
    each = reps.select(*block, "class_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    rarity = each.groupBy(*block, "token").agg(F.count("*").alias("df")).filter("df > 1")
    # a token of one class meets nothing but counts first in its class's order
    order = Window.partitionBy(*block, "class_id").orderBy(F.coalesce("df", F.lit(1)), "token")
    ranked = each.join(rarity, [*block, "token"], "left").withColumn("rank", F.row_number().over(order))
    prefix = ranked.filter((F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1) & F.col("df").isNotNull()).select(*block, "token", "class_id", "n", "rank")
    a, b = prefix.alias("a"), prefix.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*block, "token"]]
    # sizes allow the threshold, and so do the tokens left behind the shared one
    fits = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9
    left = F.least(F.col("a.n") - F.col("a.rank"), F.col("b.n") - F.col("b.rank")) + F.least("a.rank", "b.rank")
    need = left >= (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9
    met = a.join(b, [*same, F.col("a.class_id") < F.col("b.class_id"), fits, need]).select(*[F.col(f"a.{c}").alias(c) for c in block], F.col("a.class_id").alias("_a"), F.col("b.class_id").alias("_b")).distinct()
    t = reps.select(*block, "class_id", "t")
    full = met.join(t.withColumnsRenamed({"class_id": "_a", "t": "_ta"}), [*block, "_a"]).join(t.withColumnsRenamed({"class_id": "_b", "t": "_tb"}), [*block, "_b"])
    common = F.size(F.array_intersect("_ta", "_tb"))
    pairs = full.filter(common >= F.lit(threshold) * (F.size("_ta") + F.size("_tb") - common) - 1e-9).select(*block, "_a", "_b")
    return members, stored(pairs, "pairs")


def _both_ways(pairs: DataFrame, block: list[str]) -> DataFrame:
    return pairs.unionByName(pairs.select(*block, F.col("_b").alias("_a"), F.col("_a").alias("_b")))


def links(members: DataFrame, pairs: DataFrame, block: list[str]) -> DataFrame:
    """(block, id, class_id, links): per row its class and the number of other rows that are similar or equal to it."""
    size = members.select(*block, "class_id", "size").distinct()
    other = _both_ways(pairs, block).join(size.withColumnRenamed("class_id", "_b"), [*block, "_b"]).groupBy(*block, "_a").agg(F.sum("size").alias("others")).withColumnRenamed("_a", "class_id")
    return members.join(other, [*block, "class_id"], "left").select(*block, "id", "class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def latest_similar_before(members: DataFrame, pairs: DataFrame, times: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """(block, id, prior): the similar or equal row latest before each row in order (then id), in its block.

    times: block, id and the order columns. A class meets the first rows of the linked classes' runs only where they
    matter: per pair of classes and per run of rows between two own rows the last guest is enough, so guests are reduced
    to one per own row by an as-of scan over the pair, and a class's priors to the greatest over its pairs.
    """
    placed = members.drop("size").join(times, [*block, "id"])
    own = Window.partitionBy(*block, "class_id").orderBy(*order, "id")
    me = placed.withColumn("prior", F.lag(F.struct(*order, "id")).over(own))
    near = _both_ways(pairs, block).withColumnsRenamed({"_a": "seen_by", "_b": "class_id"})
    guests = placed.join(near, [*block, "class_id"]).select(*block, "seen_by", F.col("class_id").alias("other"), "id", *order, F.lit(False).alias("own"))
    hosts = placed.join(near.withColumnsRenamed({"class_id": "other", "seen_by": "class_id"}), [*block, "class_id"]).select(*block, F.col("class_id").alias("seen_by"), "other", "id", *order, F.lit(True).alias("own"))
    w = Window.partitionBy(*block, "seen_by", "other").orderBy(*order, "id").rowsBetween(Window.unboundedPreceding, -1)
    last = hosts.unionByName(guests).withColumn("p", F.last(F.when(~F.col("own"), F.struct(*order, "id")), ignorenulls=True).over(w)).filter("own")
    best = last.groupBy(*block, "id").agg(F.max("p").alias("p"))
    return me.join(best, [*block, "id"], "left").select(*block, "id", F.greatest("prior", "p")["id"].alias("prior"))
