"""Batch forms of the monitor's operators; the streaming subpackage runs the same functions per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_last, previous_row
from tidemark.operators.intervals import merge_intervals

MINUTE_US = 60_000_000
HORIZONS = (5, 15, 30, 60)


def stale_sources(items: DataFrame, family: str, at_us: str, now_us: int, after_us: int) -> DataFrame:
    """(family, watermark_us, stale): a family is stale if its latest item is more than after_us older than now."""
    s = items.filter(F.col(at_us) <= now_us).groupBy(F.col(family).alias("family")).agg(F.max(at_us).alias("watermark_us"))
    return s.withColumn("stale", now_us - F.col("watermark_us") > after_us)


def current_halts(halts: DataFrame, now_us: int) -> DataFrame:
    """(ticker, halted): per ticker the latest halt that had begun; halted until trading resumes."""
    h = halts.filter((F.unix_micros("halt_at") <= now_us) & F.col("ticker").isNotNull())
    last = h.groupBy("ticker").agg(F.max(F.struct(F.unix_micros("halt_at").alias("a"), F.unix_micros("first_seen_at").alias("s"), F.unix_micros("resumption_trade_at").alias("z"))).alias("m"))
    return last.select("ticker", (F.col("m.z").isNull() | (F.col("m.z") > now_us)).alias("halted"))


def gated_features(observations: DataFrame) -> DataFrame:
    """(observation_id, return_pct, dollar_volume, spread_pct, float_rotation) of observations without missing flags that
    have an earlier one of their security, however long before; values against that earlier one.

    observations: one row per observation_id, with us; rows without a time count neither way.
    """
    o = observations.filter(F.col("us").isNotNull())
    p = previous_row(o, ["security_id"], "us", "observation_id", ["close"], 1440 * MINUTE_US)
    ok = p.filter((F.size("missing_flags") == 0) & F.col("prev_us").isNotNull())
    return ok.select(
        "observation_id",
        ((F.try_divide(F.col("close"), F.when(F.col("prev_close") > 0, F.col("prev_close"))) - 1) * 100).alias("return_pct"),
        (F.col("close") * F.col("volume")).alias("dollar_volume"),
        (F.try_divide(F.col("ask") - F.col("bid"), F.col("close")) * 100).alias("spread_pct"),
        F.try_divide(F.col("volume").cast("double"), F.col("free_float").cast("double")).alias("float_rotation"),
    )


def outcomes(alerts: DataFrame, observations: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(alert_id, horizon, observations, last, highest, lowest, complete, return_pct, mfe_pct, mae_pct): prices of an
    alert's ticker in (start, start + horizon], and what they are against its reference price.

    alerts: alert_id, ticker, start_us, reference (null: unknown); observations: ticker, us, close. An outcome is complete
    if there are prices and a reference; only then it has percentages (of the last, highest and lowest price). Both are laid into cells of the longest
    horizon's width; an alert looks at its own cell and the next, so a hot ticker is spread over its cells, and the
    prices are added up per alert and cell before anything is joined on. Horizons nest, so each observation is counted
    under every horizon it lies in. Alerts without any observation come with nulls and 0.
    """
    width = max(horizons) * MINUTE_US
    o = observations.filter("us is not null and close is not null and ticker is not null").withColumn("cell", F.floor(F.col("us") / width).cast("long"))
    a = alerts.filter("start_us is not null")
    near = a.withColumn("cell", F.explode(F.array(F.floor(F.col("start_us") / width).cast("long"), F.floor(F.col("start_us") / width).cast("long") + 1)))
    met = near.join(o.select("ticker", "cell", "us", "close"), ["ticker", "cell"]).filter((F.col("us") > F.col("start_us")) & (F.col("us") <= F.col("start_us") + width))
    hs = F.array(*[F.lit(h) for h in horizons])
    inside = F.filter(hs, lambda h: F.col("us") <= F.col("start_us") + h.cast("long") * MINUTE_US)
    many = met.withColumn("horizon", F.explode(inside))
    s = many.groupBy("alert_id", "horizon").agg(F.count("*").alias("observations"), F.max(F.struct("us", "close"))["close"].alias("last"), F.max("close").alias("highest"), F.min("close").alias("lowest"))
    grid = a.select("alert_id", "reference").distinct().withColumn("horizon", F.explode(hs))
    out = grid.join(s, ["alert_id", "horizon"], "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    complete = (F.col("observations") > 0) & F.coalesce(F.col("reference") != 0, F.lit(False))
    against = lambda c: F.when(complete, (F.try_divide(F.col(c), F.col("reference")) - 1) * 100)
    return out.select("alert_id", "horizon", "observations", "last", "highest", "lowest", complete.alias("complete"), against("last").alias("return_pct"), against("highest").alias("mfe_pct"), against("lowest").alias("mae_pct"))


def not_invalidated(alerts: DataFrame, manifests: DataFrame, at: Column, named: DataFrame | None = None) -> DataFrame:
    """Alerts that no manifest names or covers. manifests: alert_ids array, from_us, to_us; both ends count, a span
    without one end covers nothing. named: further alert_ids, as a table.

    Overlapping spans are merged in Spark, so an alert meets at most one of them: the last that begins by its time, found
    by an as-of lookup over all manifests, however many there are.
    """
    lost = manifests.select(F.explode("alert_ids").alias("alert_id"))
    lost = (lost.unionByName(named.select("alert_id")) if named is not None else lost).distinct()
    spans = manifests.filter("from_us is not null and to_us is not null").select(F.lit("").alias("_k"), "from_us", "to_us")
    merged = merge_intervals(spans, "_k", F.col("from_us"), F.col("to_us") + 1).filter("kind = 'period'").select(F.col("start_us").alias("_from"), F.col("end_us").alias("_to"))
    rest = alerts.join(lost, "alert_id", "left_anti").withColumn("_at", at)
    met = asof_last(rest.withColumnRenamed("_at", "_start"), merged, [], "_start", "_from", ["_to"], 1440 * MINUTE_US)
    return met.filter(F.col("_to").isNull() | F.col("_start").isNull() | (F.col("_start") >= F.col("_to"))).drop("_to", "_start")
