"""Queries on evaluation, modelling, attention and monitoring, with their DuckDB SQL.

Model rows come from lineitem and orders: a line is an observation, its order the cluster, its supplier the security.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import attention as A
from tidemark.operators import metrics as M
from tidemark.operators import modelling as L
from tidemark.operators import monitoring as O
from tidemark.operators import research as R
from tidemark.operators.asof import asof_last
from tidemark.operators.clocks import observation_instants
from tidemark.plans.clocksql import OBSERVATIONS
from tidemark.plans.tables import spread, table
from tidemark.session import stored

DAY_US = 86_400_000_000
FEATURES = ["f_qty", "f_disc", "f_tax"]
TRAIN_END, CALIBRATION, FINAL = 852_076_800_000_000, (854_755_200_000_000, 883_612_800_000_000), (886_291_200_000_000, 4_102_444_800_000_000)
AS_OF_US, WIDTH_US, BASELINE = 1_706_054_400_000_000, 6 * 3_600_000_000, 8
NOW_US = 1_772_323_200_000_000


def _r(c: str, n: int):
    """Rounded so that a half goes up whatever the last bits of a sum: the SQL below adds the same."""
    return F.round(F.col(c) + 10.0 ** -(n + 3), n).alias(c)


def _rows(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    us = F.unix_date(F.to_date("l_shipdate")).cast("long") * DAY_US
    # whole numbers, so that sums don't depend on their order
    disc, tax = F.round(F.col("l_discount").cast("double") * 100), F.round(F.col("l_tax").cast("double") * 100)
    x = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_orderkey").alias("event"),
        F.col("l_suppkey").alias("security"),
        us.alias("as_of_us"),
        (us + 5 * DAY_US).alias("outcome_us"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
        F.least(F.lit(1.0), F.col("l_quantity").cast("double") / 50).alias("p"),
        F.when(F.col("l_linenumber") % 7 != 0, disc - tax).alias("net"),
        disc.alias("gross"),
        tax.alias("cost"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity").cast("double")).alias("f_qty"),
        disc.alias("f_disc"),
        tax.alias("f_tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def source_coverage(spark, d):
    m = _mentions(spark, d)
    n = BASELINE + 1
    spans = spark.range(n).select((F.lit(AS_OF_US - n * WIDTH_US) + F.col("id") * WIDTH_US).alias("start_us")).withColumn("end_us", F.col("start_us") + WIDTH_US)
    return A.covered(spans, m.groupBy("source").agg(F.min("available_us").alias("started_us"), F.max("available_us").alias("ended_us")))


def split_label(spark, d):
    r = _rows(spark, d).withColumn("split", L.split_label(F.col("as_of_us"), TRAIN_END, CALIBRATION, FINAL))
    return r.groupBy("split").agg(F.count("*").alias("n"), F.min("as_of_us").alias("first_us"), F.max("as_of_us").alias("last_us"))


def walk_forward_folds(spark, d):
    return L.walk_forward_folds(_rows(spark, d), 30, 10, 10, ["as_of_us", "id"])


def impute_standardise(spark, d):
    s = L.feature_statistics(_rows(spark, d), FEATURES)
    return s.select("feature", "n", "missing", "median", _r("mean", 6), _r("deviation", 6))


def laplace_frequency(spark, d):
    f = L.laplace_frequency(_rows(spark, d), ["priority"])
    return f.select("priority", _r("frequency", 8))


def brier_logloss(spark, d):
    s = M.losses(_rows(spark, d), ["priority"])
    return s.select("priority", "n", *[_r(c, 6) for c in ("brier", "log_loss", "base_rate")])


def regression_metrics(spark, d):
    r = _rows(spark, d).select(F.col("f_disc").alias("p"), F.col("net").alias("y"), "status")
    s = M.regression_losses(r, ["status"])
    return s.select("status", "n", *[_r(c, 6) for c in ("mae", "rmse", "bias")])


def calibration_curve(spark, d):
    c = M.calibration_curve(_rows(spark, d))
    return c.select("bin", "low", "high", "n", _r("mean_p", 6), _r("observed", 6))


def topk_metrics(spark, d):
    s = M.top_k_metrics(_rows(spark, d), ["security"])
    return s.select("security", "k", "n", *[_r(c, 6) for c in ("precision", "expectancy", "fill_rate")])


def breakdowns(spark, d):
    s = M.breakdowns(_rows(spark, d), ["flag", "line", "priority", "status", "security"])
    return s.select("dimension", "category", "n", _r("brier", 6), _r("expectancy", 6), "small_sample")


def cost_stress(spark, d):
    s = M.cost_stress(M.top_rows(_rows(spark, d), ["security"], 10))
    return s.select("factor", _r("expectancy", 6))


def loo_concentration(spark, d):
    s = M.concentration(_rows(spark, d), "security")
    return s.select("security", "n", _r("share", 8), _r("left_out_brier", 8))


def monotonicity(spark, d):
    r = _rows(spark, d).select(F.col("f_disc").alias("a"), F.col("f_tax").alias("b"), F.col("f_qty").alias("c"))
    return M.monotonicity_violations(r, [["a", "b"], ["c", "b", "a"]])


def cluster_bootstrap(spark, d):
    return M.cluster_bootstrap(_rows(spark, d), "event").select("metric", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("low", "high")])


def _research(spark, d):
    rows = _rows(spark, d).withColumn("features_available_us", F.col("as_of_us") - DAY_US).withColumn("mfe", F.col("f_disc") + F.col("y"))
    n = rows.filter(F.col("as_of_us") <= TRAIN_END).count()
    plan = R.Plan(TRAIN_END - 5 * DAY_US, CALIBRATION, FINAL, n // 2, n // 8, n // 4)
    rows = rows.filter((F.col("as_of_us") <= plan.train_end) | (F.col("as_of_us") >= CALIBRATION[0])).filter((F.col("as_of_us") <= CALIBRATION[1] - 5 * DAY_US) | (F.col("as_of_us") > CALIBRATION[1]))
    report, predictions, effects = R.run(rows, FEATURES, [R.Target("y"), R.Target("mfe", "regression")], plan)
    return rows, report, predictions, effects


def model_selection(spark, d):
    """The report of a run, whether each final loss is reproduced, and how many effects are unstable over the folds."""
    rows, report, predictions, effects = _research(spark, d)
    again = R.reproduce(report, predictions, rows, {"y": "r.y", "mfe": "r.mfe"}).select("target", "model", "matches")
    per = [M.effect_stability(effects.filter(F.col("target") == t)).withColumn("target", F.lit(t)) for t in ("y", "mfe")]
    shaky = per[0].unionByName(per[1]).groupBy("target", "model").agg(F.count_if("unstable").alias("unstable_effects"))
    r = report.join(again, ["target", "model"], "left").join(shaky, ["target", "model"], "left")
    return r.select("target", "model", *[_r(c, 4) for c in ("cv", "train", "final")], "selected", F.array_join("flags", ",").alias("flags"), "matches", "unstable_effects")


def audit_findings(spark, d):
    rows, report, predictions, _ = _research(spark, d)
    again = R.reproduce(report, predictions, rows, {"y": "r.y", "mfe": "r.mfe"})
    best = M.top_rows(predictions.filter("target = 'y' and model = 'logistic'").select("id", "p").join(rows.drop("p"), "id"), [], 10)
    return R.findings(rows, report, predictions, again, best, False)


def _cells(spark, d):
    r = _rows(spark, d).filter(F.col("as_of_us") <= TRAIN_END)
    z, names = L.standardised(r, L.feature_statistics(r, FEATURES), FEATURES)
    return L.Cells(z.withColumns({n: F.round(n, 12) for n in names}), names, "y")


def _weights(spark, names, values):
    w = spark.createDataFrame([(n, float(v)) for n, v in zip(["intercept", *names], values)], "feature string, weight double")
    return w.select("feature", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


def gd_logistic(spark, d):
    c = _cells(spark, d)
    return _weights(spark, c.names, L.fit_logistic(c))


def gd_ridge(spark, d):
    c = _cells(spark, d)
    return _weights(spark, c.names, L.fit_ridge(c))


def boosted_stumps(spark, d):
    c = _cells(spark, d)
    _, stumps = L.fit_stumps(c)
    rows = [(i, c.names[j], float(t), float(a), float(b), float(g)) for i, (j, t, a, b, g) in enumerate(stumps)]
    return spark.createDataFrame(rows, "round int, feature string, threshold double, left double, right double, gain double")


def platt(spark, d):
    r = _rows(spark, d).filter(F.col("as_of_us").between(*CALIBRATION))
    q = F.least(F.greatest(F.col("p"), F.lit(1e-8)), F.lit(1 - 1e-8))
    a, b = L.fit_platt(L.Cells(r.withColumn("logit", F.round(F.log(q / (1 - q)), 12)), ["logit"], "y"))
    return _weights(spark, ["slope"], np.array([a, b]))


def _mentions(spark, d):
    e = table(spark, d, "events")
    us = F.unix_micros("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_type").alias("security_id"), us.alias("available_us"), F.when(F.col("user_id") % 11 != 0, F.col("user_id")).alias("author"), (k % 4).alias("source"), (k % 9 == 0).alias("copy"))


def mention_buckets(spark, d):
    """Monitored are the securities that are mentioned, and one that never is."""
    m = _mentions(spark, d)
    monitored = m.select("security_id").distinct().unionByName(spark.createDataFrame([("quiet",)], "security_id string"))
    return A.buckets(m, monitored, AS_OF_US, WIDTH_US, BASELINE)


def baseline_score(spark, d):
    m = _mentions(spark, d)
    s = A.baseline_scores(A.buckets(m, m, AS_OF_US, WIDTH_US, BASELINE), BASELINE, 6.0)
    return s.select("security_id", "current", "previous", *[_r(c, 4) for c in ("velocity", "acceleration", "mean", "variance", "score")])


def author_independence(spark, d):
    s = A.author_independence(_mentions(spark, d), F.col("copy"))
    return s.select("security_id", "mentions", "authors", *[_r(c, 6) for c in ("coverage", "largest_share", "independence")])


def hhi_diversity(spark, d):
    s = A.source_diversity(_mentions(spark, d))
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return s.select("security_id", "sources", text.alias("counts"), _r("concentration", 6), _r("diversity", 6))


def _obs(spark, d):
    """One row per observation with the instant its clock text denotes, whatever the text's form: a written table, so that
    texts are read once."""
    cols = ["observation_id", "security_id", "ticker", "source_timestamp", "first_seen_at", "feed", "close", "volume", "bid", "ask", "free_float", "missing_flags"]
    o = table(spark, d, "market_observations").select(*cols).dropDuplicates(["observation_id"])
    seen = observation_instants(spread(o), table(spark, d, "feed_zones")).withColumnRenamed("utc_us", "us")
    return stored(seen.drop("source_timestamp", "first_seen_at", "feed"), "observations")


def stale_sources(spark, d):
    i = table(spark, d, "raw_source_items").withColumn("us", F.unix_micros("first_seen_at"))
    return O.stale_sources(i, "provider", "us", NOW_US, 3_600_000_000)


def halt_enrichment(spark, d):
    return O.current_halts(table(spark, d, "halt_observations"), NOW_US)


def gated_features(spark, d):
    g = O.gated_features(_obs(spark, d))
    return g.select("observation_id", *[_r(c, n) for c, n in (("return_pct", 4), ("dollar_volume", 2), ("spread_pct", 4), ("float_rotation", 8))])


def _alerts(spark, d):
    e = table(spark, d, "catalyst_events").filter("ticker is not null").select(F.col("event_id").alias("alert_id"), F.upper(F.trim("ticker")).alias("ticker"), F.unix_micros("available_at").alias("start_us"))
    return e.distinct()


def alert_outcomes(spark, d):
    """The reference price of an alert is its ticker's last one at or before the alert."""
    prices = _obs(spark, d).filter("close is not null and not isnan(close)").select("ticker", "us", "close")
    alerts = asof_last(_alerts(spark, d), prices.withColumnsRenamed({"us": "_us", "close": "reference"}), ["ticker"], "start_us", "_us", ["reference"], DAY_US)
    o = O.outcomes(alerts, prices)
    return o.select("alert_id", "horizon", "observations", "last", "highest", "lowest", "complete", *[_r(c, 4) for c in ("return_pct", "mfe_pct", "mae_pct")])


def invalidation_antijoin(spark, d):
    """A manifest names every alert whose number ends in 7; two more cover spans, one of them open and so without effect."""
    a = _alerts(spark, d)
    named = a.filter(F.col("alert_id").endswith("7")).select("alert_id")
    spans = [([], 1_764_547_200_000_000, 1_767_225_600_000_000), ([], 1_767_000_000_000_000, 1_768_000_000_000_000), ([], 1_770_000_000_000_000, None)]
    m = spark.createDataFrame(spans, "alert_ids array<string>, from_us long, to_us long")
    return O.not_invalidated(a, m, F.col("start_us"), named).select("alert_id")


def price_context_asof(spark, d):
    left = _alerts(spark, d).join(table(spark, d, "catalyst_events").select(F.col("event_id").alias("alert_id"), F.unix_micros("first_public_at").alias("event_us")).distinct(), "alert_id").filter("event_us is not null")
    left = left.select("ticker", F.col("alert_id").alias("id"), "event_us", F.col("start_us").alias("known_us"))
    o = table(spark, d, "market_observations").filter("ticker is not null and close is not null and not isnan(close)")
    right = o.select("ticker", F.unix_micros("first_seen_at").alias("observed_us"), F.unix_micros("processing_timestamp").alias("available_us"), F.col("close").alias("value"))
    return A.two_clock_last(left, right, ["ticker"]).select("id", "observed_us", "value")


QUERIES = {
    q.__name__: q
    for q in (
        source_coverage, split_label, walk_forward_folds, impute_standardise, laplace_frequency, brier_logloss, regression_metrics, calibration_curve, topk_metrics, breakdowns, cost_stress, loo_concentration, monotonicity,
        cluster_bootstrap, model_selection, audit_findings, gd_logistic, gd_ridge, boosted_stumps, platt, mention_buckets, baseline_score, author_independence, hhi_diversity, stale_sources, halt_enrichment, gated_features, alert_outcomes,
        invalidation_antijoin, price_context_asof,
    )
}

_R = f"""r AS (SELECT concat_ws('-', l_orderkey, l_linenumber) id, l_orderkey AS event, l_suppkey AS security, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * {DAY_US} AS as_of_us,
 CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END y, least(1.0::DOUBLE, l_quantity::DOUBLE / 50) p, CASE WHEN l_linenumber % 7 <> 0 THEN round(l_discount::DOUBLE * 100) - round(l_tax::DOUBLE * 100) END net, round(l_discount::DOUBLE * 100) gross, round(l_tax::DOUBLE * 100) AS cost,
 CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity::DOUBLE END f_qty, round(l_discount::DOUBLE * 100) f_disc, round(l_tax::DOUBLE * 100) f_tax, l_returnflag AS flag, l_linestatus AS line, o_orderpriority AS priority, o_orderstatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_BRIER = "avg((p - y) * (p - y))"
_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY security ORDER BY p DESC, as_of_us, id) rk FROM r)"
_M = """m AS (SELECT event_type AS security_id, epoch_us(CAST(ts AS TIMESTAMP)) us, CASE WHEN user_id % 11 <> 0 THEN user_id END author, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events)"""
_B = f"""b AS (SELECT s.security_id, g.bucket, count(m.us) AS mentions FROM (SELECT DISTINCT security_id FROM m) s CROSS JOIN (SELECT unnest(range({BASELINE + 1})) bucket) g
 LEFT JOIN m ON m.security_id = s.security_id AND m.us >= {AS_OF_US - (BASELINE + 1) * WIDTH_US} AND m.us <= {AS_OF_US} AND least({BASELINE}, (m.us - {AS_OF_US - (BASELINE + 1) * WIDTH_US}) // {WIDTH_US}) = g.bucket GROUP BY 1, 2)"""
_AL = "al AS (SELECT DISTINCT event_id alert_id, upper(trim(ticker)) ticker, epoch_us(available_at) start_us FROM catalyst_events WHERE ticker IS NOT NULL)"

SQL = {
    "source_coverage": f"WITH {_M}, s AS (SELECT k % 4 AS source, min(us) a, max(us) z FROM m GROUP BY 1), i AS (SELECT CAST({AS_OF_US - (BASELINE + 1) * WIDTH_US} + r * {WIDTH_US} AS BIGINT) AS start_us FROM (SELECT unnest(range({BASELINE + 1})) r)) SELECT start_us, start_us + {WIDTH_US} AS end_us, (SELECT bool_and(a <= start_us AND z >= start_us + {WIDTH_US}) FROM s) AS complete FROM i",
    "split_label": f"""WITH {_R}, x AS (SELECT as_of_us, CASE WHEN as_of_us <= {TRAIN_END} THEN 'train' WHEN as_of_us BETWEEN {CALIBRATION[0]} AND {CALIBRATION[1]} THEN 'calibration' WHEN as_of_us BETWEEN {FINAL[0]} AND {FINAL[1]} THEN 'final_test' WHEN as_of_us < {FINAL[0]} THEN 'embargo' ELSE 'out_of_range' END split FROM r)
SELECT split, count(*) AS n, min(as_of_us) AS first_us, max(as_of_us) AS last_us FROM x GROUP BY 1""",
    "walk_forward_folds": f"""WITH {_R}, n AS (SELECT *, row_number() OVER (ORDER BY as_of_us, id) - 1 pos, count(*) OVER () c FROM r), f AS (SELECT CAST((pos - 30) // 10 AS INTEGER) fold, pos, as_of_us first_us, c FROM n WHERE pos >= 30 AND (pos - 30) % 10 = 0 AND pos + 10 <= c),
g AS (SELECT f.fold, count(*) train FROM f JOIN n ON n.pos < f.pos AND n.as_of_us + {5 * DAY_US} < f.first_us GROUP BY 1)
SELECT f.fold, f.pos AS start_position, f.first_us, CASE WHEN train IS NULL THEN 0 ELSE train END AS train, CAST(10 AS BIGINT) AS validation FROM f LEFT JOIN g USING (fold)""",
    "impute_standardise": f"WITH {_R}, u AS (SELECT unnest(['f_qty', 'f_disc', 'f_tax']) AS feature, unnest([f_qty, f_disc, f_tax]) v FROM r), md AS (SELECT feature, median(v) md FROM u GROUP BY 1) SELECT feature, count(*) AS n, count(*) FILTER (v IS NULL) AS missing, any_value(md) AS median, round(avg(coalesce(v, md)), 6) AS mean, round(stddev_pop(coalesce(v, md)), 6) AS deviation FROM u JOIN md USING (feature) GROUP BY 1",
    "laplace_frequency": f"WITH {_R} SELECT priority, round((sum(y) + 1) / (count(*) + 2), 8) AS frequency FROM r GROUP BY 1",
    "brier_logloss": f"WITH {_R} SELECT priority, count(*) AS n, round({_BRIER}, 6) AS brier, round(-avg(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))), 6) AS log_loss, round(avg(y), 6) AS base_rate FROM r GROUP BY 1",
    "regression_metrics": f"WITH {_R} SELECT status, count(*) AS n, round(avg(abs(f_disc - net)), 6) AS mae, round(sqrt(avg((f_disc - net) * (f_disc - net))), 6) AS rmse, round(avg(f_disc - net), 6) AS bias FROM r WHERE net IS NOT NULL GROUP BY 1",
    "calibration_curve": f"WITH {_R}, e AS (SELECT CAST(unnest(range(10)) AS INTEGER) bin), x AS (SELECT CAST(" + " + ".join(f"(p >= {i / 10}::DOUBLE)::INTEGER" for i in range(1, 10)) + " AS INTEGER) bin, p, y FROM r) SELECT e.bin, e.bin / 10.0::DOUBLE AS low, (e.bin + 1) / 10.0::DOUBLE AS high, count(p) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM e LEFT JOIN x USING (bin) GROUP BY 1",
    "topk_metrics": f"WITH {_R}, {_TOP} SELECT security, k, count(*) AS n, round(avg(y), 6) AS precision, round(avg(coalesce(net, 0)), 6) AS expectancy, round(avg((net IS NOT NULL)::INTEGER), 6) AS fill_rate FROM t JOIN (SELECT CAST(unnest([1, 3, 5, 10]) AS INTEGER) k) ON rk <= k GROUP BY 1, 2",
    "breakdowns": f"WITH {_R}, u AS (SELECT unnest(['flag', 'line', 'priority', 'status', 'security']) AS dimension, unnest([flag, line, priority, status, CAST(security AS VARCHAR)]) AS category, p, y, net FROM r) SELECT dimension, category, count(*) AS n, round({_BRIER}, 6) AS brier, round(avg(coalesce(net, 0)), 6) AS expectancy, count(*) < 10 AS small_sample FROM u GROUP BY 1, 2",
    "cost_stress": f"WITH {_R}, {_TOP} SELECT factor, round(avg(coalesce(gross - factor * cost, 0)), 6) AS expectancy FROM t CROSS JOIN (SELECT unnest([1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) factor) WHERE rk <= 10 GROUP BY 1",
    "loo_concentration": f"WITH {_R}, s AS (SELECT security, count(*) n, sum((p - y) * (p - y)) s FROM r GROUP BY 1), t AS (SELECT sum(n) tn, sum(s) ts FROM s) SELECT security, n, round(n / tn, 8) AS share, round((ts - s) / (tn - n), 8) AS left_out_brier FROM s, t",
    "cluster_bootstrap": f"""WITH {_R}, s AS (SELECT event, count(*) n, sum((p - y) * (p - y)) e, sum(y) y FROM r WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1),
d AS (SELECT s.*, rep, (('0x' || substr(md5(concat_ws('|', 7, rep, event)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE u FROM s CROSS JOIN (SELECT CAST(unnest(range(100)) AS INTEGER) rep)),
t AS (SELECT *, {" + ".join(f"(u > {x!r}::DOUBLE)::INTEGER" for x in M.POISSON)} AS k FROM d), q AS (SELECT rep, sum(e * k) / sum(n * k) b, sum(y * k) / sum(n * k) a FROM t GROUP BY 1)
SELECT 'brier' AS metric, round(quantile_cont(b, 0.025) + 1e-9, 6) AS low, round(quantile_cont(b, 0.975) + 1e-9, 6) AS high FROM q UNION ALL SELECT 'base_rate', round(quantile_cont(a, 0.025) + 1e-9, 6), round(quantile_cont(a, 0.975) + 1e-9, 6) FROM q""",
    "monotonicity": f"WITH {_R} SELECT 'a>=b' AS chain, count(*) FILTER (f_tax > f_disc) AS violations FROM r UNION ALL SELECT 'c>=b>=a', count(*) FILTER (coalesce(f_tax > f_qty, false) OR coalesce(f_disc > f_tax, false)) FROM r",
    "mention_buckets": f"WITH {_M}, {_B.replace('(SELECT DISTINCT security_id FROM m) s', "(SELECT security_id FROM m UNION SELECT 'quiet') s")} SELECT security_id, CAST(bucket AS INTEGER) AS bucket, mentions FROM b",
    "baseline_score": f"""WITH {_M}, {_B}, s AS (SELECT security_id, CAST(sum(mentions) FILTER (bucket = {BASELINE}) AS BIGINT) AS current, CAST(sum(mentions) FILTER (bucket = {BASELINE - 1}) AS BIGINT) AS previous, avg(mentions) FILTER (bucket < {BASELINE}) mean, var_pop(mentions) FILTER (bucket < {BASELINE}) variance FROM b GROUP BY 1)
SELECT security_id, current, previous, round(current / 6.0, 4) AS velocity, round((current - previous) / 36.0, 4) AS acceleration, round(mean, 4) AS mean, round(variance, 4) AS variance, round(greatest(0, least(100, 50 + 10 * (current - mean) / greatest(1, sqrt(variance + mean + 1)))), 4) AS score FROM s""",
    "author_independence": f"""WITH {_M}, a AS (SELECT security_id, author, count(*) n, count(*) FILTER (k % 9 = 0) c FROM m GROUP BY 1, 2), s AS (SELECT security_id, CAST(sum(n) AS BIGINT) AS mentions, count(author) AS authors, sum(n) FILTER (author IS NOT NULL) kn, max(n) FILTER (author IS NOT NULL) mx, sum(c) c FROM a GROUP BY 1)
SELECT security_id, mentions, authors, round(coalesce(kn, 0) / mentions, 6) AS coverage, round(mx / kn, 6) AS largest_share, round(100 * (authors / kn) * (1 - c / mentions) * (1 - 0.5 * mx / kn) * least(1.0, authors / 3), 6) AS independence FROM s""",
    "hhi_diversity": f"WITH {_M}, p AS (SELECT security_id, k % 4 AS source, count(*) n FROM m GROUP BY 1, 2) SELECT security_id, count(*) AS sources, string_agg(source || ':' || n, ',' ORDER BY source) AS counts, round(sum(n * n) / (sum(n) * sum(n)), 6) AS concentration, round(100 * (1 - sum(n * n) / (sum(n) * sum(n))), 6) AS diversity FROM p GROUP BY 1",
    "stale_sources": f"SELECT provider AS family, max(epoch_us(first_seen_at)) AS watermark_us, {NOW_US} - max(epoch_us(first_seen_at)) > 3600000000 AS stale FROM raw_source_items WHERE epoch_us(first_seen_at) <= {NOW_US} GROUP BY 1",
    "halt_enrichment": f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY halt_at DESC, first_seen_at DESC, resumption_trade_at DESC NULLS LAST) rn FROM halt_observations WHERE ticker IS NOT NULL AND epoch_us(halt_at) <= {NOW_US}) SELECT ticker, resumption_trade_at IS NULL OR epoch_us(resumption_trade_at) > {NOW_US} AS halted FROM l WHERE rn = 1",
    "gated_features": f"""WITH /*OBSERVATIONS*/, x AS (SELECT *, lag(close) OVER w prev, lag(us) OVER w bf FROM ob WHERE us IS NOT NULL WINDOW w AS (PARTITION BY security_id ORDER BY us, observation_id))
SELECT observation_id, round((close / CASE WHEN prev > 0 THEN prev END - 1) * 100, 4) AS return_pct, round(close * volume, 2) AS dollar_volume, round((ask - bid) / nullif(close, 0) * 100, 4) AS spread_pct, round(volume / nullif(free_float, 0), 8) AS float_rotation FROM x WHERE len(missing_flags) = 0 AND bf IS NOT NULL""",
    "alert_outcomes": f"""WITH /*OBSERVATIONS*/, {_AL}, q AS (SELECT ticker, us, close FROM ob WHERE us IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)), h AS (SELECT CAST(unnest([5, 15, 30, 60]) AS INTEGER) horizon),
f AS (SELECT al.alert_id, arg_max(q.close, (q.us, q.close)) ref FROM al JOIN q ON q.ticker = al.ticker AND q.us <= start_us GROUP BY 1),
o AS (SELECT al.alert_id, h.horizon, count(q.us) AS observations, arg_max(q.close, (q.us, q.close)) AS last, max(q.close) AS highest, min(q.close) AS lowest FROM al CROSS JOIN h LEFT JOIN q ON q.ticker = al.ticker AND q.us > start_us AND q.us <= start_us + horizon::BIGINT * 60000000 WHERE start_us IS NOT NULL GROUP BY 1, 2),
z AS (SELECT o.*, ref, observations > 0 AND coalesce(ref <> 0, false) AS complete FROM o LEFT JOIN f USING (alert_id))
SELECT alert_id, horizon, observations, last, highest, lowest, complete, round(CASE WHEN complete THEN (last / ref - 1) * 100 END, 4) AS return_pct, round(CASE WHEN complete THEN (highest / ref - 1) * 100 END, 4) AS mfe_pct, round(CASE WHEN complete THEN (lowest / ref - 1) * 100 END, 4) AS mae_pct FROM z""",
    "invalidation_antijoin": f"WITH {_AL} SELECT alert_id FROM al WHERE alert_id NOT LIKE '%7' AND NOT (start_us BETWEEN 1764547200000000 AND 1767225600000000) AND NOT (start_us BETWEEN 1767000000000000 AND 1768000000000000)",
    "price_context_asof": f"""WITH e AS (SELECT DISTINCT event_id id, upper(trim(ticker)) ticker, epoch_us(first_public_at) ev, epoch_us(available_at) kn FROM catalyst_events WHERE ticker IS NOT NULL AND first_public_at IS NOT NULL), o AS (SELECT ticker, epoch_us(first_seen_at) ob, epoch_us(processing_timestamp) av, close FROM market_observations WHERE ticker IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)),
b AS (SELECT e.id, arg_max(close, (ob, close)) v, max(ob) ob FROM e JOIN o ON o.ticker = e.ticker AND ob <= ev AND av <= kn GROUP BY 1) SELECT e.id, b.ob AS observed_us, b.v AS value FROM e LEFT JOIN b USING (id)""",
}

_Z = ", ".join(f"round((coalesce({f}, md_{f}) - mu_{f}) / sd_{f}, 12) z_{f}, ({f} IS NULL)::INTEGER::DOUBLE m_{f}" for f in FEATURES)
_ZN = [x for f in FEATURES for x in (f"z_{f}", f"m_{f}")]
_CELLS = f"""{_R}, tr AS (SELECT * FROM r WHERE as_of_us <= {TRAIN_END}), md AS (SELECT {", ".join(f"median({f}) md_{f}" for f in FEATURES)} FROM tr),
st AS (SELECT {", ".join(f"any_value(md_{f}) md_{f}, avg(coalesce({f}, md_{f})) mu_{f}, CASE WHEN var_pop(coalesce({f}, md_{f})) <= 1e-12 THEN 1 ELSE stddev_pop(coalesce({f}, md_{f})) END sd_{f}" for f in FEATURES)} FROM tr, md),
z AS (SELECT {_Z}, y FROM tr, st), c AS (SELECT {", ".join(_ZN)}, CAST(count(*) AS DOUBLE) w, sum(y) s FROM z GROUP BY {", ".join(_ZN)}), t AS (SELECT sum(w) n, sum(s) s FROM c)"""


def _descent(cells: str, names: list[str], first: list[str], error: str, shrink: list[str], steps: int, rate: float, decay: float) -> str:
    """Weights after gradient descent over the cells c(names, w, s) of total t(n, s), as a recursion over its steps."""
    value = " + ".join(["k[1]", *[f"k[{j + 2}] * {x}" for j, x in enumerate(names)]])
    slopes = ", ".join(f"k[{j + 1}] - {rate} / sqrt(1 + i / {decay}) * (g[{j + 1}] / n + {p})" for j, p in enumerate(shrink))
    sums = ", ".join(["sum(e)", *[f"sum(e * {x})" for x in names]])
    return f"""WITH RECURSIVE {cells}, it AS (SELECT 0 AS i, [{", ".join(first)}] AS k FROM t UNION ALL
SELECT i + 1, [{slopes}] FROM (SELECT i, k, any_value(n) n, [{sums}] g FROM (SELECT i, k, t.n, {", ".join(names)}, {error.format(value)} e FROM it, c, t WHERE i < {steps}) GROUP BY i, k)),
u AS (SELECT unnest({["intercept", *names]}) AS feature, unnest(k) AS v FROM it WHERE i = {steps}) SELECT feature, round(v + 1e-9, 6) AS weight FROM u"""


_SIG = "w / (1 + exp(-greatest(-40, least(40, {})))) - c.s"
_DESCENTS = {
    "gd_logistic": _descent(_CELLS, _ZN, ["ln((t.s + 1) / (n + 2) / (1 - (t.s + 1) / (n + 2)))", *["0.0::DOUBLE"] * 6], _SIG, ["0", *[f"0.08 * k[{j}]" for j in range(2, 8)]], 280, 0.08, 100.0),
    "gd_ridge": _descent(_CELLS, _ZN, ["t.s / n", *["0.0::DOUBLE"] * 6], "w * ({}) - c.s", ["0", *[f"0.10 * k[{j}]" for j in range(2, 8)]], 360, 0.025, 150.0),
    "platt": _descent(
        f"{_R}, q AS (SELECT least(greatest(p, 1e-8), 1 - 1e-8) q, y FROM r WHERE as_of_us BETWEEN {CALIBRATION[0]} AND {CALIBRATION[1]}), c AS (SELECT round(ln(q / (1 - q)), 12) slope, CAST(count(*) AS DOUBLE) w, sum(y) s FROM q GROUP BY 1), t AS (SELECT sum(w) n, sum(s) s FROM c)",
        ["slope"], ["0.0::DOUBLE", "1.0::DOUBLE"], _SIG, ["0", "0.02 * (k[2] - 1)"], 220, 0.05, 100.0,
    ),
}

SQL = {k: re.sub(r", (\d)\) AS ", lambda m: f" + 1e-{int(m[1]) + 3}::DOUBLE, {m[1]}) AS ", q).replace("/*OBSERVATIONS*/", OBSERVATIONS) for k, q in SQL.items()} | _DESCENTS
