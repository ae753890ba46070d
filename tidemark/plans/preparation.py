"""Queries of the data-preparation problems 1 to 4, 6 and 7 and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clocks, deliveries, grid, intervals, knownat, lateness
from tidemark.plans import clocksql
from tidemark.plans.tables import spread, table
from tidemark.session import scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]

#: Batches in which p1 and p6 apply their tables to their stores.
DELIVERY_WAVES, ARRIVAL_BATCHES = 2, 2


def _parts(rows: DataFrame, at: Column, n: int) -> list[DataFrame]:
    """rows in n parts of equal ranges of a whole number, the parts in order; rows without it are in the last."""
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    if lo is None or n < 2:
        return [rows]
    step = (hi - lo) // n + 1
    part = F.coalesce(F.floor((at - lo) / step), F.lit(n - 1))
    return [rows.filter(part == k) for k in range(n)]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries come in waves of consecutive batches."""
    rows = table(spark, d, "raw_source_items")
    return deliveries.repeated_deliveries(rows, _parts(rows, F.col("batch_id"), DELIVERY_WAVES))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.halt_periods(table(spark, d, "halt_observations"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clocks.records_to_normalise({t: table(spark, d, t) for t in clocks.CLOCK_TEXTS}, table(spark, d, "feed_zones"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.minute_grid(table(spark, d, "bars")).filter("missing").select("security_id", "slot_us")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    g = grid.minute_grid(table(spark, d, "bars"))
    return g.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("close_fit", "support")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows are applied in the order in which they were ingested: later batches hold rows known before earlier ones'."""
    docs = table(spark, d, "source_documents")
    store = lateness.PeriodStore(spark, scratch_path(spark, "periods"))
    for k, part in enumerate(_parts(docs, F.unix_micros("ingested_at"), ARRIVAL_BATCHES), 1):
        store.apply(lateness.arrivals(part), k)
    return lateness.corrected_periods(store.counts())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cols = ["security_id", "source_timestamp", "first_seen_at", "feed", "observation_id", "free_float", "halt_status"]
    seen = clocks.observation_instants(spread(table(spark, d, "market_observations").select(*cols)), table(spark, d, "feed_zones"))
    seen = stored(seen.select("security_id", "utc_us", "observation_id", "free_float", "halt_status"), "instants")
    return knownat.stale_attributes(seen, table(spark, d, "instruments"), table(spark, d, "halt_observations"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p2_found, p3_found, p4_found, p4_grid, p6_found, p7_found)}

SQL: dict[str, str] = {
    "p1_found": clocksql.P1,
    "p3_found": clocksql.P3,
    "p7_found": clocksql.P7,
    "p2_found": """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY halt_id ORDER BY first_seen_at DESC NULLS LAST, security_id DESC NULLS LAST, halt_at DESC NULLS LAST, resumption_trade_at DESC NULLS LAST) rn FROM halt_observations WHERE halt_id IS NOT NULL),
i AS (SELECT security_id, epoch_us(halt_at) s, coalesce(epoch_us(resumption_trade_at), 9000000000000000000) e FROM o WHERE rn = 1 AND security_id IS NOT NULL AND halt_at IS NOT NULL),
m AS (SELECT *, max(e) OVER (PARTITION BY security_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM i WHERE e > s),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM m),
p AS (SELECT security_id, k, min(s) s, max(e) e FROM g GROUP BY 1, 2),
n AS (SELECT *, lead(s) OVER (PARTITION BY security_id ORDER BY s) ns FROM p)
SELECT security_id, 'period' AS kind, s AS start_us, CASE WHEN e = 9000000000000000000 THEN -1 ELSE e END AS end_us FROM n
UNION ALL SELECT security_id, 'gap', e, ns FROM n WHERE ns IS NOT NULL""",
    "p4_found": """
WITH r AS (SELECT DISTINCT security_id, epoch_us(timestamp) // 60000000 AS slot FROM bars WHERE timeframe = '1m' AND security_id IS NOT NULL AND timestamp IS NOT NULL AND close IS NOT NULL AND NOT isnan(close)),
n AS (SELECT security_id, slot, lead(slot) OVER (PARTITION BY security_id, slot // 1440 ORDER BY slot) nx FROM r)
SELECT security_id, CAST(unnest(range(slot + 1, nx)) * 60000000 AS BIGINT) AS slot_us FROM n WHERE nx > slot + 1""",
    "p4_grid": f"""
WITH r AS (SELECT security_id, epoch_us(timestamp) us, max((epoch_us(available_at), close, volume)) m FROM bars WHERE timeframe = '1m' AND security_id IS NOT NULL AND timestamp IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) GROUP BY 1, 2),
x AS (SELECT security_id, us, us // 60000000 slot, us // 86400000000 dy, m[2] y, m[3] v FROM r),
o AS (SELECT security_id, slot, count(*) n, arg_max(y, us) AS last, CAST(sum(v) AS BIGINT) v FROM x GROUP BY 1, 2),
g AS (SELECT security_id, dy, unnest(range(min(slot), max(slot) + 1)) slot FROM x GROUP BY 1, 2),
k AS (SELECT g.security_id, g.slot, (us - g.slot * 60000000) / 60000000.0::DOUBLE d, y FROM g JOIN x ON x.security_id = g.security_id AND x.dy = g.dy AND x.slot >= g.slot - {grid.BANDWIDTH} AND x.slot < g.slot + {grid.BANDWIDTH} AND NOT isinf(y)),
w AS (SELECT *, 1 - (d / {grid.BANDWIDTH}) * (d / {grid.BANDWIDTH}) w FROM k),
f AS (SELECT security_id, slot, sum(w) a, sum(w * d) b, sum(w * d * d) c, sum(w * y) t, sum(w * d * y) u, sum(w * w) q FROM w GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN q > 1e-12 THEN a * a / q ELSE 0 END sup, a * c - b * b det FROM f)
SELECT g.security_id, g.slot * 60000000 AS slot_us, CASE WHEN sup >= {grid.MIN_SUPPORT} - 1e-9 THEN round(CASE WHEN det > {grid.MIN_SPREAD} * a * a THEN (c * t - b * u) / det ELSE t / a END + 1e-7::DOUBLE, 4) END AS close_fit, o.last AS close, o.v AS volume, coalesce(o.n, 0) AS readings, round(coalesce(sup, 0) + 1e-7::DOUBLE, 4) AS support, o.n IS NULL AS missing
FROM g LEFT JOIN h ON h.security_id = g.security_id AND h.slot = g.slot LEFT JOIN o ON o.security_id = g.security_id AND o.slot = g.slot""",
    "p6_found": """
WITH k AS (SELECT document_id, ticker, CAST(timezone('UTC', published_at) AS DATE) AS day, epoch_us(published_at) pus, epoch_us(coalesce(available_at, first_seen_at)) us FROM source_documents WHERE document_id IS NOT NULL AND published_at IS NOT NULL AND coalesce(available_at, first_seen_at) IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY us, pus, ticker) rn FROM k) WHERE rn = 1),
c AS (SELECT ticker, strftime(day, '%Y-%m-%d') AS period_day, (datediff('day', DATE '1970-01-01', day) + 1) * 86400000000 AS cl, us FROM f)
SELECT ticker, period_day, count(*) FILTER (us <= cl) AS docs_at_close, count(*) FILTER (us <= cl + 172800000000) AS docs_final, count(*) FILTER (us > cl + 172800000000) AS docs_dropped
FROM c GROUP BY 1, 2 HAVING count(*) FILTER (us <= cl + 172800000000) > count(*) FILTER (us <= cl) OR count(*) FILTER (us > cl + 172800000000) > 0""",
}
