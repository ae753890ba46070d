import random

import pytest

from tidemark.llm import nearest, queries

T0 = 1_760_000_000_000_000


@pytest.fixture
def many_parts(spark):
    """Range partitions stay apart, so that entities span several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(3))
def test_nearest_over_partition_edges(many_parts, seed):
    rng = random.Random(seed)
    side = lambda n, p: [(rng.choice(["hot"] * 6 + ["a", "b", None]), T0 + rng.randrange(4000) if rng.random() > 0.02 else None, f"{p}{rng.randrange(n)}") for _ in range(n)]
    left, right = side(500, "l"), side(900, "r")
    l = many_parts.createDataFrame([(*r, 1, "x") for r in left], "entity string, t long, id string, left int, partner string")  # noqa: E741
    r = many_parts.createDataFrame([(*r, 1, "x") for r in right], "entity string, t long, id string, left int, partner string")
    want = {}
    for e, t, i in left:
        near = [(abs(u - t), u, o) for x, u, o in right if x == e and x is not None and t is not None and u is not None and abs(u - t) <= 3]
        if near:
            want[i] = min([min(near), *([want[i]] if i in want else [])])
    got = {x["id"]: (x["distance"], x["t"], x["partner"]) for x in nearest.nearest_in_time(l, r, 3).collect()}
    assert got == want
    assert nearest.nearest_in_time(l.limit(0), r, 3).collect() == [] == nearest.nearest_in_time(l, r.limit(0), 3).collect()


def test_ticker_key(spark):
    df = spark.createDataFrame([(" ab ",), ("\u3000Ab\n",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(nearest.ticker_key(df["t"])).collect()] == ["AB", "AB", None, None]


def test_whole_tables_equal_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("market_observations", "catalyst_events", "feed_zones"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = sorted(con.execute(queries.SQL["p5_found"]).fetchall())
    assert want and sorted(tuple(r) for r in queries.p5_found(spark, data).collect()) == want
