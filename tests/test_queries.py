"""Every query with SQL gives the rows DuckDB gives; the package works without its optional subpackage."""

import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest

from tidemark.plans import registry

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def tidy(rows, order):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float | Decimal) else v
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    cur = duck.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert tidy(df.collect(), range(len(df.columns))) == tidy(cur.fetchall(), [names.index(c) for c in df.columns])


def test_llm_is_optional_and_nothing_else_imports_it():
    for p in (ROOT / "tidemark").rglob("*.py"):
        assert "llm" in p.parts or "tidemark.llm" not in p.read_text(), p
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith(('p5', 'p8', 'p9', 'p10')) for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_sources_are_plain():
    """No random split or sample in the library: time series are split by time only."""
    for p in (ROOT / "tidemark").rglob("*.py"):
        text = p.read_text()
        assert not any(w in text for w in (".randomSplit(", ".sample(", "localCheckpoint", "train_test_split")), p
