import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import files, normalise, rest, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


BAR_HEAD = "security_id,timestamp,session,open,high,low,close,volume,available_at,source,source_url,feed,extra\n"


@pytest.fixture
def market(tmp_path):
    put(tmp_path / "metadata.json", json.dumps({"provider": "p", "dataset_kind": "k", "retrieved_at": "2026-03-02T20:00:00Z", "minute_dates": ["2026-03-02"]}))
    put(tmp_path / "instruments.csv", "security_id,ticker,available_at,effective_from,free_float,is_delisted\nS,ZA,2026-01-01T00:00:00Z,2026-01-01T00:00:00+01:00, ,Yes\n")
    put(tmp_path / "bars_1m.csv", BAR_HEAD + "S,2026-03-02T14:30:00Z,regular,1,2,1,2,10,2026-03-02T14:31:00Z,s,https://x.invalid/a,f,zz\n")
    put(tmp_path / "bars_1d.csv", BAR_HEAD)
    return tmp_path


def test_market_directory(spark, market):
    d = files.market_directory(spark, str(market))
    i = d.tables["instruments"].first()
    assert (i["free_float"], i["is_delisted"], i["sector"]) == (None, True, None)
    assert d.tables["bars"].count() == 1 and d.tables["halts"].count() == 0 and d.manifest["provider"] == "p"
    both = files.composite([d, files.Dataset(d.tables, d.manifest | {"provider": "q", "notes": ["n"]})])
    assert both.tables["bars"].count() == 2 and both.manifest["provider"] == "p+q" and both.manifest["notes"] == ["n"]


def test_missing_files_and_naive_times_fail(spark, market):
    put(market / "bars_1m.csv", BAR_HEAD + "S,2026-03-02T14:30:00,regular,1,2,1,2,10,2026-03-02T14:31:00Z,s,u,f,\n")
    with pytest.raises(PySparkException, match="no instant with an offset"):
        files.market_directory(spark, str(market)).tables["bars"].collect()
    put(market / "bars_1m.csv", BAR_HEAD + "S,2026-03-02T14:30:00Z,regular,1,2,1,2,ten,2026-03-02T14:31:00Z,s,u,f,\n")
    with pytest.raises(PySparkException, match="not a bigint"):
        files.market_directory(spark, str(market)).tables["bars"].collect()
    (market / "bars_1d.csv").unlink()
    with pytest.raises(files.SourceError, match="bars_1d"):
        files.market_directory(spark, str(market))
    put(market / "metadata.json", "{}")
    with pytest.raises(files.SourceError, match="lacks"):
        files.market_directory(spark, str(market))


def test_document_lines(spark, tmp_path):
    put(tmp_path / "metadata.json", json.dumps({"provider": "p", "dataset_kind": "k", "fetched_at": "2026-03-02T20:00:00Z"}))
    row = {"document_id": "d", "published_at": "2026-03-02T20:00:00+02:00", "form_items": ["1.01"], "structured_numerical_details": [{"kind": "money", "value": 2.5}]}
    put(tmp_path / "documents.jsonl", json.dumps(row) + "\n\n" + json.dumps({"document_id": "e"}) + "\n")
    docs = files.document_directory(spark, str(tmp_path)).tables["documents"]
    got = {r["document_id"]: r for r in docs.withColumn("us", F.unix_micros("published_at")).collect()}
    assert got["d"]["us"] == 1_772_474_400_000_000 and got["d"]["structured_numerical_details"][0]["value"] == 2.5 and got["e"]["us"] is None
    put(tmp_path / "documents.jsonl", "{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.document_directory(spark, str(tmp_path)).tables["documents"].collect()


def test_paged_bars_to_rows(spark):
    spark.dataSource.register(rest.PagedBars)
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("fake_transport.py")))
    raw = spark.read.format("paged_bars").options(endpoint="https://data.example.invalid/v2/bars", allow="https://data.example.invalid/v2", symbols="ZA", start="2026-03-02", end="2026-03-03", pace="0.1", transport="fake_transport:make", pages="5").load()
    names = spark.createDataFrame([("S", "ZA")], "security_id string, ticker string")
    bars, dropped = normalise.normalise_bars(raw, names, "1m", feed="iex")
    assert [(r["session"], r["volume"]) for r in bars.orderBy("timestamp").collect()] == [("premarket", 5), ("regular", 7)]
    assert {r["feed"] for r in bars.collect()} == {"iex"}
    assert tuple(normalise.reconcile(3, bars, dropped).first()) == (3, 2, 1, True) and not normalise.reconcile(3, bars.limit(1), dropped).first()["reconciled"]
    with pytest.raises(PySparkException, match="unknown symbol"):
        normalise.normalise_bars(raw, names.limit(0), "1m")[0].collect()


def test_requests():
    wait = []
    answers = iter([(429, {"Retry-After": "3"}, ""), OSError("lost"), (500, {"X-RateLimit-Reset": "108"}, ""), (200, {}, '{"a": 1}')])

    def transport(url):
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert rest.fetch(transport, "u", sleep=wait.append, clock=lambda: 100.0) == {"a": 1} and wait == [3.0, 2.0, 8.0]
    with pytest.raises(rest.RequestFailed, match="404"):
        rest.fetch(lambda u: (404, {}, ""), "u")
    with pytest.raises(rest.RequestFailed, match="attempts"):
        rest.fetch(lambda u: (503, {}, ""), "u", attempts=2, sleep=wait.append)
    with pytest.raises(rest.RequestFailed, match="twice"):
        list(rest.pages(lambda u: (200, {}, '{"next_page_token": "x"}'), "u?", 9))
    assert rest.retry_delay(9, {}, 0.0) == 30.0 and rest.retry_delay(1, {"Retry-After": "Thu, 01 Jan 1970 00:00:05 GMT"}, 1.0) == 4.0
    ok = ("https://a.invalid/v2",)
    assert rest.allowed("https://a.invalid/v2/bars?x", ok)
    asked = []
    list(rest.pages(lambda u: asked.append(u) or (200, {}, '{"next_page_token": %s}' % ('"a+/=="' if len(asked) < 2 else "null")), "u?", 9))
    assert asked[1].endswith("page_token=a%2B%2F%3D%3D")
    assert not any(rest.allowed(u, ok) for u in ("http://a.invalid/v2", "https://a.invalid/v21", "https://b.a.invalid/v2", "https://a.invalid.evil/v2"))


def test_halt_feed_and_submissions(spark):
    xml = '<rss xmlns:n="u"><item><n:IssueSymbol>ZA</n:IssueSymbol><n:HaltDate>03/02/2026</n:HaltDate><n:HaltTime>09:31:05.123</n:HaltTime><n:ReasonCode>T1</n:ReasonCode></item><item><n:IssueSymbol/><n:HaltDate>03/02/2026</n:HaltDate></item></rss>'
    h = normalise.halt_feed(spark.createDataFrame([(xml,), ("",)], "xml string")).withColumn("us", F.unix_micros("halt_at")).collect()
    assert [(r["ticker"], r["us"], r["resumption_trade_at"], len(r["halt_id"])) for r in h] == [("ZA", 1_772_461_865_000_000, None, 64)]
    p = json.dumps({"accessionNumber": ["1", "2", "3"], "form": ["8-K", "4", "8-K"], "acceptanceDateTime": ["2026-03-02T10:00:00Z", "2026-03-02T10:00:00Z"]})
    s = spark.createDataFrame([("i", p, None), ("j", "x", None)], "issuer_id string, payload string, received_at timestamp")
    assert [r["accession_number"] for r in normalise.submissions(s, ("8-K",)).collect()] == ["1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k", 1)], "b string, a int").withColumn("t", F.timestamp_micros(F.lit(5)))
    sinks.write_jsonl(df, str(tmp_path / "j"))
    line = next(p for p in (tmp_path / "j").iterdir() if p.suffix == ".json" and p.stat().st_size).read_text().strip()
    assert line == '{"a":1,"b":"k","t":"1970-01-01T00:00:00.000005Z"}'
    with pytest.raises(PySparkException):
        sinks.write_jsonl(df, str(tmp_path / "j"))
    store = sinks.RecordStore(spark, str(tmp_path / "s"))
    rec = lambda *r: spark.createDataFrame(list(r), "key string, body string")
    store.append(rec(("a", "1"), ("a", "1"), (None, "2")), 1)
    store.append(rec(("a", "1"), ("b", "2")), 2)
    store.append(rec(("a", "1"), ("b", "2")), 2)
    assert sorted((r["key"], r["batch"]) for r in store.table().collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(sinks.ConflictError):
        store.append(rec(("a", "other")), 3)
    with pytest.raises(sinks.ConflictError):
        store.append(rec(("c", "1"), ("c", "2")), 3)
    assert store.table().count() == 2
    s = sinks.run_summary(spark.createDataFrame([("x", 1, 5), ("x", 2, 6)], "k string, us long, v long"), ["k"], ["us"]).collect()
    assert [tuple(r) for r in s] == [("x", 2, 2, 6)]
