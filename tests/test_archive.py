"""Archive of answers, run folders, settings, pace, and polled snapshots."""

import json
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive, files, schemas, settings, sinks, snapshots

NOW = datetime(2026, 3, 2, 15, 0, tzinfo=UTC)


def test_archive_serves_only_what_it_can_trust(tmp_path):
    a = archive.Archive(str(tmp_path), "p", "licence")
    ask = lambda now=NOW, age=1: a.cached("https://x.invalid/?a", "1Min", now, timedelta(hours=age))
    assert ask() is None
    old, new = archive.Answer("https://x.invalid/?a", 200, {"Date": "d", "Authorization": "secret"}, b"[1]", NOW - timedelta(hours=2)), archive.Answer("https://x.invalid/?a", 200, {}, b"[2]", NOW - timedelta(minutes=5))
    for x in (old, new, new, archive.Answer("https://x.invalid/?a", 503, {}, b"", NOW)):
        a.keep(x, "1Min")
    assert ask().body == b"[2]" and ask(NOW + timedelta(hours=2)) is None
    assert not any("secret" in p.read_text() for p in tmp_path.rglob("*.json"))
    assert a.cached("https://x.invalid/?b", "1Min", NOW, timedelta(hours=1)) is None and archive.Archive(str(tmp_path), "q", "licence").cached("https://x.invalid/?a", "1Min", NOW, timedelta(9)) is None
    with pytest.raises(archive.ArchiveError, match="not an answer"):
        ask(NOW - timedelta(hours=1))  # from the future
    body = tmp_path / "bodies" / archive.digest(b"[2]")[:2] / archive.digest(b"[2]")
    body.write_bytes(b"[3]")
    with pytest.raises(archive.ArchiveError, match="lost or changed"):
        ask()
    with pytest.raises(archive.ArchiveError, match="another content"):
        a.keep(new, "1Min")


def test_archived_transport_asks_once(tmp_path):
    a, calls = archive.Archive(str(tmp_path), "p", "l"), []
    get = a.transport(lambda u: calls.append(u) or (200, {}, "{}"), "1Min", timedelta(hours=1), lambda: NOW)
    assert get("u") == get("u") == (200, {}, "{}") and calls == ["u"]
    with pytest.raises(archive.ArchiveError, match="not in the archive"):
        a.transport(None, "1Min", timedelta(hours=1), lambda: NOW, only_cached=True)("v")


def test_run_folder_is_written_once(tmp_path):
    config = tmp_path / "c.json"
    config.write_text("{}")
    run = archive.RunFolder(str(tmp_path / "runs"), NOW, config)
    run.write("a.txt", b"x")
    with pytest.raises(archive.ArchiveError):
        run.write("a.txt", b"y")
    assert run.close(n=1)["files"] == {"a.txt": archive.digest(b"x")}
    with pytest.raises(archive.ArchiveError, match="there is a run"):
        archive.RunFolder(str(tmp_path / "runs"), NOW)
    other = archive.RunFolder(str(tmp_path / "runs"), NOW + timedelta(1), config)
    config.write_text("{ }")
    with pytest.raises(archive.ArchiveError, match="changed"):
        other.close()


def test_requests_are_bounded():
    good = settings.Request((NOW - timedelta(days=4), NOW - timedelta(days=1)), (NOW - timedelta(days=60), NOW - timedelta(days=1)), (("S", "ZA"),), (date(2026, 2, 27),))
    good.validate(NOW)
    bad = settings.Request((NOW - timedelta(days=40), NOW), (NOW - timedelta(days=39), NOW), (("S", "za"), ("S", "ZB"), ("", "ZC")), (date(2026, 2, 28), date(2026, 3, 9)), "x", "y", (), 3, 0, 1, 0)
    assert len(bad.problems(NOW)) == 14
    with pytest.raises(settings.SettingsError, match="UTC"):
        good.validate(NOW.replace(tzinfo=None))
    with pytest.raises(settings.SettingsError):
        settings.as_of_guard(NOW, NOW - timedelta(1))


def test_settings_files(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nexport A='1 $B'\nB=2\nC = x\n")
    assert settings.environment(env, {"B": "9"}) == {"A": "1 $B", "B": "9", "C": "x"} and settings.environment(tmp_path / "none", {"B": "9"}) == {"B": "9"}
    for text, why in (("A=1\nA=2", "again"), ("1A=2", "assignment"), ("A", "assignment"), ("A='x", "quote"), ("A=x\0", "null")):
        env.write_text(text)
        with pytest.raises(settings.SettingsError, match=why):
            settings.environment(env, {})
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"a": [{"My_Api_Key": "x"}], "secret_key": 1}))
    with pytest.raises(settings.SettingsError, match="My_Api_Key.*secret_key"):
        settings.read_settings(path)
    path.write_text('{"keys": 1}')
    assert settings.read_settings(path) == {"keys": 1} and settings.inside(tmp_path, "x/y") == (tmp_path / "x/y").resolve()
    with pytest.raises(settings.SettingsError, match="leads out"):
        settings.inside(tmp_path, "../x")


def test_pace():
    now, slept = [0.0], []
    pace = settings.Pace(0.5, lambda: now[0], slept.append)
    for step in (0.0, 0.2, 5.0):
        now[0] += step
        pace.wait()
    assert slept == [0.3] and pytest.raises(settings.SettingsError, settings.Pace, 0.01)


def test_snapshots_halts_and_alerts(spark):
    payload = {"ZA": {"minuteBar": {"t": "2026-03-02T14:58:00Z", "c": 2.5, "v": 7}, "latestQuote": {"t": "x", "bp": 2.4, "ap": 2.6}}, "ZB": {"minuteBar": {"t": "2026-03-02T14:59:30Z", "c": 1.0, "v": 1}}}
    raw = spark.createDataFrame([(json.dumps(payload), NOW)], "payload string, received_at timestamp")
    names = spark.createDataFrame([("S", "za"), ("T", "ZB"), ("U", "ZC")], "security_id string, ticker string")
    o = snapshots.snapshots(raw, names, "iex")
    got = {r["ticker"]: r for r in o.collect()}
    assert (got["ZA"]["close"], got["ZA"]["ask"], got["ZA"]["bar_complete"]) == (2.5, 2.6, True) and got["ZC"]["source_timestamp"] == got["ZC"]["first_seen_at"]
    assert "INCOMPLETE_BAR" in got["ZB"]["missing_flags"] and {"MISSING_BAR", "MISSING_QUOTES", "NON_CONSOLIDATED_COVERAGE"} <= set(got["ZC"]["missing_flags"])
    us = int(NOW.timestamp()) * 1_000_000
    h = spark.createDataFrame([("ZA", NOW - timedelta(hours=1), None, NOW), ("ZB", NOW - timedelta(hours=2), NOW - timedelta(hours=1), NOW), ("ZC", NOW + timedelta(hours=2), None, NOW)], "ticker string, halt_at timestamp, resumption_trade_at timestamp, first_seen_at timestamp")
    now = {r["ticker"]: (r["halt_status"], "MISSING_HALT_STATUS" in r["missing_flags"]) for r in snapshots.with_halt_status(o, h, True, us).collect()}
    assert now == {"ZA": ("halted", False), "ZB": ("not_halted", False), "ZC": ("not_halted", False)}
    assert {(r["halt_status"], "MISSING_HALT_STATUS" in r["missing_flags"]) for r in snapshots.with_halt_status(o, h, False, us).collect()} == {(None, True)}
    assert snapshots.with_halt_status(o, None, True, us) is o
    e = spark.createDataFrame([("e1", "ZA"), ("e2", "ZZ")], "event_id string, ticker string")
    f = spark.createDataFrame([("ZA", "f1", ["X"])], "ticker string, feature_id string, flags array<string>")
    a = {r["event_id"]: (r["security_id"], r["reference_price"], r["feature_id"], r["flags"]) for r in snapshots.alert_context(e, o, f).collect()}
    assert a == {"e1": ("S", 2.5, "f1", ["X"]), "e2": ("unresolved:ZZ", None, None, ["MISSING_MARKET_OBSERVATION"])}
    c = snapshots.one_cycle({"market_data": o, "news": e})
    assert c.groupBy("source_family").count().count() == 2 and c.filter("source_family = 'news'").first()["record"].startswith("{")


def test_batch_directories(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t)
    put("metadata.json", json.dumps({"provider": "p", "dataset_kind": "k", "fetched_at": "x", "monitored_securities": [{"security_id": "S", "ticker": "ZA"}], "sources": [{"source": "reddit", "collection_authorization_confirmed": True, "coverage_started_at": "2026-01-01T00:00:00Z"}], "feature_names": ["f"]}))
    put("mentions.jsonl", json.dumps({"mention_id": "m", "account_quality_basis": "b"}) + "\n")
    put("price_context.jsonl", json.dumps({"security_id": "S", "cumulative_return_pct": 1.5, "observed_at": "2026-01-01T00:00:00+01:00"}) + "\n")
    put("rows.jsonl", json.dumps({"observation_id": "o", "touch_up_05": True, "mfe_pct": 6.5, "fill_status": "filled", "features": {"f": None, "g": 1.0}}) + "\n")
    d = files.mention_directory(spark, str(tmp_path)).tables
    assert d["catalysts"].count() == 0 and d["price_context"].first()["cumulative_return_pct"] == 1.5
    x = d["descriptors"].first()
    assert x["collection_authorization_confirmed"] is True and x["coverage_started_at"] is not None and x["terms_url"] is None
    r = files.model_directory(spark, str(tmp_path)).tables["rows"].first()
    assert r["touch_up_05"] and r["mfe_pct"] == 6.5 and r["features"] == {"f": None, "g": 1.0}
    put("rows.jsonl", '{"observation_id": "o"}\n\n{broken\n')
    assert [tuple(r) for r in files.broken_lines(spark, str(tmp_path / "rows.jsonl"), schemas.MODEL_ROW).collect()] == [("rows.jsonl", 3, "{broken")]


def test_a_run_is_written_with_its_quality(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, us long")
    issues = spark.createDataFrame([("X", "error", "a", 1), ("Y", "warning", None, None), ("X", "error", "b", 1)], "code string, severity string, entity_id string, us long")
    m = sinks.write_run(str(tmp_path / "r"), rows, issues, ["k"], ["us"], "2026")
    assert m == {"at": "2026", "rows": 3, "keys": 2, "errors": 2, "warnings": 1, "codes": {"X": 2, "Y": 1}}
    assert json.loads(spark.read.text(str(tmp_path / "r/run_manifest")).first()[0]) == m and spark.read.json(str(tmp_path / "r/rows")).select(F.sum("us")).first()[0] == 4
