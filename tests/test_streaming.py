import json

from tidemark.operators import monitoring
from tidemark.sources.sinks import ConflictError
from tidemark.streaming import monitor as M


def write(path, rows):
    path.mkdir(exist_ok=True)
    n = len(list(path.iterdir()))
    (path / f"{n:03}.json").write_text("\n".join(map(json.dumps, rows)))


def run(stream, name, checkpoint, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start() if checkpoint else None
    q.awaitTermination()
    assert q.exception() is None


def test_replay_writes_once_and_survives_a_restart(spark, tmp_path):
    a, b = {"family": "f", "id": "1", "x": 1}, {"family": "f", "id": "2"}
    (tmp_path / "c.json").write_text(json.dumps({"cycles": [[a, a], [a, b], []]}))
    spark.dataSource.register(M.ReplayCycles)
    m = M.Monitor(spark, str(tmp_path / "out"))
    for _ in range(2):
        q = m.start(spark.readStream.format("replay_cycles").option("path", str(tmp_path / "c.json")).load(), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(r["key"] for r in m.normalised.table().collect()) == ["f|1", "f|2"]
    assert m.raw.table().count() == 2 and m.beats.table().count() >= 1
    other = spark.createDataFrame([(9, "f", json.dumps({"family": "f", "id": "1", "x": 2}))], "cycle int, family string, record string")
    try:
        m.write(other, 99)
        raise AssertionError("a changed record was accepted")
    except ConflictError:
        pass


def test_first_sight_of_an_issuer_seeds(spark, tmp_path):
    src = tmp_path / "in"
    schema = "issuer_id string, accession_number string"
    for k, rows in enumerate(([("i", "a"), ("i", "b")], [("i", "b"), ("i", "c"), ("j", "x")], [("i", "c"), ("j", "y")])):
        write(src, [dict(zip(("issuer_id", "accession_number"), r)) for r in rows])
        stream = spark.readStream.schema(schema).json(str(src))
        q = M.new_filings(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n, k=k: df.write.mode("append").json(str(tmp_path / f"o{k}"))).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [sorted((r["issuer_id"], r["accession_number"] or "", r["seeded"]) for r in spark.read.schema(M.SEEN_OUT).json(str(tmp_path / f"o{k}")).collect()) for k in range(3)]
    assert got == [[("i", "", 2)], [("i", "c", 0), ("j", "", 1)], [("j", "y", 0)]]


def test_outcomes_are_frozen_and_equal_the_batch(spark, tmp_path):
    minute = monitoring.MINUTE_US
    rows = [("T", "a1", 8.0, 0), ("T", "a2", None, 0), *[("T", None, 10.0 + k % 7, k * minute) for k in range(1, 70)], ("T", None, None, 70 * minute)]
    late = [("T", None, 99.0, 3 * minute), ("T", None, None, 90 * minute)]
    src, schema = tmp_path / "in", "ticker string, alert_id string, close double, us long"
    for part in (rows, late):
        write(src, [dict(zip(("ticker", "alert_id", "close", "us"), r)) for r in part])
        q = M.streaming_outcomes(spark.readStream.schema(schema).json(str(src))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "o"))).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect()))
    alerts = spark.createDataFrame([("a1", "T", 0, 8.0), ("a2", "T", 0, None)], "alert_id string, ticker string, start_us long, reference double")
    seen = spark.createDataFrame([(t, u, c) for t, a, c, u in rows if c and not a], "ticker string, us long, close double")
    want = sorted(map(tuple, monitoring.outcomes(alerts, seen).collect()))
    assert got == want and [g[2] for g in got] == [5, 15, 30, 60] * 2
    assert [g[6] for g in got] == [True] * 4 + [False] * 4 and got[0][7:] == (87.5, 87.5, 37.5)


def test_restart_delay():
    assert [M.restart_delay(k, 1.0, 10.0) for k in (1, 2, 3, 9)] == [1.0, 2.0, 4.0, 10.0]


def test_supervisor_restarts_and_says_so(spark, tmp_path):
    a, b = {"family": "f", "id": "1", "us": 100}, {"family": "g", "id": "2", "us": 5}
    (tmp_path / "c.json").write_text(json.dumps({"cycles": [[a, b]]}))
    spark.dataSource.register(M.ReplayCycles)
    m, waits, runs = M.Monitor(spark, str(tmp_path / "out"), stale_us=50, clock_us=lambda: 120), [], []

    def broken(df, n):
        raise RuntimeError("lost")

    def start():
        runs.append(1)
        stream = spark.readStream.format("replay_cycles").option("path", str(tmp_path / "c.json")).load()
        if len(runs) < 3:
            return stream.writeStream.foreachBatch(broken).option("checkpointLocation", str(tmp_path / f"cp{len(runs)}")).trigger(availableNow=True).start()
        return m.start(stream, str(tmp_path / "cp"))

    assert M.supervise(m, start, cycles=2, sleep=waits.append) == 2 and waits == [1.0, 2.0] and len(runs) == 4
    bodies = [json.loads(r["body"]) for r in m.beats.table().collect()]
    assert sorted(x["status"] for x in bodies if x["status"] != "running") == ["degraded", "reconnecting", "reconnecting", "stopped"]
    assert next(x for x in bodies if x["status"] == "degraded")["stale"] == ["g"]

    class Interrupted:
        stopped = False

        def awaitTermination(self):  # noqa: N802
            raise KeyboardInterrupt

        def stop(self):
            self.stopped = True

    q = Interrupted()
    assert M.supervise(m, lambda: q) == 0 and q.stopped
