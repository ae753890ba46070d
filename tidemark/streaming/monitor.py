"""The monitor as Structured Streaming: sources in cycles, state per key, and sinks that a replay doesn't double."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import monitoring
from tidemark.sources.sinks import RecordStore


class ReplayCycles(DataSource):
    """``readStream.format("replay_cycles").option("path", ...)``: a JSON file {"cycles": [[record, ...], ...]}; each poll
    gives one cycle's records as (cycle, family, record) until there are no more."""

    @classmethod
    def name(cls) -> str:
        return "replay_cycles"

    def schema(self) -> str:
        return "cycle int, family string, record string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Cycles(self.options["path"])


class _Cycles(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.cycles = json.load(f)["cycles"]

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def _rows(self, a: int, z: int) -> Iterator[tuple]:
        return iter([(k, r.get("family"), json.dumps(r, sort_keys=True)) for k in range(a, min(z, len(self.cycles))) for r in self.cycles[k]])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["cycle"]
        end = min(at + 1, len(self.cycles))
        return self._rows(at, end), {"cycle": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["cycle"], end["cycle"])


SEEN_OUT = "issuer_id string, accession_number string, bootstrap boolean, seeded long"
SEEN_STATE = "seen array<string>"


def unseen_filings(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per issuer: the first sight seeds its accession numbers and gives one bootstrap row and no filings; later only
    numbers not seen before come out."""
    numbers = sorted({a for b in batches for a in b["accession_number"] if a is not None})
    if not state.exists:
        state.update((numbers,))
        yield pd.DataFrame({"issuer_id": [key[0]], "accession_number": [None], "bootstrap": [True], "seeded": [len(numbers)]})
        return
    seen = set(state.get[0])
    new = [a for a in numbers if a not in seen]
    if new:
        state.update((sorted(seen | set(new)),))
        yield pd.DataFrame({"issuer_id": [key[0]] * len(new), "accession_number": new, "bootstrap": [False] * len(new), "seeded": [0] * len(new)})


def new_filings(filings: DataFrame) -> DataFrame:
    """Streaming filings (issuer_id, accession_number) reduced to those not seen before; see unseen_filings."""
    return filings.groupBy("issuer_id").applyInPandasWithState(unseen_filings, SEEN_OUT, SEEN_STATE, "append", GroupStateTimeout.NoTimeout)


OUTCOME_OUT = "alert_id string, horizon int, observations long, last double, highest double, lowest double, complete boolean, return_pct double, mfe_pct double, mae_pct double"
OUTCOME_STATE = "alerts string, prices string, clock_us long"


def frozen_outcomes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per ticker: outcomes of its alerts at each horizon, written once when the stream's clock has passed it.

    Rows are alerts (alert_id, with their reference price or null in close), prices (close) or clock ticks (neither), with
    us. Later arrivals don't revise what is written. Prices no open alert can need are dropped from the state.
    """
    alerts, prices, clock = {}, [], 0
    if state.exists:
        a, p, clock = state.get
        alerts, prices = json.loads(a), json.loads(p)
    for b in batches:
        for alert, close, us in zip(b["alert_id"], b["close"], b["us"]):
            clock = max(clock, int(us))
            if alert is not None and alert == alert:
                alerts.setdefault(alert, [int(us), list(monitoring.HORIZONS), float(close) if close is not None and close == close else None])
            elif close is not None and close == close:
                prices.append([int(us), float(close)])
    prices.sort()
    out = []
    for alert, (start, waiting, reference) in list(alerts.items()):
        due = [h for h in waiting if start + h * monitoring.MINUTE_US <= clock]
        for h in due:
            inside = [c for t, c in prices if start < t <= start + h * monitoring.MINUTE_US]
            found = (inside[-1], max(inside), min(inside)) if inside else (None,) * 3
            complete = bool(inside and reference)
            out.append((alert, h, len(inside), *found, complete, *[(x / reference - 1) * 100 if complete else None for x in found]))
        alerts[alert] = [start, [h for h in waiting if h not in due], reference]
        if not alerts[alert][1]:
            del alerts[alert]
    since = min([s for s, *_ in alerts.values()], default=clock - max(monitoring.HORIZONS) * monitoring.MINUTE_US)
    prices = [p for p in prices if p[0] > since]
    state.update((json.dumps(alerts), json.dumps(prices), clock))
    if out:
        numbers = ["last", "highest", "lowest", "return_pct", "mfe_pct", "mae_pct"]
        names = ["alert_id", "horizon", "observations", "last", "highest", "lowest", "complete", "return_pct", "mfe_pct", "mae_pct"]
        yield pd.DataFrame(out, columns=names).astype(dict.fromkeys(numbers, float))


def streaming_outcomes(events: DataFrame) -> DataFrame:
    """events: ticker, alert_id, close, us."""
    return events.groupBy("ticker").applyInPandasWithState(frozen_outcomes, OUTCOME_OUT, OUTCOME_STATE, "append", GroupStateTimeout.NoTimeout)


def late_aware_counts(events: DataFrame, at: str, keys: list[str], width: str = "15 minutes", lateness: str = "48 hours") -> DataFrame:
    """Counts per event-time window with a watermark: the streaming form for short windows (update mode)."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


class Monitor:
    """Runs cycles: raw capture once per content, normalised records once per id, and a heartbeat per cycle.

    write(batch, number) is a foreachBatch function; stores replace what a repeated batch wrote, so a restart is safe.
    A heartbeat says how many records and families a cycle had, and its status: ``degraded`` with the families that are
    stale, whose latest record (us in the record) is more than stale_us older than the clock; else ``running``.
    """

    def __init__(self, spark: SparkSession, root: str, enrich: Callable[[DataFrame], DataFrame] | None = None, stale_us: int | None = None, clock_us: Callable[[], int] = lambda: time.time_ns() // 1000):
        self.raw, self.normalised, self.beats = (RecordStore(spark, f"{root}/{n}") for n in ("raw", "normalised", "heartbeats"))
        self.spark, self.enrich, self.stale_us, self.clock_us = spark, enrich, stale_us, clock_us

    def beat(self, key: str, number: int, **body) -> None:
        """Writes a heartbeat; one of a batch written again replaces its own."""
        text = json.dumps(body, sort_keys=True)
        self.beats.append(self.spark.createDataFrame([(key, text)], "key string, body string"), number)

    def write(self, batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            self.raw.append(held.select(F.concat_ws("|", "family", F.sha2("record", 256)).alias("key"), F.col("record").alias("body")), number)
            rows = self.enrich(held) if self.enrich else held
            ident = F.coalesce(F.get_json_object("record", "$.id"), F.sha2("record", 256))
            self.normalised.append(rows.select(F.concat_ws("|", "family", ident).alias("key"), F.col("record").alias("body")), number)
            # a row per family
            seen = held.groupBy("family").agg(F.count("*").alias("n"), F.max(F.get_json_object("record", "$.us").try_cast("long")).alias("us")).collect()
            now = self.clock_us()
            stale = sorted(r["family"] for r in seen if self.stale_us is not None and r["us"] is not None and now - r["us"] > self.stale_us)
            self.beat(f"cycle-{number}", number, n=sum(r["n"] for r in seen), f=len(seen), status="degraded" if stale else "running", stale=stale)
        finally:
            held.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = None):
        w = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


#: Numbers of heartbeats that belong to no batch: they count down from here.
SUPERVISOR = -1


def supervise(monitor: Monitor, start: Callable[[], object], cycles: int | None = None, first: float = 1.0, most: float = 60.0, failures: int = 10, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs start() (which gives a started query) again and again, and gives the number of cycles that ended well.

    A query that ends is a cycle (an availableNow query has read what there was); after so many it stops, without a number it
    goes on for ever. A query that fails leaves a heartbeat ``reconnecting`` and is started again after restart_delay;
    that many failures in a row are raised. An interrupt stops the query. The last heartbeat is always ``stopped``.
    """
    done = lost = beats = 0
    query = None
    try:
        while cycles is None or done < cycles:
            try:
                query = start()
                query.awaitTermination()
                done, lost = done + 1, 0
            except StreamingQueryException as e:
                lost += 1
                if lost >= failures:
                    raise
                wait = restart_delay(lost, first, most)
                monitor.beat(f"reconnecting-{uuid.uuid4().hex}", SUPERVISOR - beats, status="reconnecting", attempt=lost, wait=wait, reason=str(e).splitlines()[0][:200])
                beats += 1
                sleep(wait)
    except KeyboardInterrupt:
        if query is not None:
            query.stop()
    finally:
        monitor.beat(f"stopped-{uuid.uuid4().hex}", SUPERVISOR - beats, status="stopped", cycles=done)
    return done


def restart_delay(failures: int, first: float, most: float) -> float:
    """Seconds before the restart after so many failures in a row: doubling, up to most."""
    return min(most, first * 2.0 ** (failures - 1))
