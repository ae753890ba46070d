"""The queries of problems 1 to 4, 6 and 7 against brute force in plain Python on whole small tables."""

import json
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq
import pytest

from tidemark.plans.preparation import QUERIES


def rows(data, name):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def us(t):
    return None if t is None else (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def found(spark, data, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, data).collect())


def frozen(v):
    if isinstance(v, dict):
        return ("object", frozenset((k, frozen(x)) for k, x in v.items()))
    if isinstance(v, list):
        return ("array", tuple(map(frozen, v)))
    return (type(v).__name__, v)


def test_p1(spark, data):
    groups = defaultdict(list)
    for r in rows(data, "raw_source_items"):
        if r["source_id"] is not None:
            value = frozen(json.loads(r["payload"], parse_int=Decimal, parse_float=Decimal))
            first = us(r["first_seen_at"])
            groups[r["source_family"], r["source_id"], value].append((first is None, first or 0, r["delivery_id"]))
    want = sorted((x[2],) for g in groups.values() for x in sorted(g)[1:])
    assert want and found(spark, data, "p1_found") == want


OFFSETS = {"EST": -5, "EDT": -4, "CET": 1, "CEST": 2, "BST": 1, "IST": 5.5, "JST": 9, "AEST": 10, "AEDT": 11, "UTC": 0, "GMT": 0, "Z": 0, "z": 0}


def local(t, zone, seen):
    """By round trips over both folds, another way than the operator's."""
    z = ZoneInfo(zone)
    got = set()
    for fold in (0, 1):
        u = t.replace(tzinfo=z, fold=fold).astimezone(timezone.utc)
        if u.astimezone(z).replace(tzinfo=None) == t:
            got.add(u)
    if len(got) == 2 and seen is not None and max(got) <= seen:
        return max(got)
    return min(got) if got else None


def read(text, zone, seen):
    """Each format by strptime, one after another."""
    import re

    s = text.strip().replace("−", "-")
    if s.isdigit():
        if len(s) == 14:
            try:
                return datetime.strptime(s, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
            except ValueError:
                return None
        scale = {10: 10**6, 13: 10**3, 16: 1}.get(len(s))
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=int(s) * scale) if scale else None
    suffix = None
    if m := re.search(r"(?<=[0-9MZz\s:])\s*(\[[^]]+\]|[A-Z][a-z]+/[A-Za-z_]+| [A-Z]{3,4}|Z|z)$", s):
        suffix, s = m[1].strip(" []"), s[: m.start()]
    elif m := re.search(r"(?<=:[0-9]{2})(\.[0-9]+)?\s*([+-][0-9]{2}(:?[0-9]{2})?)$", s):
        suffix, s = m[2], s[: m.start(2)].strip()
    s = re.sub(r"(\.[0-9]{6})[0-9]+$", r"\1", s)
    for f in ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%d.%m.%Y %H:%M:%S", "%d-%b-%Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S"):
        try:
            t = datetime.strptime(s, f)
            break
        except ValueError:
            continue
    else:
        return None
    if suffix is None:
        return local(t, zone, seen) if zone else None
    if suffix[0] in "+-":
        d = suffix[1:].replace(":", "")
        off = timedelta(hours=int(d[:2]), minutes=int(d[2:] or 0)) * (1 if suffix[0] == "+" else -1)
    elif suffix in OFFSETS:
        off = timedelta(hours=OFFSETS[suffix])
    else:
        return local(t, suffix, seen)
    return (t - off).replace(tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def zones(data):
    return {r["feed"]: r["zone"] for r in rows(data, "feed_zones")}


def test_p3(spark, data, zones):
    import re

    want = set()
    for name, key, feed, text in (("raw_source_items", "delivery_id", "provider", "source_timestamp"), ("market_observations", "observation_id", "feed", "source_timestamp"), ("source_documents", "document_id", "provider", "accepted_at")):
        for r in rows(data, name):
            if r[text] is None or re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z", r[text]):
                continue
            at = read(r[text], zones.get(r[feed]), r["first_seen_at"])
            if at is not None:
                want.add((name, str(r[key]), us(at)))
    assert found(spark, data, "p3_found") == sorted(want)


def test_p7(spark, data, zones):
    versions, halts = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for v in rows(data, "instruments"):
        versions[v["security_id"]].append(v)
    for h in rows(data, "halt_observations"):
        halts[h["security_id"]][h["halt_id"]].append(h)
    want = set()
    for o in rows(data, "market_observations"):
        t = None if o["source_timestamp"] is None else read(o["source_timestamp"], zones.get(o["feed"]), o["first_seen_at"])
        if t is None:
            continue
        ok = [v for v in versions[o["security_id"]] if v["effective_from"] <= t and (v["effective_to"] is None or t < v["effective_to"]) and v["free_float_available_at"] is not None and v["free_float_available_at"] <= t]
        if not ok:
            continue
        v = max(ok, key=lambda v: (v["effective_from"], v["free_float_available_at"], v["version_id"]))
        halted = False
        for obs in halts[o["security_id"]].values():
            known = [h for h in obs if h["first_seen_at"] <= t]
            if known:
                h = max(known, key=lambda h: h["first_seen_at"])
                halted |= h["halt_at"] <= t and (h["resumption_trade_at"] is None or h["resumption_trade_at"] > t)
        status = "halted" if halted else "not_halted"
        if o["free_float"] != v["free_float"] or o["halt_status"] != status:
            want.add((o["observation_id"], v["version_id"], status))
    assert want and found(spark, data, "p7_found") == sorted(want)


def test_p2_p4_p6_equal_sql(spark, data):
    import duckdb

    from tidemark.plans.preparation import SQL

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("halt_observations", "bars", "source_documents"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for q in ("p2_found", "p4_found", "p6_found"):
        assert found(spark, data, q) == sorted(con.execute(SQL[q]).fetchall()), q
