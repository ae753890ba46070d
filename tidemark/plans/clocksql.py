"""DuckDB SQL that reads clock texts on its own, from the statement of the readings: the check of problems 3 and 7."""

from __future__ import annotations

# fixed values: abbreviations of the zones that feeds use, with their offsets in seconds
_ABBREVIATIONS = """('America/New_York', 'EST', -18000), ('America/New_York', 'EDT', -14400), ('Europe/London', 'BST', 3600), ('Europe/Berlin', 'CET', 3600), ('Europe/Berlin', 'CEST', 7200),
('Asia/Tokyo', 'JST', 32400), ('Asia/Kolkata', 'IST', 19800), ('Australia/Sydney', 'AEST', 36000), ('Australia/Sydney', 'AEDT', 39600)"""
_MONTHS = "'jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'"
_SEP = "(?:[Tt]|,?[ ]+)(.*)$"
_DATES = {
    "iso": (rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_SEP}", (1, 2, 3)),
    "us": (rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}){_SEP}", (3, 1, 2)),
    "dot": (rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}){_SEP}", (3, 2, 1)),
    "word": (rf"^(?:[A-Za-z]{{3}},? +)?([0-9]{{1,2}})[- ]([A-Za-z]{{3}})[- ]([0-9]{{4}}){_SEP}", (3, 2, 1)),
    "packed": (r"^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{6}.*)$", (1, 2, 3)),
}


def _date() -> str:
    """CASE that gives [y, m, d, rest] of a text, or null."""
    parts = []
    for p, (y, m, d) in _DATES.values():
        parts.append(f"WHEN regexp_matches(t, '{p}') THEN [{', '.join(f"regexp_extract(t, '{p}', {g})" for g in (y, m, d, 4))}]")
    return "CASE " + " ".join(parts) + " END"


def clock_ctes(source: str) -> str:
    """CTEs that end in ``clocks(k, seen, utc_us)``: the instant of every row of source(k, text, zone, seen), null where
    it denotes none. seen: first_seen_at in microseconds."""
    time = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?: *([AaPp])[Mm]\b)? *(.*)$"
    return f"""c0 AS (SELECT k, zone, seen, trim(text, ' ') t FROM ({source})),
c1 AS (SELECT *, {_date()} p FROM c0),
c2 AS (SELECT * EXCLUDE (p), CASE WHEN p IS NOT NULL THEN lpad(p[1], 4, '0') || '-' || lpad(CASE WHEN regexp_matches(p[2], '^[A-Za-z]') THEN CAST(list_position([{_MONTHS}], lower(p[2])) AS VARCHAR) ELSE p[2] END, 2, '0') || '-' || lpad(p[3], 2, '0') END dt,
  CASE WHEN regexp_matches(t, '{_DATES["packed"][0]}') THEN substr(p[4], 1, 2) || ':' || substr(p[4], 3, 2) || ':' || substr(p[4], 5) ELSE p[4] END r FROM c1),
c3 AS (SELECT *, TRY_CAST(dt AS DATE) d, CAST(nullif(regexp_extract(r, '{time}', 1), '') AS INTEGER) h0, CAST(nullif(regexp_extract(r, '{time}', 2), '') AS INTEGER) mi, CAST(coalesce(nullif(regexp_extract(r, '{time}', 3), ''), '0') AS INTEGER) s,
  CAST(substr(regexp_extract(r, '{time}', 4) || '000000', 1, 6) AS BIGINT) f, lower(regexp_extract(r, '{time}', 5)) half, regexp_extract(r, '{time}', 6) z FROM c2),
c4 AS (SELECT *, CASE WHEN half = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END h FROM c3),
c5 AS (SELECT *, CASE WHEN d IS NOT NULL AND h <= 23 AND mi <= 59 AND s <= 59 THEN CAST(datediff('day', DATE '1970-01-01', d) AS BIGINT) * 86400 + h * 3600 + mi * 60 + s END loc FROM c4),
ab(zone, a, off) AS (VALUES {_ABBREVIATIONS}),
c6 AS (SELECT c5.*, CASE WHEN upper(z) IN ('Z', 'UTC', 'GMT', 'UT', '[UTC]') THEN 0
  WHEN regexp_matches(z, '^[+−-][0-9]{{2}}:?([0-9]{{2}})?$') THEN (CASE WHEN z[1] = '+' THEN 1 ELSE -1 END) * (CAST(regexp_extract(z, '^.([0-9]{{2}})', 1) AS INTEGER) * 3600 + CAST(coalesce(nullif(regexp_extract(z, '^.[0-9]{{2}}:?([0-9]{{2}})$', 1), ''), '0') AS INTEGER) * 60)
  ELSE ab.off END off, CASE WHEN z = '' THEN c5.zone ELSE nullif(regexp_extract(z, '^\\[?([A-Za-z]+/[A-Za-z_]+)\\]?$', 1), '') END zn FROM c5 LEFT JOIN ab ON ab.zone = c5.zone AND ab.a = upper(z)),
c7 AS (SELECT *, CASE WHEN off IS NULL AND zn IS NOT NULL AND loc IS NOT NULL THEN epoch_us(timezone(zn, make_timestamp(loc * 1000000))) END u FROM c6),
c8 AS (SELECT *, list_filter([u - 3600000000, u, u + 3600000000], lambda x: epoch_us(timezone(zn, make_timestamptz(x))) = loc * 1000000) us FROM c7),
clocks AS (SELECT k, seen, CASE WHEN regexp_full_match(t, '[0-9]{{10}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{{13}}') THEN CAST(t AS BIGINT) * 1000 WHEN regexp_full_match(t, '[0-9]{{16}}') THEN CAST(t AS BIGINT)
  WHEN regexp_full_match(t, '[0-9]{{14}}') THEN epoch_us(try_strptime(t, '%Y%m%d%H%M%S')) WHEN off IS NOT NULL THEN (loc - off) * 1000000 + f
  WHEN u IS NOT NULL AND len(us) > 0 THEN (CASE WHEN list_max(us) + f <= seen THEN list_max(us) ELSE list_min(us) END) + f END utc_us FROM c8)"""


#: Zone of each feed.
ZONES = "zz AS (SELECT feed, max(zone) zone FROM feed_zones GROUP BY 1)"
#: observations with their instant, once each: ob(observation_id, ..., us)
OBSERVATIONS = f"""{ZONES},
os AS (SELECT DISTINCT observation_id, security_id, ticker, source_timestamp, epoch_us(first_seen_at) seen, o.feed, close, volume, bid, ask, free_float, halt_status, missing_flags, zone FROM market_observations o LEFT JOIN zz ON zz.feed = o.feed),
{clock_ctes("SELECT observation_id k, source_timestamp AS text, zone, seen FROM os WHERE source_timestamp IS NOT NULL")},
ob AS (SELECT os.*, utc_us us FROM os LEFT JOIN (SELECT DISTINCT k, utc_us FROM clocks) ck ON ck.k = os.observation_id)"""
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"

P3 = f"""WITH {ZONES}, src AS (SELECT 'raw_source_items' AS record_table, CAST(delivery_id AS VARCHAR) AS record_key, provider AS feed, source_timestamp AS text, first_seen_at FROM raw_source_items
UNION ALL SELECT 'market_observations', observation_id, feed, source_timestamp, first_seen_at FROM market_observations UNION ALL SELECT 'source_documents', document_id, provider, accepted_at, first_seen_at FROM source_documents),
{clock_ctes(f"SELECT record_table || '|' || record_key AS k, text, zone, epoch_us(first_seen_at) seen FROM src LEFT JOIN zz ON zz.feed = src.feed WHERE text IS NOT NULL AND NOT regexp_matches(text, '{CANONICAL}')")}
SELECT split_part(k, '|', 1) AS record_table, split_part(k, '|', 2) AS record_key, min(utc_us) AS utc_us FROM clocks WHERE utc_us IS NOT NULL GROUP BY 1, 2"""

P7 = f"""WITH {OBSERVATIONS}, v AS (SELECT security_id, version_id, free_float, epoch_us(effective_from) a, epoch_us(effective_to) z, epoch_us(free_float_available_at) kn FROM instruments),
b AS (SELECT ob.observation_id, arg_max(v.version_id, (a, kn, version_id)) version_id FROM ob JOIN v ON v.security_id = ob.security_id AND a <= us AND (z IS NULL OR us < z) AND kn <= us GROUP BY 1),
vf AS (SELECT b.observation_id, b.version_id, v.free_float FROM b JOIN v ON v.version_id = b.version_id),
hs AS (SELECT ob.observation_id, ob.us, h.halt_id, arg_max(epoch_us(halt_at), (epoch_us(h.first_seen_at), epoch_us(halt_at))) ha, max((epoch_us(h.first_seen_at), epoch_us(halt_at), coalesce(epoch_us(resumption_trade_at), -1))) lst FROM ob JOIN halt_observations h ON h.security_id = ob.security_id AND epoch_us(h.first_seen_at) <= us WHERE h.halt_id IS NOT NULL GROUP BY 1, 2, 3),
hh AS (SELECT observation_id, bool_or(ha <= us AND (lst[3] = -1 OR lst[3] > us)) halted FROM hs GROUP BY 1)
SELECT ob.observation_id, vf.version_id, CASE WHEN coalesce(halted, false) THEN 'halted' ELSE 'not_halted' END AS halt_status FROM ob JOIN vf USING (observation_id) LEFT JOIN hh USING (observation_id)
WHERE us IS NOT NULL AND (ob.free_float IS DISTINCT FROM vf.free_float OR ob.halt_status IS DISTINCT FROM CASE WHEN coalesce(halted, false) THEN 'halted' ELSE 'not_halted' END)"""

P1 = """WITH d AS (SELECT DISTINCT delivery_id, source_family, source_id, first_seen_at, payload FROM raw_source_items WHERE source_id IS NOT NULL),
v AS (SELECT delivery_id, list_sort(list(x.fullkey || chr(1) || CASE WHEN x.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'n' || CAST(CAST(json_extract_string(x.atom, '$') AS DOUBLE) AS VARCHAR) ELSE x.type || chr(1) || coalesce(json_extract_string(x.atom, '$'), '') END)) val FROM d, json_tree(d.payload) x GROUP BY 1),
r AS (SELECT d.delivery_id, row_number() OVER (PARTITION BY source_family, source_id, val ORDER BY first_seen_at ASC NULLS LAST, d.delivery_id) rn FROM d LEFT JOIN v USING (delivery_id))
SELECT delivery_id FROM r WHERE rn > 1"""
