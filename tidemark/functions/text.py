"""Text scalars: normalised text, token sets, similarity, numbers in text, dates, links and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that don't count as tokens
IGNORED_TOKENS = ("the", "and", "of", "to", "a", "in", "for", "company", "announces", "said")
# fixed values: number patterns and scales; (?U) as word edges and blanks are Unicode's
MONEY = r"(?iU)\$\s*([0-9]+(?:\.[0-9]+)?|[0-9][0-9,]*)\s*(billion|million|thousand|bn|mm|m|k)?\b"
PERCENT = r"(?U)\b([0-9]+(?:\.[0-9]+)?)\s*%"
SHARES = r"(?iU)\b([0-9]+(?:\.[0-9]+)?|[0-9][0-9,]*)\s*(billion|million|thousand|bn|mm|m|k)?\s+shares\b"
RATIO = r"(?iU)\b([0-9]+)\s*[- ]for[- ]\s*([0-9]+)\b"
EXPECTED_DATE = r"(?iU)\b(?:expected|scheduled|anticipated)\b.{0,40}?\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b"
SCALES = {"billion": 1e9, "bn": 1e9, "million": 1e6, "mm": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}


def normalised(*parts: Column) -> Column:
    """Parts joined by a blank, lower case, runs of white space (Unicode's too) as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"(?U)\s+", " "))


def token_set(text: Column) -> Column:
    """Distinct tokens of two characters and more that aren't ignored, sorted; empty for null."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(*IGNORED_TOKENS))))


def mention_tokens(text: Column, least: int = 4) -> Column:
    """Distinct tokens, none if there are fewer than least of them: too short to tell copies apart."""
    every = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))))
    return F.when(F.size(every) >= least, every).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def scaled(number: Column, suffix: Column) -> Column:
    value = F.regexp_replace(number, ",", "").cast("double")
    factor = F.lit(1.0)
    for name, by in SCALES.items():
        factor = F.when(F.lower(suffix) == name, by).otherwise(factor)
    return value * factor


def numbers(text: Column, pattern: str) -> Column:
    """Scaled values of all matches of MONEY or SHARES."""
    raw, suffix = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(raw, suffix, scaled)


def numeric_details(text: Column) -> Column:
    """array<struct<kind, raw, value>> of money, percentages, share counts and ratios, first of equal ones only, in order."""
    text = F.coalesce(text, F.lit(""))
    pick = lambda kind, pattern, value: F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("raw"), value.alias("value")), lambda x: F.struct(F.lit(kind).alias("kind"), x["raw"].alias("raw"), x["value"].alias("value")))
    single = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: v.cast("double"))
    of, per = F.regexp_extract_all(text, F.lit(RATIO), F.lit(1)), F.regexp_extract_all(text, F.lit(RATIO), F.lit(2))
    ratio = F.zip_with(of, per, lambda a, b: F.coalesce(F.try_divide(b.cast("double"), a.cast("double")), F.lit(0.0)))
    every = F.concat(pick("money", MONEY, numbers(text, MONEY)), pick("percentage", PERCENT, single(PERCENT)), pick("shares", SHARES, numbers(text, SHARES)), pick("ratio", RATIO, ratio))
    seen = F.transform(every, lambda x: F.struct(x["kind"], x["value"]))
    return F.filter(every, lambda x, i: F.array_position(seen, F.struct(x["kind"], x["value"])) == i + 1)


def expected_date(text: Column) -> Column:
    """First date behind expected, scheduled or anticipated; null for none and for impossible dates."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, EXPECTED_DATE, 1), F.lit("")), "yyyy-MM-dd")


def valid_link(url: Column, extra_schemes: tuple[str, ...] = ()) -> Column:
    """http and https with a host, or one of the extra schemes; false for null and malformed links."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    ok = scheme.isin("http", "https") & (host != "")
    return F.coalesce(ok | scheme.isin(*extra_schemes) if extra_schemes else ok, F.lit(False))


def host_within(url: Column, domain: str) -> Column:
    """Whether a link's host is the domain or one below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce((host == domain) | F.endswith(host, F.lit("." + domain)), F.lit(False))


def stale(first_seen: Column, first_public: Column, hours: int = 24) -> Column:
    """Whether a document was found more than so many hours after it had become public."""
    return F.unix_micros(first_seen) - F.unix_micros(first_public) > hours * 3_600_000_000


def verification(kind: Column, primary: tuple[str, ...], corroborated: Column) -> Column:
    """verified for primary kinds and corroborated secondary ones; social posts never are."""
    return F.when(kind == "social_unverified", "unverified").when(kind.isin(*primary) | F.coalesce(corroborated, F.lit(False)), "verified").otherwise("unverified")


def padded_issuer(number: Column) -> Column:
    """An issuer's number with ten digits, leading zeros; null where it isn't one."""
    return F.when(number.rlike("^[0-9]{1,10}$"), F.lpad(number, 10, "0"))


def filing_index(issuer: Column, accession: Column, root: str = "https://www.sec.gov/Archives/edgar/data") -> Column:
    """Address of a filing's index: the issuer's number without leading zeros, the accession number without dashes and
    with them."""
    return F.concat_ws("/", F.lit(root), issuer.try_cast("bigint").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), F.concat(accession, F.lit("-index.html")))


def packed_instant(text: Column) -> Column:
    """UTC instant of 14 digits yyyyMMddHHmmss; null for anything else."""
    return F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def short_id(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def lexicon_score(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """(positive - negative) / (positive + negative) over all tokens, repeated ones too; 0 where there are none."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    count = lambda words: F.size(F.filter(tokens, lambda t: t.isin(*words)))
    p, n = count(positive), count(negative)
    return F.when(p + n > 0, (p - n) / F.when(p + n > 0, p + n)).otherwise(0.0)
