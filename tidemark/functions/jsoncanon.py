"""Canonical form of JSON texts: equal values give equal digests, however they are spelt."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = "\ue000"


def canonical_number(text: str) -> str:
    """One spelling per number: significant digits and a power of ten (``1.50`` and ``15e-1`` agree)."""
    sign, body = ("-", text[1:]) if text[0] == "-" else ("", text)
    mantissa, _, power = body.replace("E", "e").partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    kept = digits.rstrip("0")
    if not kept:
        return "0"
    return f"{sign}{kept}e{int(power or 0) - len(fraction) + len(digits) - len(kept)}"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _parse(text: str, prefix: str):
    mark = lambda s: prefix + canonical_number(s)
    return json.loads(text, parse_float=mark, parse_int=mark, parse_constant=_no_constant)


def _tag_strings(v):
    """Marks every string so that none can equal a number's spelling."""
    if isinstance(v, dict):
        return {k: _tag_strings(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_tag_strings(x) for x in v]
    if isinstance(v, str) and not v.startswith("\0n"):
        return "s" + v
    return v


def canonical_json(text: str) -> str:
    """Canonical text of a JSON value; a text that is no JSON stands for itself.

    Member order, blanks, escapes and the spelling of numbers don't matter; array order, types and absent versus
    null members do. Of repeated members the last holds. Nesting beyond the parser's depth counts as no JSON.
    """
    try:
        if _MARK in text or "\\ue000" in text.lower():
            # strings with the mark itself: numbers get a prefix no JSON string of such a text can carry after tagging
            body = "2" + json.dumps(_tag_strings(_parse(text, "\0n")), sort_keys=True, separators=(",", ":"))
        else:
            body = "1" + json.dumps(_parse(text, _MARK), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return "0" + text
    return body


def digest(text: str | None) -> bytes | None:
    if text is None:
        return None
    return hashlib.blake2b(canonical_json(text).encode("utf-8", "surrogatepass"), digest_size=16).digest()


@F.pandas_udf(T.BinaryType())
def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(digest, na_action="ignore")


def json_digest(text: Column | str) -> Column:
    """16-byte digest of the canonical JSON value; null for null."""
    return _digests(F.col(text) if isinstance(text, str) else text)
