"""Canonical JSON, keyed receipts and digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: object) -> str:
    """Sorted keys, no spaces, no ASCII escapes, whole floats as integers."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and v.is_integer():
            return int(v)
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of a JSON text; null where it isn't JSON."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def digest(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal from two built-in digests."""
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256)


def receipt(secret: bytes, task: Column, call: Column, text: Column) -> Column:
    """The receipt of one call: a keyed digest of task, call and exposed text."""
    message = F.concat_ws("|", task, call.cast("string"), F.sha2(text, 256))
    return F.concat(F.lit("r-"), F.left(hmac_sha256(secret, message), F.lit(32)))


def row_id(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(24))
