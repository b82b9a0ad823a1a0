"""Columns that take personal data out of log lines."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters whose values are secret.
SECRET = [
    "email", "token", "password", "pwd", "authorization", "auth", "session", "sessionid", "phone", "address", "card", "secret",
    "apikey", "key", "ssn", "user", "username", "access_token", "refresh_token",
]


def redact_query(query: Column, more: list[str] | None = None) -> Column:
    """A query string (no question mark) with secret values masked.

    A repeated secret parameter stays once, at its first place; others are kept as they are.
    """
    secret = SECRET + [m.lower() for m in more or []]
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda kv: kv != "")
    named = F.transform(pairs, lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), kv.alias("kv")))
    masked = F.transform(named, lambda s: F.when(F.lower(s["k"]).isin(secret), F.concat(s["k"], F.lit("=%5BREDACTED%5D"))).otherwise(s["kv"]))
    kept = F.filter(masked, lambda kv, i: ~kv.endswith("=%5BREDACTED%5D") | (F.array_position(masked, kv) == i + 1))
    return F.array_join(kept, "&")


def hash_ip(ip: Column, salt: str) -> Column:
    """First 16 hex digits of the HMAC-SHA-256 of an address, as two nested digests; 0.0.0.0 for none."""
    key = salt.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(F.unhex(F.lit(inner)), ip.cast("binary")), 256)
    return F.when(F.coalesce(ip, F.lit("")) == "", "0.0.0.0").otherwise(F.substring(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(digest)), 256), 1, 16))


#: Characters of a sample that are kept.
SAMPLE = 300
# What a sample must not show: dotted quads, groups of hexadecimal digits between colons, values after a name that may be secret.
_QUAD = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
_COLONS = r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9a-f:])"
_NAMED = "(?i)([?&](?:" + "|".join(SECRET) + ")=)[^&#\\s\"]+"


def redact_line(line: Column) -> Column:
    """A sample of a line that failed to parse, cut to ``SAMPLE`` characters once addresses and the values of secret parameters are masked."""
    for pattern, mask in ((_NAMED, "$1[REDACTED]"), (_QUAD, "[ip]"), (_COLONS, "[ip]")):
        line = F.regexp_replace(line, pattern, mask)
    return F.left(line, F.lit(SAMPLE))
