"""Keyed hashes in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column as hex digits: two nested hashes over the padded key, no Python per row. Null for null."""
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pseudonym(key: bytes, platform: Column, handle: Column, size: int = 16) -> Column:
    """A person's pseudonym on a platform: equal handles of different platforms have different ones."""
    return F.concat(F.lit("author:"), F.substring(hmac_sha256(key, F.concat_ws("\0", F.lit("author-key"), platform, handle)), 1, size))
