"""Hashes of complete key tuples that are the same on every machine."""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: After each part of a key: a fixed value of the hash's format.
_END = "1f"


def key_hash_of(parts: list[str]) -> int:
    """The hash of one key, on the driver: the first 8 bytes, little-endian, of a SHA-256 over every part
    with its length (8 bytes, little-endian) before it and a separator after it."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode()
        h.update(struct.pack("<Q", len(raw)) + raw + bytes.fromhex(_END))
    return struct.unpack("<Q", h.digest()[:8])[0]


def _little_endian(n: Column) -> Column:
    return F.unhex(F.concat_ws("", F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 16, "0"), F.lit("(..)"), F.lit(1)))))


def key_hash(parts: list[Column]) -> Column:
    """The same hash as a decimal text column (it is unsigned); null if a part is null."""
    raw = [p.cast("binary") for p in parts]
    framed = F.concat(*(x for r in raw for x in (_little_endian(F.octet_length(r).cast("long")), r, F.unhex(F.lit(_END)))))
    head = F.substring(F.sha2(framed, 256), 1, 16)
    swapped = F.concat_ws("", F.reverse(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1))))
    complete = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(complete, F.conv(swapped, 16, 10))
