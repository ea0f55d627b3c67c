"""Validators of well-known text shapes: each gives the condition under which a value is bad."""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
ISO_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})|T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?| [0-9]{2}:[0-9]{2}:[0-9]{2})\z"
#: Scheme, perhaps a user, a host (a name, or an address in brackets) and perhaps a port.
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#\s@]*@)?(?:\[[0-9A-Fa-f:.]+\]|(?:[^\x00-\x20/?#@:\[\]<>^|%\\]|%[0-9A-Fa-f]{2})+)(?::[0-9]*)?(?:[/?#]|\z)"
URL_PORT = r"^[^/?#]*//[^/?#]*:([0-9]+)(?:[/?#]|\z)"
MOST_PORT = 65535


@functools.lru_cache(maxsize=1)
def countries() -> tuple[str, ...]:
    """Upper-case ISO 3166-1 codes of two letters, as the JVM's locale data has them."""
    spark = SparkSession.getActiveSession()
    return tuple(sorted(spark._jvm.java.util.Locale.getISOCountries()))


def bad_format(c: Column, name: str) -> Column:
    """True where a text value is not of the named format."""
    if name == "email":
        return ~c.rlike(EMAIL)
    if name == "uuid":
        return ~c.rlike(UUID)
    if name == "iso_date":
        return ~(c.rlike(ISO_DATE) & c.try_cast("date").isNotNull())
    if name == "iso_datetime":
        return ~(c.rlike(ISO_DATETIME) & F.upper(c).try_cast("timestamp").isNotNull())
    if name == "url":
        port = F.nullif(F.regexp_extract(c, URL_PORT, 1), F.lit("")).try_cast("decimal(38,0)")
        return ~(c.rlike(URL) & F.coalesce(port <= MOST_PORT, F.regexp_extract(c, URL_PORT, 1) == ""))
    return ~c.isin(*countries())
