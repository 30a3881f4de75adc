"""Identifiers: fixed-width text that orders like the bytes, and times inside version-7 UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_of(n: Column) -> Column:
    """A 32-character identifier that orders like the number."""
    return F.lpad(n.cast("string"), 32, "0")


def from_bytes(b: Column) -> Column:
    return F.lower(F.hex(b))


def to_bytes(u: Column) -> Column:
    return F.unhex(F.regexp_replace(u, "-", ""))


def uuid7_millis(u: Column) -> Column:
    """Unix milliseconds in the first 48 bits."""
    return F.conv(F.substring(F.regexp_replace(u, "-", ""), 1, 12), 16, 10).cast("bigint")


def query_multimap(url: Column) -> Column:
    """The query string of a url as map<string, array<string>>."""
    pairs = F.filter(F.split(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), "&"), lambda p: p != "")
    split = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))
    keys = F.array_distinct(F.transform(split, lambda s: s["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(split, lambda s: s["k"] == k), lambda s: s["v"])))
