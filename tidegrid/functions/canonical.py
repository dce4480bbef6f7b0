"""Canonical forms of identifiers and times, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earliest epoch millisecond that counts as a time.
FIRST_USABLE_MS = 1577836800000


def canonical_oid(oid: Column) -> Column:
    """Double quotes removed, outer blanks trimmed, lower-cased; null where nothing is left."""
    c = F.lower(F.trim(F.replace(oid, F.lit('"'), F.lit(""))))
    return F.when(c != "", c)


def canonical_grid_id(grid_id: Column) -> Column:
    """Trimmed and left-padded with zeros to ten characters (longer ids stay whole); null where nothing is left."""
    c = F.trim(grid_id)
    return F.when(c != "", F.when(F.length(c) >= 10, c).otherwise(F.lpad(c, 10, "0")))


def usable_ms(ts_ms: Column) -> Column:
    """``ts_ms`` where it is a time, else null."""
    return F.when(ts_ms >= FIRST_USABLE_MS, ts_ms)


def is_usable(ts_ms: Column) -> Column:
    """Whether ``ts_ms`` is a time, as a filter that scans can take."""
    return ts_ms >= FIRST_USABLE_MS


def finite(x: Column) -> Column:
    """False for null, NaN (which counts as larger than any number) and infinities."""
    return x.isNotNull() & (F.abs(x) < float("inf"))
