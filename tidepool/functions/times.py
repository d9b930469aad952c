"""Times written as text: column expressions that give an instant, or null for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset of times that are written without one.
DEFAULT_OFFSET = "+08:00"
_SHAPE = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?\d*)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"


def instant(text: Column, default_offset: str = DEFAULT_OFFSET) -> Column:
    """A timestamp from ISO notation with or without offset, slashes for dashes, a date alone (its first instant) or
    epoch seconds. Blank, placeholder and impossible values give null."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, _SHAPE, i)
    time = [F.when(part(i) == "", F.lit("00")).otherwise(F.lpad(part(i), 2, "0")) for i in (4, 5, 6)]
    offset = F.when(part(8) == "", F.lit(default_offset)).when(F.upper(part(8)) == "Z", F.lit("+00:00")).otherwise(F.regexp_replace(part(8), r"^(...):?(..)$", "$1:$2"))
    iso = F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"), F.lit("T"), time[0], F.lit(":"), time[1], F.lit(":"), time[2], part(7), offset)
    return F.when(t.rlike(_SHAPE), iso.try_cast("timestamp")).when(t.rlike(r"^\d{9,11}$"), F.timestamp_seconds(t.try_cast("bigint")))
