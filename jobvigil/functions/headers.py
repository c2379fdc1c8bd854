"""Record headers: an array of (key, binary value), where the last entry of a key counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobvigil.config import ERROR_HEADER, RETRY_HEADER


def last_header(headers: Column, key: str) -> Column:
    """Text of the last header with this key, null if there is none."""
    matching = F.filter(headers, lambda h: h["key"] == key)
    return F.try_element_at(matching, F.lit(-1))["value"].cast("string")


def retry_count(headers: Column) -> Column:
    """Attempt number of the record: 0 when the header is absent or not an int."""
    text = last_header(headers, RETRY_HEADER)
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(whole, F.lit(0))


def dead_letter_error(headers: Column) -> Column:
    """Why the record was rejected, ``unknown`` if nothing says so."""
    return F.coalesce(last_header(headers, ERROR_HEADER), F.lit("unknown"))


def set_header(headers: Column, key: str, value: Column) -> Column:
    """Headers with every entry of this key replaced by a single one at the end."""
    entry = F.struct(F.lit(key).alias("key"), value.cast("string").cast("binary").alias("value"))
    kept = F.filter(headers, lambda h: h["key"] != key)
    return F.concat(F.coalesce(kept, F.expr("cast(array() as array<struct<key:string,value:binary>>)")), F.array(entry))


def set_retry_count(headers: Column, count: Column | None = None) -> Column:
    """Stamp the attempt number; an unknown number is the first attempt."""
    attempt = F.lit(1) if count is None else F.coalesce(count, F.lit(1))
    return set_header(headers, RETRY_HEADER, attempt)
