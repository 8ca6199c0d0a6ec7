"""Small column expressions that recur across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def default_if_empty(c: Column, default: object) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def band(c: Column, at_least: float, high: str = "high", low: str = "low") -> Column:
    return F.when(c >= at_least, high).otherwise(low)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def run_stamp(c: Column) -> Column:
    """A timestamp as ``YYYYMMDD_HHMMSS``."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def to_utc(c: Column, zone: str) -> Column:
    """Local time of a zone as UTC, to be applied before an export drops zones."""
    return F.to_utc_timestamp(c, zone)


def coerce_flag(c: Column) -> Column:
    """``true``/``false`` in any case and padding as boolean, all else null."""
    low = F.lower(F.trim(c))
    return F.when(low == "true", True).when(low == "false", False)


def whole_number(c: Column) -> Column:
    """A whole number with an optional sign, all else null."""
    return F.when(F.trim(c).rlike("^-?[0-9]+$"), F.trim(c).try_cast("long"))


def object_path(bucket: Column, key: Column) -> Column:
    return F.format_string("s3://%s/%s", bucket, key)


def bucket_of(*cols: Column, n: int) -> Column:
    """A stable bucket 0..n-1 of some columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def variant_field(c: Column, path: str, kind: str) -> Column:
    """A field of a JSON text, null where the text or the type does not fit."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)
