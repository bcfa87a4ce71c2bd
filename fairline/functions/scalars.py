"""Lenient parsing and canonical text of prices, flags and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairline.functions.text import strip

PRICE = "decimal(18,8)"


def lenient_decimal(col: Column) -> Column:
    """Prices and lines arrive as text; junk becomes null and no binary float is involved."""
    return col.try_cast(PRICE)


def lenient_boolean(col: Column, default: bool) -> Column:
    text = F.lower(strip(col))
    return F.when(text == "true", True).when(text == "false", False).otherwise(F.lit(default))


def lenient_integer(col: Column) -> Column:
    return F.when(col.rlike(r"\A\s*[+-]?[0-9]+\s*\z"), col.try_cast("bigint"))


def aware_timestamp(col: Column) -> Column:
    """ISO text with an offset; text without one is rejected, never read as local time."""
    text = F.regexp_replace(col, r"([+-]\d{2})(\d{2})\z", "$1:$2")
    return F.when(text.rlike(r"\A\d{4}-.*(Z|[+-]\d{2}:\d{2})\z"), text.try_cast("timestamp"))


# The representable range, years 1 to 9999.
_MIN_SECONDS = -62135596800
_MAX_SECONDS = 253402300799


def epoch_seconds(col: Column) -> Column:
    value = col.cast("bigint")
    return F.when(value.between(_MIN_SECONDS, _MAX_SECONDS), F.timestamp_seconds(value))


def epoch_millis(col: Column) -> Column:
    value = col.cast("bigint")
    in_range = value.between(_MIN_SECONDS * 1000, _MAX_SECONDS * 1000)
    return F.when(in_range, F.timestamp_millis(value))


def decimal_text(col: Column) -> Column:
    """Plain notation without trailing zeros: 2.10 and 2.100 give the same text."""
    return F.regexp_replace(col.cast(PRICE).cast("string"), r"\.?0+$", "")


def utc_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def quantized_line(col: Column) -> Column:
    """Eight fractional digits, half-even; null and zero stay distinct."""
    return F.bround(col.cast("decimal(38,18)"), 8).cast(PRICE)


def seconds_apart(left: Column, right: Column) -> Column:
    return F.abs(F.unix_micros(left) - F.unix_micros(right)) / 1000000


def sport_code(code: Column, name: Column, source_id: Column) -> Column:
    """A readable code from the provider's code or name, else one derived from the id."""
    raw = F.lower(F.coalesce(F.nullif(code, F.lit("")), name))
    joined = F.regexp_replace(strip(raw), r"(?U)\s+", "-")
    fallback = F.concat(F.lit("source-"), F.substring(F.sha2(source_id, 256), 1, 12))
    return F.when(joined != "", F.substring(joined, 1, 64)).otherwise(fallback)
