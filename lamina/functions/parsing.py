"""Tolerant typing: what cannot be read becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Layouts tried after the ISO forms, in this order.
TIMESTAMP_LAYOUTS = [
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd HHmmss",
    "yyyyMMddHHmmss",
    "yyyyMMdd",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm",
    "d MMM yyyy",
]


def tolerant_int(text: Column, low: int = 0, high: int = 65535) -> Column:
    """Integer written with digits alone and inside [low, high], else NULL."""
    shape = r"^-?[0-9]+$" if low < 0 else r"^[0-9]+$"
    number = F.when(text.rlike(shape), text.try_cast("bigint"))
    return F.when(number.between(low, high), number).cast("int")


def tolerant_decimal(text: Column, precision: int, scale: int) -> Column:
    return text.try_cast(f"decimal({precision},{scale})")


def tolerant_timestamp(text: Column, layouts: list[str] | None = None) -> Column:
    """Timestamp in ISO form, as seconds since 1970 or in one of the layouts, else NULL.

    A time with an offset or `Z` is given in UTC, the session's time zone.
    """
    dated = text.rlike(r"^\s*[0-9]{4}-")
    shifted = text.rlike(r"[0-9]{2}:[0-9]{2}\S*\s*(Z|[+-][0-9]{2}(:?[0-9]{2})?)\s*$")
    iso = F.coalesce(
        F.when(dated & shifted, text.try_cast("timestamp").cast("timestamp_ntz")),
        F.when(dated & ~shifted, text.try_cast("timestamp_ntz")),
        F.when(text.rlike(r"^\s*[0-9]{9,10}\s*$"), F.timestamp_seconds(F.trim(text).try_cast("bigint")).cast("timestamp_ntz")),
    )
    others = [
        F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")
        for layout in (TIMESTAMP_LAYOUTS if layouts is None else layouts)
    ]
    return F.coalesce(iso, *others)


def is_blank(text: Column) -> Column:
    """Absent or empty: CSV readers give NULL where the file has nothing."""
    return F.coalesce(text, F.lit("")) == ""


def illegible(text: Column, parsed: Column) -> Column:
    """1 when something was written and could not be read: not the same as absent."""
    return (~is_blank(text) & parsed.isNull()).cast("int")
