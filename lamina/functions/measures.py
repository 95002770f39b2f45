"""Durations, ages, calendar parts, ratios and alert flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lamina.contract import NO_DATE_SENTINEL, SEX_DOMAIN, UNKNOWN, AlertThresholds
from lamina.functions.parsing import is_blank

MINUTES_PER_DAY = 1440


def minute_number(moment: Column) -> Column:
    """Minutes since the epoch, rounded down."""
    return F.floor(F.unix_seconds(moment.cast("timestamp")) / 60)


def minutes_between(start: Column, end: Column) -> Column:
    """Number of minute borders crossed: 00:00:59 to 00:01:00 is one minute."""
    return minute_number(end) - minute_number(start)


def duration_days(start: Column, end: Column) -> Column:
    """Fractional days; NULL while the end is unknown."""
    return minutes_between(start, end) / F.lit(float(MINUTES_PER_DAY))


def age_at(moment: Column, birth_year: Column) -> Column:
    return F.year(moment) - birth_year


def decade_band(age: Column) -> Column:
    """'40-49'; the division truncates, as integer division does."""
    low = (age / 10).cast("int") * 10
    return F.coalesce(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")), F.lit(UNKNOWN))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def partition_month(day: Column) -> Column:
    """yyyyMM of a date; rows without a date share the sentinel month."""
    return F.date_format(F.coalesce(day, F.lit(NO_DATE_SENTINEL).cast("date")), "yyyyMM")


def ratio(numerator: Column, denominator: Column, digits: int = 2, scale: float = 1.0) -> Column:
    """Rounded quotient, 0 when the denominator is 0."""
    quotient = F.lit(scale) * numerator / F.nullif(denominator, F.lit(0))
    return F.coalesce(F.round(quotient, digits), F.lit(0.0))


def percentage(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator, 2, 100.0)


def normalise_sex(raw: Column) -> Column:
    code = F.upper(F.trim(raw))
    return F.when(code.isin(SEX_DOMAIN), code).otherwise(F.lit(UNKNOWN))


def default_label(text: Column, default: str = UNKNOWN) -> Column:
    return F.when(is_blank(text), F.lit(default)).otherwise(text)


def flag(condition: Column) -> Column:
    """0/1 from a condition; an unknown outcome counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def alert_flags(limits: AlertThresholds) -> dict[str, Column]:
    """The three alert flags of a reading and their union."""
    heart = (F.col("heart_rate") < limits.fc_basse) | (F.col("heart_rate") > limits.fc_haute)
    oxygen = F.col("spo2") < limits.spo2_basse
    heat = F.col("temp_c").cast("double") > limits.temp_haute
    return {
        "alerte_fc": flag(heart),
        "alerte_spo2": flag(oxygen),
        "alerte_temp": flag(heat),
        "en_alerte": flag(heart | oxygen | heat),
    }


def clock_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
