import hashlib
import hmac
import string
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lamina.contract import AlertThresholds
from lamina.functions import measures, parsing
from lamina.functions.privacy import generalise_year, pseudonymise

from conftest import rows


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, build, kind="string"):
    out = column(spark, values, kind).select("i", build(F.col("v")).alias("r")).orderBy("i").collect()
    return [row.r for row in out]


SALTS = [b"sel", b"x" * 64, b"long " * 40]


@pytest.mark.parametrize("salt", SALTS)
def test_pseudonym_is_hmac(spark, salt):
    ids = ["IPP0000001", " IPP1 ", "é漢", "0"]
    expected = [hmac.new(salt, i.encode(), hashlib.sha256).hexdigest()[:16] for i in ids]
    assert apply(spark, ids, lambda c: pseudonymise(c, salt)) == expected


def test_blank_identifier_is_never_hashed(spark):
    assert apply(spark, ["", "  ", "\t", "\n", " ", None], lambda c: pseudonymise(c, b"sel")) == [""] * 6


def test_salt_changes_the_pseudonym_and_is_required(spark):
    one, other = (apply(spark, ["IPP1"], lambda c, s=s: pseudonymise(c, s)) for s in (b"a", b"b"))
    assert one != other
    with pytest.raises(ValueError):
        pseudonymise(F.lit("x"), b"")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.printable + "éàç", min_size=1, max_size=80), min_size=1, max_size=20))
def test_pseudonym_property(spark, ids):
    expected = [
        "" if not i.strip() else hmac.new(b"sel", i.encode(), hashlib.sha256).hexdigest()[:16] for i in ids
    ]
    assert apply(spark, ids, lambda c: pseudonymise(c, b"sel")) == expected


def test_year(spark):
    given_ = ["1933-12-09", "  1975-06-30  ", "1975", "", "   ", "inconnu", "09/12/1933", "n/a", None]
    assert apply(spark, given_, generalise_year) == ["1933", "1975", "1975", "", "", "", "", "", ""]


def test_tolerant_numbers(spark):
    assert apply(spark, ["12", "0", "65535", "65536", "-1", "1.5", "", "x", None, "9" * 30], parsing.tolerant_int) == [
        12, 0, 65535, None, None, None, None, None, None, None,
    ]
    assert apply(spark, ["-5", "5"], lambda c: parsing.tolerant_int(c, -10, 10)) == [-5, 5]
    got = apply(spark, ["12.5", "", "abc", None, "99999999999"], lambda c: parsing.tolerant_decimal(c, 10, 2))
    assert [None if v is None else float(v) for v in got] == [12.5, None, None, None, None]


def test_tolerant_timestamp_and_flag(spark):
    texts = ["2026-08-01 00:06:00", "2026-08-01T00:06:00", "01/08/2026 00:06", "20260801", "pas une date", "", None]
    moment, midnight = datetime(2026, 8, 1, 0, 6), datetime(2026, 8, 1)
    parsed = apply(spark, texts, parsing.tolerant_timestamp)
    assert parsed == [moment, moment, moment, midnight, None, None, None]
    flags = apply(spark, texts, lambda c: parsing.illegible(c, parsing.tolerant_timestamp(c)))
    assert flags == [0, 0, 0, 0, 1, 0, 0]


def test_minutes_count_borders(spark):
    df = spark.createDataFrame(
        [
            (datetime(2026, 1, 1, 0, 0, 59), datetime(2026, 1, 1, 0, 1, 0)),
            (datetime(2026, 1, 1, 0, 0, 0), datetime(2026, 1, 1, 0, 0, 59)),
            (datetime(2026, 1, 2), datetime(2026, 1, 1)),
            (datetime(1960, 1, 1, 0, 0, 30), datetime(1960, 1, 1, 0, 1, 10)),
            (datetime(2026, 1, 1), None),
        ],
        "a timestamp_ntz, b timestamp_ntz",
    )
    got = [r.m for r in df.select(measures.minutes_between(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [1, 0, -1440, 1, None]
    days = df.select(measures.duration_days(F.col("a"), F.col("b")).alias("d")).collect()
    assert days[2].d == -1.0 and days[4].d is None


def test_age_bands(spark):
    assert apply(spark, [0, 9, 10, 45, 101, -1, None], measures.decade_band, "int") == [
        "0-9", "0-9", "10-19", "40-49", "100-109", "0-9", "inconnu",
    ]


def test_ratio_and_rounding(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (5, 0), (0, 4)], "a bigint, b bigint")
    got = [r.r for r in df.select(measures.ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [0.13, 0.33, 0.0, 0.0]


def test_temperature_rounds_half_up(spark):
    got = apply(spark, [37.25, 37.24, 37.35], lambda c: c.cast("decimal(4,1)"), "double")
    assert [float(v) for v in got] == [37.3, 37.2, 37.4]


def test_sentinel_month(spark):
    got = apply(spark, ["2026-08-01", None], lambda c: measures.partition_month(c.cast("date")))
    assert got == ["202608", "197001"]


def test_sex_and_default_labels(spark):
    assert apply(spark, ["  f  ", "M", "X", "", None], measures.normalise_sex) == ["F", "M", "inconnu", "inconnu", "inconnu"]
    assert apply(spark, ["domicile", "", None], measures.default_label) == ["domicile", "inconnu", "inconnu"]


def test_alert_flags_and_thresholds(spark):
    df = spark.createDataFrame(
        [(50, 92, 38.5), (49, 92, 38.5), (100, 91, 38.5), (101, 95, 38.6)], "heart_rate int, spo2 int, temp_c double"
    )
    flags = measures.alert_flags(AlertThresholds())
    got = df.select(*[c.alias(n) for n, c in flags.items()])
    assert [tuple(r) for r in got.collect()] == [(0, 0, 0, 0), (1, 0, 0, 1), (0, 1, 0, 1), (1, 0, 1, 1)]
    for bad in ("50", None, float("nan"), True):
        with pytest.raises(ValueError):
            AlertThresholds(fc_basse=bad)


def test_rows_helper_is_stable(spark):
    assert rows(column(spark, ["b", "a"]), "v") == [("a",), ("b",)]
