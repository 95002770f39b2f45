"""Lake to bronze: typing without losing a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from lamina.contract import BRONZE, REFERENCES
from lamina.functions.parsing import illegible, is_blank, tolerant_decimal, tolerant_int, tolerant_timestamp


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the columns of a declared schema, in order; a missing one is NULL."""
    wanted = StructType.fromDDL(ddl)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted
        ]
    )


def _text(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def type_patients(lake: DataFrame) -> DataFrame:
    return lake.withColumn("birth_year", tolerant_int(_text(lake, "birth_year")))


def type_stays(lake: DataFrame) -> DataFrame:
    """An absent discharge is an open stay; a written one that cannot be read is flagged."""
    written = _text(lake, "discharge_ts")
    discharge = tolerant_timestamp(F.when(~is_blank(written), written))
    return (
        lake.withColumn("_discharge_illisible", illegible(written, discharge))
        .withColumn("discharge_ts", discharge)
        .withColumn("admission_ts", tolerant_timestamp(_text(lake, "admission_ts")))
    )


def flatten(df: DataFrame, column: str) -> DataFrame:
    """One row per array element; a row without elements gives none."""
    return df.select(*[c for c in df.columns if c != column], F.inline(column))


def type_diagnostics(lake: DataFrame) -> DataFrame:
    return flatten(lake, "diagnostics").withColumnRenamed("type", "type_diag")


def type_readings(lake: DataFrame) -> DataFrame:
    """Explicit conversions; 37.25 rounds half up to 37.3."""
    return (
        lake.withColumn("heart_rate", F.col("heart_rate").cast("int"))
        .withColumn("spo2", F.col("spo2").cast("int"))
        .withColumn("temp_c", F.col("temp_c").cast("decimal(4,1)"))
    )


TYPED = {
    "patients": type_patients,
    "sejours": type_stays,
    "diagnostics": type_diagnostics,
    "monitoring": type_readings,
    "actes": lambda lake: lake,
}


def stamped(df: DataFrame, run_id: str, moment: str = "_ingested_at") -> DataFrame:
    return df.withColumn(moment, F.current_timestamp()).withColumn("_run_id", F.lit(run_id))


def bronze_frame(feed: str, lake: DataFrame, run_id: str) -> DataFrame:
    return conform(stamped(TYPED[feed](lake), run_id), BRONZE[feed])


def reference_frame(table: str, raw: DataFrame, run_id: str) -> DataFrame:
    if table == "ref_ccam":
        raw = raw.withColumn("tarif_euros", tolerant_decimal(_text(raw, "tarif_euros"), 10, 2))
    if table == "ref_description_service":
        raw = raw.withColumn("capacite_lits", tolerant_int(_text(raw, "capacite_lits")))
    return conform(stamped(raw, run_id), REFERENCES[table])
