"""Silver to the star: four dimensions and four facts at event grain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.contract import (
    DEATH, PRINCIPAL, READMISSION_DAYS, UNDESCRIBED, UNKNOWN, URGENT_MODE, AlertThresholds,
)
from lamina.functions.measures import age_at, alert_flags, decade_band, flag
from lamina.operators.windows import returns_within

# ---- dimensions ------------------------------------------------------------


def dim_patient(silver_patients: DataFrame) -> DataFrame:
    return silver_patients.select(
        "patient_pseudo", "birth_year", F.col("sex").alias("sexe"), F.col("region_code").alias("region")
    )


def dim_service(ref_services: DataFrame, ref_description: DataFrame) -> DataFrame:
    """Every service, described or not.

    Grouping columns of an undescribed service say so; its capacity stays
    NULL, because a denominator nobody knows must not become a number.
    """
    described = ref_description.select(
        F.col("service_code").alias("_described"), "categorie", "capacite_lits", "pole"
    )
    absent = F.col("_described").isNull()

    def axis(column):
        return F.when(absent, F.lit(UNDESCRIBED)).otherwise(F.col(column)).alias(column)

    return ref_services.join(
        described, ref_services["service_code"] == F.col("_described"), "left"
    ).select(
        "service_code",
        F.col("service_label").alias("service"),
        axis("categorie"),
        "capacite_lits",
        axis("pole"),
    )


def dim_cim10(ref_cim10: DataFrame) -> DataFrame:
    return ref_cim10.select("code_cim10", F.col("libelle").alias("pathologie"))


def dim_ccam(ref_ccam: DataFrame) -> DataFrame:
    return ref_ccam.select("code_ccam", F.col("libelle").alias("acte"), "tarif_euros")


# ---- facts -----------------------------------------------------------------


def stay_measures(silver_stays: DataFrame) -> DataFrame:
    """Row-local part of the stay fact: dates, flags, duration. No join, no shuffle."""
    closed = F.col("est_en_cours") == 0
    return silver_stays.select(
        "stay_id",
        "patient_pseudo",
        "service_code",
        F.to_date("admission_ts").alias("date_admission"),
        F.to_date("discharge_ts").alias("date_sortie"),
        "admission_ts",
        "discharge_ts",
        "admission_mode",
        "discharge_mode",
        "duree_jours",
        "est_en_cours",
        flag(F.col("admission_mode") == URGENT_MODE).alias("est_urgence"),
        flag(closed & (F.col("discharge_mode") != DEATH)).alias("est_sejour_index"),
    )


def with_readmission(stays: DataFrame, days: int = READMISSION_DAYS, among: DataFrame | None = None) -> DataFrame:
    """Both readmission measures: every closed stay, and index stays only."""
    back = returns_within(
        stays, "patient_pseudo", "admission_ts", "discharge_ts", days, "readmission_30j_brute", among)
    return back.withColumn(
        "suivi_readmission_30j", F.col("readmission_30j_brute") * F.col("est_sejour_index")
    )


def with_age(fact: DataFrame, patients: DataFrame, moment: str, sex: bool = False) -> DataFrame:
    """Age and band at the event; unknown patients keep their rows."""
    wanted = patients.select("patient_pseudo", "birth_year", "sexe")
    joined = fact.join(wanted, "patient_pseudo", "left").withColumn(
        "age_au_sejour", age_at(F.col(moment), F.col("birth_year"))
    )
    aged = joined.withColumn("tranche_age", decade_band(F.col("age_au_sejour"))).drop("birth_year")
    return aged.withColumn("sexe", F.coalesce("sexe", F.lit(UNKNOWN))) if sex else aged.drop("sexe")


FACT_SEJOUR = [
    "stay_id", "patient_pseudo", "service_code", "date_admission", "date_sortie", "admission_ts",
    "discharge_ts", "admission_mode", "discharge_mode", "age_au_sejour", "tranche_age", "duree_jours",
    "est_en_cours", "est_urgence", "est_sejour_index", "suivi_readmission_30j", "readmission_30j_brute",
]


def fact_sejour(silver_stays: DataFrame, patients: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The stay fact; `among` holds the admissions that may answer its discharges, all stays by default."""
    measured = with_readmission(stay_measures(silver_stays), among=among)
    return with_age(measured, patients, "admission_ts").select(*FACT_SEJOUR)


def diagnosis_measures(silver_diagnostics: DataFrame) -> DataFrame:
    return silver_diagnostics.select(
        "stay_id",
        "patient_pseudo",
        "code_cim10",
        "service_code",
        F.to_date("admission_ts").alias("date_admission"),
        "type_diag",
        flag(F.col("type_diag") == PRINCIPAL).alias("est_principal"),
        "sejour_coherent",
    )


def fact_diagnostic(silver_diagnostics: DataFrame, patients: DataFrame) -> DataFrame:
    return with_age(diagnosis_measures(silver_diagnostics), patients, "date_admission", sex=True).select(
        "stay_id", "patient_pseudo", "code_cim10", "service_code", "date_admission", "type_diag",
        "est_principal", "sejour_coherent", "age_au_sejour", "tranche_age", "sexe",
    )


def fact_releve(silver_readings: DataFrame, limits: AlertThresholds = AlertThresholds()) -> DataFrame:
    return silver_readings.select(
        "stay_id",
        "patient_pseudo",
        "service_code",
        "ts",
        F.to_date("ts").alias("date_mesure"),
        "heart_rate",
        "spo2",
        "temp_c",
        *[column.alias(name) for name, column in alert_flags(limits).items()],
        "sejour_coherent",
    )


def fact_acte(silver_acts: DataFrame) -> DataFrame:
    """No pseudonym: this fact is open to steering, at event grain."""
    return silver_acts.select(
        "stay_id",
        "code_ccam",
        "service_code",
        F.to_date("acte_ts").alias("date_acte"),
        F.to_date("admission_ts").alias("date_admission"),
        "sejour_coherent",
    )
