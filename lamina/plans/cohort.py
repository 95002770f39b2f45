"""Cohort tables for research: aggregates only, never fewer than k persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamina.contract import SMALL_CELL, UNKNOWN
from lamina.operators.cells import distinct_members, large_cells

CELLS = ["code_cim10", "tranche_age", "sexe"]


def coh_prevalence(diagnoses: DataFrame, dim_cim10: DataFrame, k: int = SMALL_CELL) -> DataFrame:
    """Patients per pathology, all diagnoses and principal ones; `nb_sejours` counts diagnosis rows."""
    persons = distinct_members(
        diagnoses, ["code_cim10"], "patient_pseudo", principal=F.max("est_principal")
    )
    return prevalence_from(persons, dim_cim10, k)


def prevalence_from(persons: DataFrame, dim_cim10: DataFrame, k: int = SMALL_CELL) -> DataFrame:
    """One row per code_cim10 and patient_pseudo, with nb_lignes and whether one is principal."""
    reduced = persons.groupBy("code_cim10").agg(
        F.count(F.lit(1)).alias("nb_patients"),
        F.sum("principal").alias("nb_patients_principal"),
        F.sum("nb_lignes").alias("nb_sejours"),
    )
    return large_cells(reduced, "nb_patients", k).join(dim_cim10, "code_cim10").select(
        "code_cim10", "pathologie", "nb_patients", "nb_patients_principal", "nb_sejours"
    )


def coh_description(diagnoses: DataFrame, dim_cim10: DataFrame, k: int = SMALL_CELL) -> DataFrame:
    """Pathology x age band x sex, on principal diagnoses of known age."""
    known = diagnoses.where((F.col("est_principal") == 1) & (F.col("tranche_age") != UNKNOWN))
    return description_from(distinct_members(known, CELLS, "patient_pseudo"), dim_cim10, k)


def description_from(persons: DataFrame, dim_cim10: DataFrame, k: int = SMALL_CELL) -> DataFrame:
    """One row per cell and patient_pseudo."""
    reduced = persons.groupBy(*CELLS).agg(F.count(F.lit(1)).alias("nb_patients"))
    return large_cells(reduced, "nb_patients", k).join(dim_cim10, "code_cim10").select(
        "code_cim10", "pathologie", "tranche_age", "sexe", "nb_patients"
    )
