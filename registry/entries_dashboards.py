"""Dashboard questions, answered from the built warehouse."""

from pyspark.sql import functions as F

from lamina.plans.dashboards import answer
from registry import built
from registry.book import entry
from registry.oracle_parts import rounded

SQL = {
    "b02_stays": "SELECT sum(nb_sejours)::BIGINT AS nombre_de_sejours FROM kpi_readmission_service",
    "b03_length_of_stay": f"SELECT {rounded('sum(dms_jours * nb_sejours_clos) / sum(nb_sejours_clos)')} AS dms_jours FROM kpi_dms_service",
    "b04_readmission": f"SELECT {rounded('100.0::DOUBLE * sum(nb_readmis_30j_brut) / sum(nb_sejours)')} AS taux_readmission_pct FROM kpi_readmission_service",
    "b05_alerts": f"SELECT {rounded('100.0::DOUBLE * sum(nb_en_alerte) / sum(nb_releves)')} AS taux_alerte_pct FROM kpi_alertes_jour",
    "b06_los_by_service": "SELECT service, dms_jours FROM kpi_dms_service",
    "b07_los_spread": "SELECT service, dms_jours AS moyenne_jours, mediane_jours, p90_jours, max_jours, nb_sejours_clos FROM kpi_dms_service",
    "b08_emergency_by_day": "SELECT CAST(jour AS VARCHAR) AS jour, nb_passages_urgences FROM kpi_urgences_jour",
    "b09_urgent_by_day": "SELECT CAST(jour AS VARCHAR) AS jour, nb_admissions_en_urgence FROM kpi_urgences_jour",
    "b10_readmission_by_service": "SELECT service, taux_brut_pct FROM kpi_readmission_service",
    "b11_readmission_terms": "SELECT service, nb_readmis_30j_brut, nb_sejours, taux_brut_pct FROM kpi_readmission_service",
    "b12_alerts_by_day": f"SELECT CAST(jour AS VARCHAR) AS jour, {rounded('100.0::DOUBLE * sum(nb_en_alerte) / sum(nb_releves)')} AS taux_pct FROM kpi_alertes_jour GROUP BY kpi_alertes_jour.jour",
    "b13_occupancy": "SELECT CAST(jour AS VARCHAR) AS jour, service, nb_presents FROM kpi_occupation_jour",
    "b14_casemix": "SELECT service, pathologie, nb_sejours, part_pct FROM kpi_casemix_service",
    "b15_origin": "SELECT service, region_code, nb_sejours, nb_patients, part_pct FROM kpi_origine_service",
    "b16_mortality": "SELECT service, nb_deces, nb_sejours_clos, taux_pct FROM kpi_mortalite_service",
    "b17_acts": "SELECT sum(nb_actes)::BIGINT AS nombre_d_actes FROM kpi_actes_service",
    "b18_billed": "SELECT sum(montant_euros)::DOUBLE AS montant_euros FROM kpi_facturation_service",
    "b19_acts_per_stay": f"SELECT {rounded('sum(nb_actes)::DOUBLE / sum(nb_sejours)')} AS actes_par_sejour FROM kpi_actes_service",
    "b20_described_services": "SELECT (SELECT count(*) FROM kpi_densite_actes_lit) || ' / ' || (SELECT count(*) FROM kpi_actes_service) AS services_decrits",
    "b21_activity_by_category": "SELECT categorie, dms_jours, nb_sejours FROM kpi_activite_categorie",
    "b22_acts_by_service": "SELECT service, nb_actes, actes_par_sejour FROM kpi_actes_service",
    "b23_acts_by_type": "SELECT acte, nb_actes, part_pct, nb_sejours_concernes, CAST(tarif_euros AS DOUBLE) AS tarif_euros FROM kpi_actes_type",
    "b24_acts_per_bed": "SELECT service, actes_par_lit, nb_actes, capacite_lits FROM kpi_densite_actes_lit",
    "b25_billing_by_service": "SELECT service, CAST(montant_euros AS DOUBLE) AS montant_euros, nb_actes, montant_moyen_euros, nb_actes_sans_tarif FROM kpi_facturation_service",
    "b26_pathologies": "SELECT count(*) AS nombre_de_pathologies FROM coh_prevalence",
    "b27_headcount": "SELECT sum(nb_patients)::BIGINT AS effectif_total FROM coh_description",
    "b28_prevalence": "SELECT pathologie, nb_patients FROM coh_prevalence",
    "b29_prevalence_terms": "SELECT pathologie, nb_patients, nb_patients_principal, nb_sejours FROM coh_prevalence",
    "b30_age_pyramid": """SELECT tranche_age, coalesce(sum(nb_patients) FILTER (sexe = 'F'), 0)::BIGINT AS femmes,
                                 -coalesce(sum(nb_patients) FILTER (sexe = 'M'), 0)::BIGINT AS hommes
                          FROM coh_description GROUP BY tranche_age""",
    "b31_cells": "SELECT pathologie, tranche_age, sexe, nb_patients FROM coh_description",
}


for name in SQL:
    entry(f"dashboard_{name}", SQL[name])(lambda f, name=name: answer(name, built.published(f)))


@entry(
    "dashboard_b01_last_build",
    "SELECT 1 AS pendant_la_construction, count(*) AS lignes_de_ce_jour FROM kpi_dms_service",
)
def last_build(f):
    """The date of the last build: by the ledger's times, which no SQL could give, and the rows that bear it."""
    ledger = built.warehouse(f).read("ops", "executions").agg(
        F.min("demarre_a").alias("debut"), F.max("termine_a").alias("fin"))
    when = F.col("derniere_construction").cast("timestamp")
    # The clock of the plan is read when it is made, the ledger's when the stage begins and ends.
    inside = when.between(F.col("debut").cast("timestamp") - F.expr("INTERVAL 1 SECOND"), F.col("fin").cast("timestamp"))
    rows = built.published(f)["kpi_dms_service"]
    bearing = rows.join(
        answer("b01_last_build", built.published(f)), rows["_built_at"] == F.col("derniere_construction"), "left_semi")
    return answer("b01_last_build", built.published(f)).crossJoin(ledger).crossJoin(
        bearing.agg(F.count(F.lit(1)).alias("lignes_de_ce_jour"))
    ).select(inside.cast("int").alias("pendant_la_construction"), "lignes_de_ce_jour")
