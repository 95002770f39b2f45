"""Star, indicators and cohorts."""

from pyspark.sql import functions as F

from lamina.contract import AlertThresholds
from lamina.functions.measures import alert_flags
from lamina.plans import cohort, kpi, star
from registry.book import entry, shown
from registry.oracle_parts import pct, rounded

DAYS = ("_jour_depot",)


@entry(
    "star_dims",
    """SELECT 'dim_patient' AS dimension, count(*) AS membres, count(DISTINCT patient_pseudo) AS cles FROM dim_patient
       UNION ALL SELECT 'dim_service', count(*), count(DISTINCT service_code) FROM dim_service
       UNION ALL SELECT 'dim_cim10', count(*), count(DISTINCT code_cim10) FROM dim_cim10
       UNION ALL SELECT 'dim_ccam', count(*), count(DISTINCT code_ccam) FROM dim_ccam""",
)
def star_dims(f):
    keys = {"dim_patient": "patient_pseudo", "dim_service": "service_code", "dim_cim10": "code_cim10", "dim_ccam": "code_ccam"}
    out = None
    for name, key in keys.items():
        groups = getattr(f, name).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        row = groups.agg(F.sum("n").alias("membres"), F.count(F.lit(1)).alias("cles")).select(
            F.lit(name).alias("dimension"), "membres", "cles"
        )
        out = row if out is None else out.unionByName(row)
    return out


entry("dim_patient", shown("dim_patient"))(lambda f: f.dim_patient)
entry("dim_incomplete", shown("dim_service"))(lambda f: f.dim_service)
entry("dim_cim10", shown("dim_cim10"))(lambda f: f.dim_cim10)
entry("dim_ccam", shown("dim_ccam", decimals=("tarif_euros",)))(lambda f: f.dim_ccam)

entry(
    "fact_stay",
    shown("fact_sejour", dates=("date_admission", "date_sortie"), moments=("admission_ts", "discharge_ts")),
)(lambda f: f.fact_sejour)
entry("fact_diag", shown("fact_diagnostic", dates=("date_admission",)))(lambda f: f.fact_diagnostic)
entry("fact_reading", shown("fact_releve", dates=("date_mesure",), moments=("ts",), decimals=("temp_c",)))(
    lambda f: f.fact_releve
)
entry("fact_act", shown("fact_acte", dates=("date_acte", "date_admission")))(lambda f: f.fact_acte)


@entry(
    "readmission_30d",
    "SELECT stay_id, est_sejour_index, readmission_30j_brute, suivi_readmission_30j FROM fact_sejour",
)
def readmission_30d(f):
    return star.with_readmission(f.stays).select(
        "stay_id", "est_sejour_index", "readmission_30j_brute", "suivi_readmission_30j"
    )


@entry(
    "alert_flags",
    """SELECT stay_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
              CAST(heart_rate < 62 OR heart_rate > 80 AS INTEGER) AS alerte_fc,
              CAST(spo2 < 90.5 AS INTEGER) AS alerte_spo2, CAST(temp_c > 38 AS INTEGER) AS alerte_temp,
              CAST(heart_rate < 62 OR heart_rate > 80 OR spo2 < 90.5 OR temp_c > 38 AS INTEGER) AS en_alerte
       FROM silver_monitoring""",
)
def alert_thresholds(f):
    """Thresholds are parameters: here, others than the defaults."""
    limits = AlertThresholds(fc_basse=62, fc_haute=80, spo2_basse=90.5, temp_haute=38)
    flags = [column.alias(name) for name, column in alert_flags(limits).items()]
    return f.silver("monitoring").select("stay_id", "ts", *flags)


entry("length_of_stay", shown("kpi_dms_service", dates=("mois",)))(
    lambda f: kpi.kpi_dms_service(f.stays, f.dim_service)
)
entry("daily_conditional", shown("kpi_urgences_jour", dates=("jour",)))(lambda f: kpi.kpi_urgences_jour(f.stays))
entry("readmission_rate", shown("kpi_readmission_service"))(
    lambda f: kpi.kpi_readmission_service(star.with_readmission(f.stays), f.dim_service)
)
entry("alert_rate", shown("kpi_alertes_jour", dates=("jour",)))(
    lambda f: kpi.kpi_alertes_jour(f.fact_releve, f.dim_service)
)
entry("occupancy_daily", shown("kpi_occupation_jour", dates=("jour",)))(
    lambda f: kpi.kpi_occupation_jour(f.stays, f.dim_service)
)
entry("outcome_rate", shown("kpi_mortalite_service"))(lambda f: kpi.kpi_mortalite_service(f.stays, f.dim_service))
entry("share_within_group", shown("kpi_casemix_service"))(
    lambda f: kpi.kpi_casemix_service(f.diagnoses, f.dim_service, f.dim_cim10)
)
entry("origin_share", shown("kpi_origine_service"))(
    lambda f: kpi.kpi_origine_service(f.stays, f.dim_service, f.dim_patient)
)
entry("activity_by_category", shown("kpi_activite_categorie"))(
    lambda f: kpi.kpi_activite_categorie(f.stays, f.dim_service)
)
entry("acts_per_service", shown("kpi_actes_service"))(
    lambda f: kpi.kpi_actes_service(f.fact_acte, f.stays, f.dim_service)
)
entry("acts_by_type", shown("kpi_actes_type", decimals=("tarif_euros",)))(
    lambda f: kpi.kpi_actes_type(f.fact_acte, f.dim_ccam)
)
entry("density_per_capacity", shown("kpi_densite_actes_lit"))(
    lambda f: kpi.kpi_densite_actes_lit(f.fact_acte, f.dim_service)
)
entry("billing", shown("kpi_facturation_service", decimals=("montant_euros",)))(
    lambda f: kpi.kpi_facturation_service(f.fact_acte, f.dim_service, f.dim_ccam)
)
entry("cohort_prevalence", shown("coh_prevalence"))(lambda f: cohort.coh_prevalence(f.diagnoses, f.dim_cim10))
entry("cohort_description", shown("coh_description"))(
    lambda f: cohort.coh_description(f.fact_diagnostic, f.dim_cim10)
)


@entry(
    "occupancy_sweep",
    """SELECT service_code, CAST(jour AS VARCHAR) AS jour, nb_presents AS presents, nb_admissions AS arrives,
              nb_sorties AS partis
       FROM (SELECT * FROM kpi_occupation_jour
             UNION ALL
             SELECT jour, service_code, NULL, count(*), count(*) FILTER (jour = date_admission),
                    count(*) FILTER (jour = date_sortie)
             FROM (SELECT service_code, date_admission, date_sortie,
                          unnest(generate_series(date_admission, least(coalesce(date_sortie, horizon), horizon),
                                                 INTERVAL 1 DAY))::DATE AS jour
                   FROM fact_sejour, (SELECT max(date_admission) AS horizon FROM fact_sejour)
                   WHERE service_code NOT IN (SELECT service_code FROM dim_service))
             GROUP BY ALL)""",
)
def occupancy_sweep(f):
    """The sweep on its own: every service code, in the nomenclature or not."""
    from lamina.operators.windows import presence_by_day

    return presence_by_day(f.stays, "service_code", "date_admission", "date_sortie")


@entry(
    "global_weighted",
    f"""SELECT {rounded("sum(dms_jours * nb_sejours_clos) / sum(nb_sejours_clos)")} AS dms_jours
        FROM kpi_dms_service""",
)
def global_weighted(f):
    table = kpi.kpi_dms_service(f.stays, f.dim_service)
    weighted = F.sum(F.col("dms_jours") * F.col("nb_sejours_clos")) / F.sum("nb_sejours_clos")
    return table.agg(F.round(weighted, 2).alias("dms_jours"))


@entry(
    "age_pyramid",
    """SELECT tranche_age, coalesce(sum(nb_patients) FILTER (sexe = 'F'), 0)::BIGINT AS femmes,
              -coalesce(sum(nb_patients) FILTER (sexe = 'M'), 0)::BIGINT AS hommes
       FROM coh_description GROUP BY tranche_age""",
)
def age_pyramid(f):
    cells = cohort.coh_description(f.fact_diagnostic, f.dim_cim10)

    def total(sex):
        return F.coalesce(F.sum(F.when(F.col("sexe") == sex, F.col("nb_patients"))), F.lit(0))

    return cells.groupBy("tranche_age").agg(total("F").alias("femmes"), (-total("M")).alias("hommes"))


@entry(
    "los_by_band",
    f"""SELECT service, tranche_age, {rounded("sum(duree_jours) / count(*)")} AS dms_jours, count(*) AS sejours
        FROM fact_sejour JOIN dim_service USING (service_code)
        WHERE est_en_cours = 0 AND tranche_age <> 'inconnu' GROUP BY service, tranche_age""",
)
def los_by_band(f):
    aged = star.with_age(f.stays, f.dim_patient, "admission_ts")
    return kpi.los_by_band(aged, f.dim_service)


@entry(
    "top_n",
    f"""SELECT code_ccam, acte, nb_actes, {pct("nb_actes", "(SELECT count(*) FROM fact_acte)")} AS part_pct
        FROM kpi_actes_type ORDER BY nb_actes DESC, code_ccam LIMIT 10""",
)
def top_n(f):
    table = kpi.kpi_actes_type(f.fact_acte, f.dim_ccam).select("code_ccam", "acte", "nb_actes", "part_pct")
    return table.orderBy(F.col("nb_actes").desc(), "code_ccam").limit(10)
