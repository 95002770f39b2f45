"""The thirteen indicator tables.

Facts are reduced on their own keys first; dimensions meet the reduced rows.
Inner joins to a dimension drop the codes it does not hold, left joins keep
them: each indicator says which it wants.

`kpi_*` go from the facts to the indicator. The `from_*` they end with start
from reduced rows, which may be in parts (one for each month, say): all their
measures add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.contract import DEATH, EMERGENCY_SERVICE, UNKNOWN
from lamina.functions.measures import MINUTES_PER_DAY, month_start, percentage, ratio
from lamina.operators.cells import distinct_members, share_within
from lamina.operators.windows import presence_by_day


def rows() -> Column:
    return F.count(F.lit(1))


def named(dim_service: DataFrame, *extra: str) -> DataFrame:
    return dim_service.select("service_code", "service", *extra)


# ---- lengths of stay -------------------------------------------------------


def duration_counts(stays: DataFrame, *keys: Column) -> DataFrame:
    """Number of stays per key and duration.

    Durations are whole minutes, so a group has as many rows as distinct
    durations, bounded by the longest stay whatever the number of stays. Sums
    run on integer minutes: exact, and the same in any order.
    """
    minutes = F.round(F.col("duree_jours") * MINUTES_PER_DAY).cast("bigint")
    return stays.groupBy(*keys, "est_en_cours", minutes.alias("minutes")).agg(rows().alias("n"))


def duration_summary() -> dict[str, Column]:
    """Mean, median, P90, maximum of the closed stays, from `duration_counts`."""
    closed = F.col("est_en_cours") == 0
    n = F.when(closed, F.col("n"))
    total = F.sum(F.when(closed, F.col("minutes") * F.col("n")))
    days = F.when(closed, F.col("minutes") / F.lit(float(MINUTES_PER_DAY)))
    weight = F.coalesce(n, F.lit(0))
    return {
        "dms_jours": F.round(total / F.lit(float(MINUTES_PER_DAY)) / F.sum(n), 2),
        "dms_heures": F.round(total / F.lit(60.0) / F.sum(n), 1),
        "mediane_jours": F.round(F.percentile(days, 0.5, weight), 2),
        "p90_jours": F.round(F.percentile(days, 0.9, weight), 2),
        "max_jours": F.round(F.max(days), 2),
    }


def kpi_dms_service(stays: DataFrame, dim_service: DataFrame) -> DataFrame:
    month = month_start(F.col("date_admission")).alias("mois")
    closed = stays.where(F.col("est_en_cours") == 0)
    return dms_from(duration_counts(closed, F.col("service_code"), month), dim_service)


def dms_from(counts: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Counts of closed stays by service_code, mois, minutes."""
    reduced = counts.where(F.col("est_en_cours") == 0).groupBy("service_code", "mois").agg(
        *[column.alias(name) for name, column in duration_summary().items()],
        F.sum("n").alias("nb_sejours_clos"),
    )
    return reduced.join(named(dim_service), "service_code").select(
        "service_code", "service", "mois", "dms_jours", "dms_heures", "mediane_jours", "p90_jours",
        "max_jours", "nb_sejours_clos",
    )


def kpi_activite_categorie(stays: DataFrame, dim_service: DataFrame) -> DataFrame:
    return categories_from(duration_counts(stays, F.col("service_code")), dim_service)


def categories_from(counts: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Counts of stays by service_code, est_en_cours, minutes."""
    summary = duration_summary()
    return (
        counts.join(dim_service.select("service_code", "categorie"), "service_code")
        .groupBy("categorie")
        .agg(
            F.sum("n").alias("nb_sejours"),
            F.coalesce(F.sum(F.when(F.col("est_en_cours") == 0, F.col("n"))), F.lit(0)).alias("nb_sejours_clos"),
            *[summary[name].alias(name) for name in ("dms_jours", "dms_heures", "mediane_jours", "p90_jours")],
        )
    )


def los_by_band(stays: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Mean length of stay by service and age band, closed stays of known age."""
    known = stays.where((F.col("est_en_cours") == 0) & (F.col("tranche_age") != UNKNOWN))
    counts = duration_counts(known, F.col("service_code"), F.col("tranche_age"))
    reduced = counts.groupBy("service_code", "tranche_age").agg(
        duration_summary()["dms_jours"].alias("dms_jours"), F.sum("n").alias("sejours")
    )
    return reduced.join(named(dim_service), "service_code").select(
        "service", "tranche_age", "dms_jours", "sejours"
    )


# ---- activity by day -------------------------------------------------------


def kpi_urgences_jour(stays: DataFrame, emergency: str = EMERGENCY_SERVICE) -> DataFrame:
    """Two readings side by side: the emergency service, and the urgent admission mode."""
    wanted = ("nb_sejours", "nb_urgents", "nb_ici", "nb_ici_presents", "nb_ici_clos", "minutes_ici")
    sums = [column.alias(name) for name, column in stay_sums(emergency).items() if name in wanted]
    return urgences_from(stays.groupBy(F.col("date_admission").alias("jour")).agg(*sums))


def stay_sums(emergency: str = EMERGENCY_SERVICE) -> dict[str, Column]:
    """What is counted over stays, whatever they are grouped by."""
    here, closed = F.col("service_code") == emergency, F.col("est_en_cours") == 0
    minutes = F.round(F.col("duree_jours") * MINUTES_PER_DAY).cast("bigint")
    return {
        "nb_sejours": rows(),
        "nb_clos": F.count_if(closed),
        "nb_deces": F.count_if(closed & (F.col("discharge_mode") == DEATH)),
        "nb_urgents": F.count_if(F.col("est_urgence") == 1),
        "nb_brut": F.sum("readmission_30j_brute"),
        "nb_index": F.sum("est_sejour_index"),
        "nb_suivi": F.sum("suivi_readmission_30j"),
        "nb_ici": F.count_if(here),
        "nb_ici_presents": F.count_if(here & (F.col("est_en_cours") == 1)),
        "nb_ici_clos": F.count_if(here & closed),
        "minutes_ici": F.coalesce(F.sum(F.when(here & closed, minutes)), F.lit(0)),
    }


def urgences_from(sums: DataFrame) -> DataFrame:
    """Sums of stays by jour."""
    hours = F.sum("minutes_ici") / F.lit(60.0) / F.sum("nb_ici_clos")
    return sums.groupBy("jour").agg(
        F.sum("nb_ici").alias("nb_passages_urgences"),
        F.sum("nb_ici_presents").alias("nb_encore_presents"),
        F.round(F.when(F.sum("nb_ici_clos") > 0, hours).otherwise(0.0), 1).alias("duree_moy_heures"),
        F.sum("nb_urgents").alias("nb_admissions_en_urgence"),
        F.sum("nb_sejours").alias("nb_sejours"),
    )


def kpi_alertes_jour(readings: DataFrame, dim_service: DataFrame) -> DataFrame:
    return alertes_from(reading_sums(readings), dim_service)


def reading_sums(readings: DataFrame, *keys: Column) -> DataFrame:
    return readings.groupBy(*keys, F.col("date_mesure").alias("jour"), "service_code").agg(
        rows().alias("nb_releves"), F.count_if(F.col("en_alerte") == 1).alias("nb_en_alerte")
    )


def alertes_from(sums: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Sums of readings by jour, service_code; no pair in two parts."""
    return sums.join(named(dim_service), "service_code").select(
        "jour", "service_code", "service", "nb_releves", "nb_en_alerte",
        percentage(F.col("nb_en_alerte"), F.col("nb_releves")).alias("taux_pct"),
    )


def kpi_occupation_jour(stays: DataFrame, dim_service: DataFrame) -> DataFrame:
    return occupation_from(presence_by_day(stays, "service_code", "date_admission", "date_sortie"), dim_service)


def occupation_from(present: DataFrame, dim_service: DataFrame) -> DataFrame:
    return present.join(named(dim_service), "service_code").select(
        "jour", "service_code", "service",
        F.col("presents").alias("nb_presents"),
        F.col("arrives").alias("nb_admissions"),
        F.col("partis").alias("nb_sorties"),
    )


# ---- rates by service ------------------------------------------------------


def kpi_readmission_service(stays: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Raw rate over all stays, adjusted rate over closed stays of living patients."""
    sums = stays.groupBy("service_code").agg(
        rows().alias("nb_sejours"),
        F.sum("readmission_30j_brute").alias("nb_brut"),
        F.sum("est_sejour_index").alias("nb_index"),
        F.sum("suivi_readmission_30j").alias("nb_suivi"),
    )
    return readmission_from(sums, dim_service)


def readmission_from(sums: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Sums of stays by service_code."""
    reduced = sums.groupBy("service_code").agg(
        F.sum("nb_sejours").alias("nb_sejours"),
        F.sum("nb_brut").alias("nb_readmis_30j_brut"),
        F.sum("nb_index").alias("nb_sejours_index"),
        F.sum("nb_suivi").alias("nb_readmis_30j"),
    )
    return reduced.join(named(dim_service), "service_code").select(
        "service_code", "service", "nb_sejours", "nb_readmis_30j_brut",
        percentage(F.col("nb_readmis_30j_brut"), F.col("nb_sejours")).alias("taux_brut_pct"),
        "nb_sejours_index", "nb_readmis_30j",
        percentage(F.col("nb_readmis_30j"), F.col("nb_sejours_index")).alias("taux_pct"),
    )


def kpi_mortalite_service(stays: DataFrame, dim_service: DataFrame) -> DataFrame:
    closed = stays.where(F.col("est_en_cours") == 0)
    return mortalite_from(
        closed.groupBy("service_code").agg(
            rows().alias("nb_clos"), F.count_if(F.col("discharge_mode") == DEATH).alias("nb_deces")),
        dim_service)


def mortalite_from(sums: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Sums of stays by service_code; a service without a closed stay has no row."""
    reduced = sums.groupBy("service_code").agg(
        F.sum("nb_clos").alias("nb_sejours_clos"), F.sum("nb_deces").alias("nb_deces")
    ).where(F.col("nb_sejours_clos") > 0)
    return reduced.join(named(dim_service), "service_code").select(
        "service_code", "service", "nb_sejours_clos", "nb_deces",
        percentage(F.col("nb_deces"), F.col("nb_sejours_clos")).alias("taux_pct"),
    )


def kpi_casemix_service(diagnoses: DataFrame, dim_service: DataFrame, dim_cim10: DataFrame) -> DataFrame:
    """Principal diagnoses by service; shares are of the resolved codes of the service."""
    principal = diagnoses.where(F.col("est_principal") == 1)
    return casemix_from(
        principal.groupBy("service_code", "code_cim10").agg(rows().alias("nb_principaux")), dim_service, dim_cim10)


def casemix_from(sums: DataFrame, dim_service: DataFrame, dim_cim10: DataFrame) -> DataFrame:
    """Principal diagnoses by service_code, code_cim10."""
    reduced = sums.groupBy("service_code", "code_cim10").agg(F.sum("nb_principaux").alias("nb_sejours"))
    resolved = reduced.where(F.col("nb_sejours") > 0).join(named(dim_service), "service_code").join(dim_cim10, "code_cim10")
    return share_within(resolved, "service_code", "nb_sejours", "part_pct").select(
        "service_code", "service", "code_cim10", "pathologie", "nb_sejours", "part_pct"
    )


def kpi_origine_service(stays: DataFrame, dim_service: DataFrame, dim_patient: DataFrame) -> DataFrame:
    """Where the patients of a service live. Stays are first reduced to patients,
    so a patient with very many stays is one row per service at the join."""
    return origine_from(distinct_members(stays, ["service_code"], "patient_pseudo"), dim_service, dim_patient)


def origine_from(visits: DataFrame, dim_service: DataFrame, dim_patient: DataFrame) -> DataFrame:
    """One row per service_code and patient_pseudo, with nb_lignes."""
    homes = dim_patient.select("patient_pseudo", F.col("region").alias("region_code"))
    reduced = (
        visits.join(homes, "patient_pseudo")
        .groupBy("service_code", "region_code")
        .agg(F.sum("nb_lignes").alias("nb_sejours"), rows().alias("nb_patients"))
    )
    resolved = reduced.join(named(dim_service), "service_code")
    return share_within(resolved, "service_code", "nb_sejours", "part_pct").select(
        "service_code", "service", "region_code", "nb_sejours", "nb_patients", "part_pct"
    )


# ---- acts ------------------------------------------------------------------


def kpi_actes_service(acts: DataFrame, stays: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Two facts, each reduced to the service before they meet: no stay counts twice."""
    stay_counts = stays.groupBy("service_code").agg(rows().alias("nb_sejours"))
    return actes_from(distinct_members(acts, ["service_code"], "stay_id"), stay_counts, dim_service)


def actes_from(treated: DataFrame, stay_sums: DataFrame, dim_service: DataFrame) -> DataFrame:
    """One row per service_code and stay_id with nb_lignes; nb_sejours by service_code."""
    by_service = treated.groupBy("service_code").agg(
        F.sum("nb_lignes").alias("nb_actes"), rows().alias("nb_sejours_avec_acte"))
    stay_counts = stay_sums.groupBy("service_code").agg(F.sum("nb_sejours").alias("nb_sejours"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("nb_actes", "nb_sejours", "nb_sejours_avec_acte")]
    joined = (
        named(dim_service, "categorie")
        .join(by_service, "service_code", "left")
        .join(stay_counts, "service_code", "left")
        .select("service_code", "service", "categorie", *filled)
    )
    return joined.select(
        "*",
        ratio(F.col("nb_actes"), F.col("nb_sejours")).alias("actes_par_sejour"),
        ratio(F.col("nb_actes"), F.col("nb_sejours_avec_acte")).alias("actes_par_sejour_avec_acte"),
    )


def kpi_actes_type(acts: DataFrame, dim_ccam: DataFrame) -> DataFrame:
    """By code, resolved or not, with its share of all acts.

    The grand total is summed over the pairs of code and stay, whose shuffle it can share.
    """
    return types_from(distinct_members(acts, ["code_ccam"], "stay_id"), dim_ccam)


def types_from(treated: DataFrame, dim_ccam: DataFrame) -> DataFrame:
    """One row per code_ccam and stay_id, with nb_lignes."""
    by_code = treated.groupBy("code_ccam").agg(
        F.sum("nb_lignes").alias("nb_actes"), rows().alias("nb_sejours_concernes"))
    total = treated.agg(F.sum("nb_lignes")).scalar()
    return by_code.join(dim_ccam, "code_ccam", "left").select(
        "code_ccam",
        F.coalesce("acte", F.lit(UNKNOWN)).alias("acte"),
        "nb_actes",
        F.round(F.lit(100.0) * F.col("nb_actes") / total, 2).alias("part_pct"),
        "nb_sejours_concernes",
        "tarif_euros",
    )


def kpi_densite_actes_lit(acts: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Acts per bed. Without a known capacity there is no row, not a zero."""
    return densite_from(acts.groupBy("service_code").agg(rows().alias("n")), dim_service)


def densite_from(counts: DataFrame, dim_service: DataFrame) -> DataFrame:
    """Numbers of acts n, by service_code at least."""
    equipped = named(dim_service, "categorie", "capacite_lits").where(F.col("capacite_lits").isNotNull())
    counts = counts.groupBy("service_code").agg(F.sum("n").alias("nb_actes"))
    return counts.join(equipped, "service_code").select(
        "service_code", "service", "categorie", "capacite_lits", "nb_actes",
        F.round(F.try_divide(F.col("nb_actes"), F.col("capacite_lits")), 2).alias("actes_par_lit"),
    )


def kpi_facturation_service(acts: DataFrame, dim_service: DataFrame, dim_ccam: DataFrame) -> DataFrame:
    """Amount billed by service; acts without a tariff are counted, and left out of the mean.

    Prices meet (service, code) counts, not acts.
    """
    return facturation_from(acts.groupBy("service_code", "code_ccam").agg(rows().alias("n")), dim_service, dim_ccam)


def facturation_from(counts: DataFrame, dim_service: DataFrame, dim_ccam: DataFrame) -> DataFrame:
    """Numbers of acts n by service_code, code_ccam."""
    priced = counts.join(dim_ccam.select("code_ccam", "tarif_euros"), "code_ccam", "left")
    no_price = F.col("tarif_euros").isNull()
    amount = F.coalesce(F.col("tarif_euros"), F.lit(0).cast("decimal(10,2)")) * F.col("n").cast("decimal(18,0)")
    reduced = priced.groupBy("service_code").agg(
        F.sum("n").alias("nb_actes"),
        F.coalesce(F.sum(F.when(no_price, F.col("n"))), F.lit(0)).alias("nb_actes_sans_tarif"),
        F.sum(amount).cast("decimal(28,2)").alias("montant_euros"),
    )
    with_price = F.col("nb_actes") - F.col("nb_actes_sans_tarif")
    return reduced.join(named(dim_service, "categorie"), "service_code").select(
        "service_code", "service", "categorie", "nb_actes", "nb_actes_sans_tarif", "montant_euros",
        ratio(F.col("montant_euros").cast("double"), with_price).alias("montant_moyen_euros"),
    )
