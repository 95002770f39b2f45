"""Dashboard questions over the published tables, by board. None joins a fact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Tables = dict[str, DataFrame]

STEERING, ACTIVITY, RESEARCH = "pilotage", "activite", "recherche"

QUESTIONS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {}


def question(name: str, board: str):
    def keep(build):
        QUESTIONS[name] = (board, build)
        return build

    return keep


def listing(name: str, board: str, table: str, columns: list[str], *order: str) -> None:
    """A question that shows columns of one table in some order; `-column` sorts downwards."""
    def build(t):
        keys = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in order]
        return t[table].select(*columns).orderBy(*keys)

    question(name, board)(build)


def figure(name: str, board: str, table: str, label: str, value: Callable[[], Column]) -> None:
    """A question that shows one number."""
    question(name, board)(lambda t: t[table].agg(value().alias(label)))


def weighted(value: str, weight: str) -> Column:
    """Mean of a per-group mean, each group by its size."""
    return F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 2)


def rate(numerator: str, denominator: str, scale: float = 100.0) -> Column:
    """Rate of the whole: sums first, then the quotient."""
    return F.round(F.lit(scale) * F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0)), 2)


# ---- steering

figure("b01_last_build", STEERING, "kpi_dms_service", "derniere_construction", lambda: F.max("_built_at"))
figure("b02_stays", STEERING, "kpi_readmission_service", "nombre_de_sejours", lambda: F.sum("nb_sejours"))
figure("b03_length_of_stay", STEERING, "kpi_dms_service", "dms_jours", lambda: weighted("dms_jours", "nb_sejours_clos"))
figure("b04_readmission", STEERING, "kpi_readmission_service", "taux_readmission_pct", lambda: rate("nb_readmis_30j_brut", "nb_sejours"))
figure("b05_alerts", STEERING, "kpi_alertes_jour", "taux_alerte_pct", lambda: rate("nb_en_alerte", "nb_releves"))
listing("b06_los_by_service", STEERING, "kpi_dms_service", ["service", "dms_jours"], "-dms_jours")
question("b07_los_spread", STEERING)(
    lambda t: t["kpi_dms_service"].orderBy(F.col("dms_jours").desc()).select(
        "service", F.col("dms_jours").alias("moyenne_jours"), "mediane_jours", "p90_jours", "max_jours", "nb_sejours_clos"
    )
)
listing("b08_emergency_by_day", STEERING, "kpi_urgences_jour", ["jour", "nb_passages_urgences"], "jour")
listing("b09_urgent_by_day", STEERING, "kpi_urgences_jour", ["jour", "nb_admissions_en_urgence"], "jour")
listing("b10_readmission_by_service", STEERING, "kpi_readmission_service", ["service", "taux_brut_pct"], "-taux_brut_pct")
listing(
    "b11_readmission_terms", STEERING, "kpi_readmission_service",
    ["service", "nb_readmis_30j_brut", "nb_sejours", "taux_brut_pct"], "-taux_brut_pct",
)
question("b12_alerts_by_day", STEERING)(
    lambda t: t["kpi_alertes_jour"].groupBy("jour").agg(rate("nb_en_alerte", "nb_releves").alias("taux_pct")).orderBy("jour")
)
listing("b13_occupancy", STEERING, "kpi_occupation_jour", ["jour", "service", "nb_presents"], "jour")
listing(
    "b14_casemix", STEERING, "kpi_casemix_service", ["service", "pathologie", "nb_sejours", "part_pct"],
    "service", "-part_pct",
)
listing(
    "b15_origin", STEERING, "kpi_origine_service", ["service", "region_code", "nb_sejours", "nb_patients", "part_pct"],
    "service", "-part_pct",
)
listing(
    "b16_mortality", STEERING, "kpi_mortalite_service", ["service", "nb_deces", "nb_sejours_clos", "taux_pct"],
    "-taux_pct",
)

# ---- technical activity and billing

figure("b17_acts", ACTIVITY, "kpi_actes_service", "nombre_d_actes", lambda: F.sum("nb_actes"))
figure("b18_billed", ACTIVITY, "kpi_facturation_service", "montant_euros", lambda: F.sum("montant_euros"))
figure("b19_acts_per_stay", ACTIVITY, "kpi_actes_service", "actes_par_sejour", lambda: rate("nb_actes", "nb_sejours", 1.0))


@question("b20_described_services", ACTIVITY)
def described_services(t: Tables) -> DataFrame:
    everything = t["kpi_actes_service"].agg(F.count(F.lit(1))).scalar()
    text = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" / "), everything.cast("string"))
    return t["kpi_densite_actes_lit"].agg(text.alias("services_decrits"))


listing("b21_activity_by_category", ACTIVITY, "kpi_activite_categorie", ["categorie", "dms_jours", "nb_sejours"], "-nb_sejours")
listing("b22_acts_by_service", ACTIVITY, "kpi_actes_service", ["service", "nb_actes", "actes_par_sejour"], "-nb_actes")
listing(
    "b23_acts_by_type", ACTIVITY, "kpi_actes_type",
    ["acte", "nb_actes", "part_pct", "nb_sejours_concernes", "tarif_euros"], "-nb_actes",
)
listing(
    "b24_acts_per_bed", ACTIVITY, "kpi_densite_actes_lit", ["service", "actes_par_lit", "nb_actes", "capacite_lits"],
    "-actes_par_lit",
)
listing(
    "b25_billing_by_service", ACTIVITY, "kpi_facturation_service",
    ["service", "montant_euros", "nb_actes", "montant_moyen_euros", "nb_actes_sans_tarif"], "-montant_euros",
)

# ---- research

figure("b26_pathologies", RESEARCH, "coh_prevalence", "nombre_de_pathologies", lambda: F.count(F.lit(1)))
figure("b27_headcount", RESEARCH, "coh_description", "effectif_total", lambda: F.sum("nb_patients"))
listing("b28_prevalence", RESEARCH, "coh_prevalence", ["pathologie", "nb_patients"], "-nb_patients")
listing(
    "b29_prevalence_terms", RESEARCH, "coh_prevalence",
    ["pathologie", "nb_patients", "nb_patients_principal", "nb_sejours"], "-nb_patients",
)


@question("b30_age_pyramid", RESEARCH)
def age_pyramid(t: Tables) -> DataFrame:
    """Women to the right, men to the left of zero."""
    def side(sex):
        return F.coalesce(F.sum(F.when(F.col("sexe") == sex, F.col("nb_patients"))), F.lit(0))

    bands = t["coh_description"].groupBy("tranche_age")
    return bands.agg(side("F").alias("femmes"), (-side("M")).alias("hommes")).orderBy("tranche_age")


listing(
    "b31_cells", RESEARCH, "coh_description", ["pathologie", "tranche_age", "sexe", "nb_patients"],
    "pathologie", "tranche_age", "sexe",
)


def answer(name: str, tables: Tables) -> DataFrame:
    return QUESTIONS[name][1](tables)
