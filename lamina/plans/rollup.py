"""States of the indicators: each fact read once, its numbers kept by month, added up when asked.

A state table holds, month by month, what a fact adds up to under several
groupings at once; `vue` names the grouping a row belongs to. All thirteen
indicators and both cohorts follow from the states by adding months up:

* sums and counts add;
* distinct persons are memberships (group, person, number of rows): a person is
  counted once however many months hold them, and vanishes with their last row;
* lengths of stay are histograms (key, minutes, number), merged before the exact
  median and P90 are read off;
* presence is a running sum over arrivals and departures per service and day.

A month that is replaced takes its old numbers with it, so a changed fact is
followed by rewriting the states of its changed months alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lamina.contract import UNKNOWN
from lamina.functions.measures import MINUTES_PER_DAY, month_start
from lamina.operators.windows import presence_from_moves
from lamina.plans import cohort, kpi

STATE = "etat"
MONTH, VIEW = "_mois", "vue"


@dataclass(frozen=True)
class State:
    """How a fact is rolled up: its row-local columns, its groupings, what is counted."""

    columns: dict[str, Column]
    views: dict[str, list[str]]
    measures: dict[str, Column]

    def keys(self) -> list[str]:
        return list(dict.fromkeys(key for view in self.views.values() for key in view))


def stay_state() -> State:
    arrived = F.col("date_admission").isNotNull()
    return State(
        {
            "jour": F.col("date_admission"),
            "mois": month_start(F.col("date_admission")),
            "sortie": F.when(arrived, F.col("date_sortie")),
            "minutes": F.round(F.col("duree_jours") * MINUTES_PER_DAY).cast("bigint"),
        },
        {
            "jours": ["jour"],
            "services": ["service_code"],
            "durees": ["service_code", "mois", "est_en_cours", "minutes"],
            "arrivees": ["service_code", "jour"],
            "departs": ["service_code", "sortie"],
            "patients": ["service_code", "patient_pseudo"],
        },
        kpi.stay_sums(),
    )


def diagnosis_state() -> State:
    principal = F.col("est_principal") == 1
    known = principal & (F.col("tranche_age") != UNKNOWN)
    return State(
        {},
        {
            "services": ["service_code", "code_cim10"],
            "patients": ["code_cim10", "patient_pseudo"],
            "cellules": [*cohort.CELLS, "patient_pseudo"],
        },
        {"nb_lignes": kpi.rows(), "nb_principaux": F.count_if(principal), "nb_connus": F.count_if(known)},
    )


def reading_state() -> State:
    return State(
        {"jour": F.col("date_mesure")},
        {"services": ["jour", "service_code"]},
        {"nb_releves": kpi.rows(), "nb_en_alerte": F.count_if(F.col("en_alerte") == 1)},
    )


def act_state() -> State:
    return State(
        {},
        {
            "services": ["service_code", "code_ccam"],
            "sejours": ["service_code", "stay_id"],
            "codes": ["code_ccam", "stay_id"],
        },
        {"nb_lignes": kpi.rows()},
    )


STATES = {"fact_sejour": stay_state, "fact_diagnostic": diagnosis_state, "fact_releve": reading_state, "fact_acte": act_state}


def rolled_up(fact: DataFrame, state: State) -> DataFrame:
    """The state of some months of a fact: one scan, all groupings by month."""
    keys, names = state.keys(), list(state.views)
    shown = fact.withColumns(state.columns)
    sets = [[MONTH, *state.views[name]] for name in names]
    # A grouping is told by which keys it leaves out; MONTH is in all of them.
    bits = {name: sum(1 << (len(keys) - 1 - k) for k, key in enumerate(keys) if key not in state.views[name]) for name in names}
    which = F.grouping_id()
    view = None
    for name in names:
        view = F.when(which == bits[name], F.lit(name)) if view is None else view.when(which == bits[name], F.lit(name))
    sums = [column.alias(name) for name, column in state.measures.items()]
    return shown.groupingSets(sets, MONTH, *keys).agg(view.alias(VIEW), *sums)


def in_parts(states: DataFrame) -> DataFrame:
    """Ready to be written by month, the rows of a view side by side."""
    return states.hint("rebalance", MONTH).sortWithinPartitions(MONTH, VIEW)


class Totals:
    """The states of all months, by fact and view."""

    def __init__(self, states: dict[str, DataFrame]):
        self.states = states

    def view(self, fact: str, name: str) -> DataFrame:
        state = STATES[fact]()
        return self.states[fact].where(F.col(VIEW) == name).select(*state.views[name], *state.measures)

    def members(self, fact: str, name: str, **measures: Column) -> DataFrame:
        """One row per group and member, whatever the number of months it has rows in."""
        sums = [column.alias(into) for into, column in measures.items()]
        return self.view(fact, name).groupBy(*STATES[fact]().views[name]).agg(*sums)


def indicators(totals: Totals, dims: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The thirteen indicator tables from the states, each composed when it is called."""
    services, codes = dims["dim_service"], dims["dim_ccam"]

    def stays(name):
        return totals.view("fact_sejour", name)

    def durations():
        return stays("durees").withColumnRenamed("nb_sejours", "n")

    def lines(name):
        return totals.members("fact_acte", name, nb_lignes=F.sum("nb_lignes"))

    def acts():
        return totals.members("fact_acte", "services", n=F.sum("nb_lignes"))

    def present():
        none = F.lit(0).cast("bigint")
        came = stays("arrivees").select("service_code", "jour", F.col("nb_sejours").alias("arrives"), none.alias("partis"))
        left = stays("departs").select(
            "service_code", F.col("sortie").alias("jour"), none.alias("arrives"), F.col("nb_sejours").alias("partis"))
        moves = came.unionByName(left).where(F.col("jour").isNotNull())
        return presence_from_moves(moves, "service_code", stays("jours").agg(F.max("jour")).scalar())

    def visits():
        return totals.members("fact_sejour", "patients", nb_lignes=F.sum("nb_sejours"))

    return {
        "kpi_dms_service": lambda: kpi.dms_from(durations(), services),
        "kpi_urgences_jour": lambda: kpi.urgences_from(stays("jours")),
        "kpi_readmission_service": lambda: kpi.readmission_from(stays("services"), services),
        "kpi_alertes_jour": lambda: kpi.alertes_from(totals.view("fact_releve", "services"), services),
        "kpi_occupation_jour": lambda: kpi.occupation_from(present(), services),
        "kpi_mortalite_service": lambda: kpi.mortalite_from(stays("services"), services),
        "kpi_casemix_service": lambda: kpi.casemix_from(
            totals.view("fact_diagnostic", "services"), services, dims["dim_cim10"]),
        "kpi_origine_service": lambda: kpi.origine_from(visits(), services, dims["dim_patient"]),
        "kpi_activite_categorie": lambda: kpi.categories_from(durations(), services),
        "kpi_actes_service": lambda: kpi.actes_from(lines("sejours"), stays("services"), services),
        "kpi_actes_type": lambda: kpi.types_from(lines("codes"), codes),
        "kpi_densite_actes_lit": lambda: kpi.densite_from(acts(), services),
        "kpi_facturation_service": lambda: kpi.facturation_from(acts(), services, codes),
    }


def cohorts(totals: Totals, dims: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """Both cohort tables from the states, each composed when it is called."""
    def persons():
        return totals.members(
            "fact_diagnostic", "patients", nb_lignes=F.sum("nb_lignes"),
            principal=(F.sum("nb_principaux") > 0).cast("int"))

    def cells():
        known = totals.members("fact_diagnostic", "cellules", nb_connus=F.sum("nb_connus"))
        return known.where(F.col("nb_connus") > 0)

    return {
        "coh_prevalence": lambda: cohort.prevalence_from(persons(), dims["dim_cim10"]),
        "coh_description": lambda: cohort.description_from(cells(), dims["dim_cim10"]),
    }
