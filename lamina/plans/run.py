"""From drops to published tables: ingest the pending days, rebuild silver and gold."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lamina.contract import BRONZE, DAILY_FEEDS, DIMENSIONS, REFERENCE_FILES, REFERENCES, AlertThresholds
from lamina.functions.measures import partition_month
from lamina.plans import cohort, kpi, rollup, silver, star
from lamina.sources import drops
from lamina.sources.bronze import bronze_frame, reference_frame, stamped
from lamina.sources.warehouse import LOT, Warehouse, changed_rows

# Days ingested by one write: bounds the partitions a single job opens.
DAYS_PER_BATCH = 60

FACT_MONTH = {
    "fact_sejour": "date_admission",
    "fact_diagnostic": "date_admission",
    "fact_releve": "date_mesure",
    "fact_acte": "date_acte",
}


def new_run_id() -> str:
    return uuid.uuid4().hex[:12]


def checked_day(day: str | date) -> date:
    """A real calendar day, refused before anything is written."""
    return day if isinstance(day, date) else datetime.strptime(day, "%Y-%m-%d").date()


def ledgered(warehouse: Warehouse, run_id: str, name: str, task: Callable[[], dict], day: date | None = None) -> int:
    """Run a task that returns rows per table, and put one line about it in the ledger, also when it fails."""
    begun = time.monotonic()
    line = dict(run_id=run_id, etape=name, jour=day, statut="echec", lignes=0, message="", demarre_a=datetime.now())
    try:
        line |= dict(lignes=int(sum(task().values())), statut="succes")
        return line["lignes"]
    except Exception as error:
        line["message"] = f"{type(error).__name__}: {error}"
        raise
    finally:
        warehouse.record(**line, termine_a=datetime.now(), duree_s=round(time.monotonic() - begun, 3))


def at_once(tasks: dict, workers: int = 8) -> dict:
    """Run independent writes side by side, so that small ones share the cluster."""
    with ThreadPoolExecutor(workers) as pool:
        futures = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: future.result() for name, future in futures.items()}


# ---- ingestion -------------------------------------------------------------


def pending(warehouse: Warehouse, files: DataFrame) -> list[date]:
    """Days to ingest, oldest first. The list holds days, not data."""
    waiting = drops.days_pending(drops.daily_files(files), warehouse.loaded_days(DAILY_FEEDS))
    return sorted(row.jour for row in waiting.collect())


def ingest(warehouse: Warehouse, files: DataFrame, days: list, salt: bytes, run_id: str) -> dict[str, int]:
    """Drops to lake to bronze for the given days, one write per feed and layer.

    A feed absent on a day keeps what it had. Replaying a day replaces it.
    """
    wanted = [checked_day(day) for day in days]
    listing = drops.daily_files(files).where(F.col("jour").isin(wanted)).collect()
    missing = sorted(set(wanted) - {row.jour for row in listing})
    if missing:
        raise FileNotFoundError(f"no dropped file for {', '.join(map(str, missing))}")
    loaded = dict.fromkeys(DAILY_FEEDS, 0)
    for start in range(0, len(wanted), DAYS_PER_BATCH):
        batch = set(wanted[start : start + DAYS_PER_BATCH])
        for feed, file in DAILY_FEEDS.items():
            found = [row for row in listing if row.feed == feed and row.fichier == file and row.jour in batch]
            found = [row for row in found if row.taille > 0]
            if not found:
                continue
            feed_days = sorted({row.jour for row in found})
            lake = drops.lake_frame(warehouse.spark, feed, file, [row.chemin for row in found], salt)
            warehouse.replay("lake", feed, lake, feed_days)
            typed = bronze_frame(
                feed, warehouse.read("lake", feed).where(F.col("_jour_depot").isin(feed_days)), run_id
            )
            loaded[feed] += sum(warehouse.replay("bronze", feed, typed, feed_days).values())
    return loaded


def load_references(warehouse: Warehouse, files: DataFrame, run_id: str) -> dict[str, int]:
    """Each reference from its latest drop; one never dropped keeps its table as it is."""
    references = drops.declared_files(files).where((F.col("feed") == "referentiels") & (F.col("taille") > 0))
    latest = {row.fichier: row.chemin for row in drops.latest_reference(references).collect()}
    loaded = {}
    for table, file in REFERENCE_FILES.items():
        if file in latest:
            raw = drops.read_csv(warehouse.spark, [latest[file]])
            new = reference_frame(table, raw, run_id)
            own = [c for c in new.columns if not c.startswith("_") or c == "_fichier_source"]
            if warehouse.has("bronze", table) and changed_rows(warehouse.read("bronze", table), new, own).isEmpty():
                loaded[table] = 0  # the same file as before: what follows from it stays as it is
            else:
                loaded[table] = warehouse.replace("bronze", table, new)
    return loaded


def drift_report(warehouse: Warehouse, files: DataFrame, days: list[date]) -> DataFrame:
    """What the given days (and the references) hold that is not declared, and what they lack: (fichier, colonne, ecart).

    A file nobody declared is named without a column.
    """
    wanted = F.col("jour").isin(days) | (F.col("feed") == "referentiels") if days else F.col("feed") == "referentiels"
    unknown = drops.undeclared_files(files.where(wanted)).select(
        F.concat_ws("/", "feed", F.col("jour").cast("string"), "fichier").alias("fichier"),
        F.lit(None).cast("string").alias("colonne"), F.lit("non declare").alias("ecart"))
    found: dict[tuple[str, str], list[str]] = {}
    for row in drops.daily_files(files).where(wanted & (F.col("taille") > 0)).collect():  # one row for each file
        found.setdefault((row.feed, row.fichier), []).append(row.chemin)
    parts = [drops.lake_drift(warehouse.spark, *names, paths) for names, paths in sorted(found.items())]
    return reduce(DataFrame.unionByName, parts, unknown)


# ---- silver ----------------------------------------------------------------


def bronze_tables(warehouse: Warehouse) -> dict[str, DataFrame]:
    schemas = {**BRONZE, **REFERENCES}
    return {name: warehouse.read_or_empty("bronze", name, ddl) for name, ddl in schemas.items()}


def made_from(warehouse: Warehouse, layer: str, *tables: str) -> dict[str, int]:
    """The versions a build starts from, for the tables it makes to remember."""
    return warehouse.versions(*[f"{layer}/{table}" for table in tables])


LABELS = {"sejours": ["ref_services"], "diagnostics": ["ref_cim10"], "monitoring": [], "actes": ["ref_ccam"]}
CHILDREN = ("diagnostics", "monitoring", "actes")


def deliveries(bronze: DataFrame) -> DataFrame:
    return bronze.drop("_ingested_at", "_run_id")


def judged_child(feed: str, rows: DataFrame, lookup: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    if feed == "diagnostics":
        return silver.judge_diagnostics(rows, lookup, references["ref_cim10"])
    if feed == "monitoring":
        return silver.judge_readings(rows, lookup)
    return silver.judge_acts(rows, lookup, references["ref_ccam"])


def build_silver(warehouse: Warehouse, bronze: dict[str, DataFrame], run_id: str) -> dict[str, int]:
    """All silver tables and the register, from all of bronze."""
    def built(df, moment="_built_at"):
        return stamped(df, run_id, moment)

    known = {
        feed: made_from(warehouse, "bronze", feed, *LABELS.get(feed, ())) for feed in ("patients", "sejours", *CHILDREN)
    }
    patients = silver.retained_patients(deliveries(bronze["patients"]))
    judged_stays = silver.judge_stays(silver.retained_stays(deliveries(bronze["sejours"])), bronze["ref_services"])
    counts = at_once(
        {
            "patients": lambda: warehouse.replace(
                "silver", "patients", built(silver.silver_patients(patients)), sources=known["patients"]),
            "sejours": lambda: warehouse.replace_judged(
                "sejours", built(silver.with_lot("sejours", judged_stays)), known["sejours"]),
        }
    )
    lookup = silver.stay_lookup(warehouse.judged("sejours"))
    carrier = made_from(warehouse, "silver", "sejours")

    def child(feed):
        judged = judged_child(feed, deliveries(bronze[feed]), lookup, bronze)
        return warehouse.replace_judged(feed, built(silver.with_lot(feed, judged)), known[feed] | carrier)

    counts |= at_once({feed: lambda feed=feed: child(feed) for feed in CHILDREN})
    repeated = warehouse.scratch(silver.repeated_stays(deliveries(bronze["sejours"])), "repeated-stays")
    parts = at_once({
        "patients": lambda: silver.register_of_patients(deliveries(bronze["patients"]), patients),
        "versions": lambda: silver.register_of_versions(deliveries(bronze["sejours"]), repeated),
        **{feed: lambda feed=feed: silver.register_of_feed(feed, warehouse.judged(feed)) for feed in ("sejours", *CHILDREN)},
    })
    register = reduce(DataFrame.unionByName, parts.values())
    register = built(register, "_rejected_at")
    warehouse.replace("quarantaine", "rejets", register, LOT, register_sources(warehouse))
    return counts


def register_sources(warehouse: Warehouse) -> dict[str, int]:
    return made_from(warehouse, "bronze", "patients", "sejours") | made_from(warehouse, "silver", "sejours", *CHILDREN)


# ---- gold ------------------------------------------------------------------


# What each fact is made of in silver.
FACT_SOURCE = {
    "fact_sejour": "sejours", "fact_diagnostic": "diagnostics", "fact_releve": "monitoring", "fact_acte": "actes",
}
AGED = ("fact_sejour", "fact_diagnostic")


def fact_sources(warehouse: Warehouse, name: str, limits: AlertThresholds) -> dict[str, int]:
    """The versions a fact follows from; for readings the alert limits as well."""
    tables = [FACT_SOURCE[name], *(["patients"] if name in AGED else [])]
    own = {f"limits/{k}": v for k, v in vars(limits).items()} if name == "fact_releve" else {}
    return made_from(warehouse, "silver", *tables) | own


def in_months(name: str, df: DataFrame, run_id: str) -> DataFrame:
    """A fact with its month, stamped. Each task writes a file for each month it has: no fact is shuffled for its files."""
    return stamped(df, run_id, "_built_at").withColumn("_mois", partition_month(F.col(FACT_MONTH[name])))


DIMENSION_SOURCES = {
    "dim_patient": ["silver/patients"],
    "dim_service": ["bronze/ref_services", "bronze/ref_description_service"],
    "dim_cim10": ["bronze/ref_cim10"],
    "dim_ccam": ["bronze/ref_ccam"],
}


def unmoved(warehouse: Warehouse, layer: str, table: str, known: dict) -> bool:
    """Whether a table is there and was made from just these versions."""
    now = warehouse.snapshot(layer, table)
    return now is not None and now.sources == known


def build_dimensions(warehouse: Warehouse, references: dict[str, DataFrame], run_id: str, anew: bool = True) -> dict[str, int]:
    """The dimensions; without `anew` only those whose sources have newer versions."""
    frames = {
        "dim_patient": lambda: star.dim_patient(warehouse.read("silver", "patients")),
        "dim_service": lambda: star.dim_service(references["ref_services"], references["ref_description_service"]),
        "dim_cim10": lambda: star.dim_cim10(references["ref_cim10"]),
        "dim_ccam": lambda: star.dim_ccam(references["ref_ccam"]),
    }

    def one(name):
        known = warehouse.versions(*DIMENSION_SOURCES[name])
        if not anew and unmoved(warehouse, "gold_pilotage", name, known):
            return 0
        return warehouse.replace("gold_pilotage", name, stamped(frames[name](), run_id, "_built_at"), sources=known)

    return at_once({name: lambda n=name: one(n) for name in frames})


def build_gold(
    warehouse: Warehouse, references: dict[str, DataFrame], run_id: str, limits: AlertThresholds = AlertThresholds()
) -> dict[str, int]:
    """Dimensions, facts, indicators and cohorts, from all of silver.

    Indicators are made from the facts themselves here; `build_indicators` makes the same tables from states.
    """
    counts = build_dimensions(warehouse, references, run_id)
    patients = warehouse.read("gold_pilotage", "dim_patient")
    facts = {
        "fact_sejour": lambda: star.fact_sejour(warehouse.silver("sejours"), patients),
        "fact_diagnostic": lambda: star.fact_diagnostic(warehouse.silver("diagnostics"), patients),
        "fact_releve": lambda: star.fact_releve(warehouse.silver("monitoring"), limits),
        "fact_acte": lambda: star.fact_acte(warehouse.silver("actes")),
    }

    def fact(name):
        known = fact_sources(warehouse, name, limits)
        return warehouse.replace("gold_pilotage", name, in_months(name, facts[name](), run_id), "_mois", known)

    counts |= at_once({name: lambda n=name: fact(n) for name in facts})
    gold = {name: warehouse.read("gold_pilotage", name) for name in (*DIMENSIONS, *FACT_SOURCE)}
    return counts | write_indicators(
        warehouse, run_id, indicators_of(gold), made_from(warehouse, "gold_pilotage", *DIMENSIONS, *FACT_SOURCE))


def indicators_of(gold: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The indicators and cohorts from the facts, each composed when it is called."""
    stays, diagnoses, readings, acts = (gold[name] for name in FACT_SOURCE)
    services, codes, pathologies = gold["dim_service"], gold["dim_ccam"], gold["dim_cim10"]
    return {
        "kpi_dms_service": lambda: kpi.kpi_dms_service(stays, services),
        "kpi_urgences_jour": lambda: kpi.kpi_urgences_jour(stays),
        "kpi_readmission_service": lambda: kpi.kpi_readmission_service(stays, services),
        "kpi_alertes_jour": lambda: kpi.kpi_alertes_jour(readings, services),
        "kpi_occupation_jour": lambda: kpi.kpi_occupation_jour(stays, services),
        "kpi_mortalite_service": lambda: kpi.kpi_mortalite_service(stays, services),
        "kpi_casemix_service": lambda: kpi.kpi_casemix_service(diagnoses, services, pathologies),
        "kpi_origine_service": lambda: kpi.kpi_origine_service(stays, services, gold["dim_patient"]),
        "kpi_activite_categorie": lambda: kpi.kpi_activite_categorie(stays, services),
        "kpi_actes_service": lambda: kpi.kpi_actes_service(acts, stays, services),
        "kpi_actes_type": lambda: kpi.kpi_actes_type(acts, codes),
        "kpi_densite_actes_lit": lambda: kpi.kpi_densite_actes_lit(acts, services),
        "kpi_facturation_service": lambda: kpi.kpi_facturation_service(acts, services, codes),
        "coh_prevalence": lambda: cohort.coh_prevalence(diagnoses, pathologies),
        "coh_description": lambda: cohort.coh_description(diagnoses, pathologies),
    }


def build_state(warehouse: Warehouse, fact: str) -> int:
    """The state of all months of a fact."""
    known = made_from(warehouse, "gold_pilotage", fact)
    states = rollup.rolled_up(warehouse.read("gold_pilotage", fact), rollup.STATES[fact]())
    return warehouse.replace(rollup.STATE, fact, rollup.in_parts(states), rollup.MONTH, known)


# The facts and dimensions that an indicator or cohort follows from.
INDICATOR_SOURCES = {
    "kpi_dms_service": ["fact_sejour", "dim_service"],
    "kpi_urgences_jour": ["fact_sejour"],
    "kpi_readmission_service": ["fact_sejour", "dim_service"],
    "kpi_alertes_jour": ["fact_releve", "dim_service"],
    "kpi_occupation_jour": ["fact_sejour", "dim_service"],
    "kpi_mortalite_service": ["fact_sejour", "dim_service"],
    "kpi_casemix_service": ["fact_diagnostic", "dim_service", "dim_cim10"],
    "kpi_origine_service": ["fact_sejour", "dim_service", "dim_patient"],
    "kpi_activite_categorie": ["fact_sejour", "dim_service"],
    "kpi_actes_service": ["fact_acte", "fact_sejour", "dim_service"],
    "kpi_actes_type": ["fact_acte", "dim_ccam"],
    "kpi_densite_actes_lit": ["fact_acte", "dim_service"],
    "kpi_facturation_service": ["fact_acte", "dim_service", "dim_ccam"],
    "coh_prevalence": ["fact_diagnostic", "dim_cim10"],
    "coh_description": ["fact_diagnostic", "dim_cim10"],
}


def write_indicators(
    warehouse: Warehouse, run_id: str, frames: dict[str, Callable[[], DataFrame]], newest: dict[str, int], anew: bool = True
) -> dict[str, int]:
    """Write the tables that `frames` compose; without `anew` only those that a newer version reaches."""
    def one(name):
        layer = "gold_recherche" if name.startswith("coh_") else "gold_pilotage"
        sources = (f"gold_pilotage/{source}" for source in INDICATOR_SOURCES[name])
        known = {source: newest[source] for source in sources}
        if not anew and unmoved(warehouse, layer, name, known):
            return 0
        return warehouse.replace(layer, name, stamped(frames[name](), run_id, "_built_at"), sources=known)

    return at_once({name: lambda n=name: one(n) for name in frames})


def build_indicators(warehouse: Warehouse, run_id: str, anew: bool = True) -> dict[str, int]:
    """Indicators and cohorts from the states of the facts, which must be those of the newest facts."""
    newest = made_from(warehouse, "gold_pilotage", *DIMENSIONS, *FACT_SOURCE)
    totals = rollup.Totals({fact: warehouse.read(rollup.STATE, fact) for fact in FACT_SOURCE})
    dims = {name: warehouse.read("gold_pilotage", name) for name in DIMENSIONS}
    return write_indicators(warehouse, run_id, rollup.indicators(totals, dims) | rollup.cohorts(totals, dims), newest, anew)


# ---- the run ---------------------------------------------------------------


def run(
    warehouse: Warehouse,
    source: str,
    salt: bytes,
    days: list | None = None,
    everything: bool = False,
    limits: AlertThresholds = AlertThresholds(),
    rebuild: bool = False,
) -> str:
    """Ingest (pending days by default), then bring silver and gold up to date. Returns the run id.

    Only what the changes of bronze reach is written; with `rebuild`, or where the past is not known, everything.
    """
    from lamina.plans import incremental


    run_id = new_run_id()
    chosen = None if days is None else [checked_day(day) for day in days]
    files = drops.inventory(warehouse.spark, source)
    if chosen is None:
        available = drops.days_available(drops.daily_files(files))
        chosen = sorted(row.jour for row in available.collect()) if everything else pending(warehouse, files)
    drift = drift_report(warehouse, files, chosen)
    ledgered(warehouse, run_id, "ecarts", lambda: {"ecarts": warehouse.append("ops", "ecarts", stamped(drift, run_id))})
    if chosen:
        ledgered(
            warehouse, run_id, "bronze", lambda: ingest(warehouse, files, chosen, salt, run_id),
            chosen[0] if len(chosen) == 1 else None,
        )
    ledgered(warehouse, run_id, "referentiels", lambda: load_references(warehouse, files, run_id))
    bronze = bronze_tables(warehouse)

    def silver_stage():
        made = None if rebuild else incremental.update_silver(warehouse, bronze, run_id)
        return build_silver(warehouse, bronze, run_id) if made is None else made

    def gold_stage():
        made = None if rebuild else incremental.update_gold(warehouse, bronze, run_id, limits)
        return build_gold(warehouse, bronze, run_id, limits) if made is None else made

    ledgered(warehouse, run_id, "silver", silver_stage)
    ledgered(warehouse, run_id, "gold", gold_stage)
    return run_id
