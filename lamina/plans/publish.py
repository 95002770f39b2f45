"""What leaves the warehouse: audience views, lineage of a figure, state of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.contract import AUDIENCES, DAILY_FEEDS, REFERENCES, STEERING_FORBIDDEN
from lamina.plans.quality import identity_inside, stacked, table_texts
from lamina.sources import drops
from lamina.sources.warehouse import Warehouse, latest_lines

LAYERS = {
    "bronze": (*DAILY_FEEDS, *REFERENCES),
    "silver": ("patients", "sejours", "diagnostics", "monitoring", "actes"),
    "quarantaine": ("rejets",),
    "ops": ("executions", "ecarts"),
}
HOME = {"coh_prevalence": "gold_recherche", "coh_description": "gold_recherche"}


def allowed(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df if columns is None else df.select(*columns)


def audience_tables(warehouse: Warehouse, audience: str, policy: dict = AUDIENCES) -> dict[str, DataFrame]:
    """The tables an audience may read, each cut to its columns. Anything undeclared is absent.

    A layer granted as a whole gives all its tables, named `<layer>_<table>`.
    """
    out = {}
    for name, columns in policy[audience].items():
        if name in LAYERS:
            for table in LAYERS[name]:
                if warehouse.has(name, table):
                    judged = name == "silver" and table != "patients"
                    whole = warehouse.silver(table) if judged else warehouse.read(name, table)
                    out[f"{name}_{table}"] = allowed(whole, columns)
        else:
            out[name] = allowed(warehouse.read(HOME.get(name, "gold_pilotage"), name), columns)
    return out


def publish_audience(warehouse: Warehouse, audience: str, target: str, policy: dict = AUDIENCES) -> dict[str, int]:
    """Write an audience's own copy of its tables: columns it may not see are not in the files."""
    counts = {}
    for table, df in audience_tables(warehouse, audience, policy).items():
        counts[table] = Warehouse(warehouse.spark, target).replace(audience, table, df)
    return counts


def audit_audience(tables: dict[str, DataFrame], forbidden: list[str] = STEERING_FORBIDDEN) -> list[tuple[str, str]]:
    return [(name, c) for name, df in tables.items() for c in df.columns if c in forbidden]


def ledger_texts(warehouse: Warehouse) -> DataFrame:
    """The messages of the run ledger, as texts to be scanned."""
    lines = warehouse.read("ops", "executions").where(F.col("message") != "")
    return lines.select(
        F.lit("ops.executions").alias("origine"), F.concat_ws("/", "run_id", "etape").alias("ligne"),
        F.col("message").alias("texte"))


def lake_identity(warehouse: Warehouse, identifiers: DataFrame) -> DataFrame:
    """Source identifiers that stand anywhere in the lake, in any text column: by table, column and file."""
    feeds = [feed for feed in DAILY_FEEDS if warehouse.has("lake", feed)]
    tables = {feed: flat_texts(warehouse.read("lake", feed)) for feed in feeds}
    return identity_inside(table_texts(tables), identifiers)


def flat_texts(df: DataFrame) -> DataFrame:
    """A table whose nested columns are read as text, so that what stands inside them is seen."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    return df.withColumns({name: F.to_json(name) for name in nested}) if nested else df


def lineage_walk(layers: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """From a figure back to its files: per layer the rows behind it, by run and source file.

    Each layer comes with the condition that picks its part of the figure.
    """
    def column(df, *names):
        found = next((n for n in names if n in df.columns), None)
        return F.col(found) if found else F.lit(None).cast("string")

    return stacked(
        [
            df.where(condition)
            .groupBy(
                column(df, "_fichier_source", "_fichier_source_retenu").alias("fichier_source"),
                column(df, "_run_id").alias("run_id"),
            )
            .agg(F.count(F.lit(1)).alias("lignes"))
            .select(F.lit(layer).alias("couche"), "fichier_source", "run_id", "lignes")
            for layer, (df, condition) in layers.items()
        ]
    )


def lineage_counts(bronze: DataFrame) -> DataFrame:
    """Rows per drop day and run, with the first ingestion time."""
    return bronze.groupBy("_jour_depot", "_run_id").agg(
        F.min("_ingested_at").alias("charge_a"), F.count(F.lit(1)).alias("lignes")
    )


STATE_TABLES = [
    ("bronze", "sejours"), ("silver", "sejours"), ("quarantaine", "rejets"), ("gold_pilotage", "fact_sejour"), ("gold_recherche", "coh_prevalence"),
]


def table_volumes(warehouse: Warehouse, tables: list[tuple[str, str]] = STATE_TABLES) -> DataFrame:
    """Row counts, from Parquet footers."""
    def rows(layer, table):
        return warehouse.silver(table) if layer == "silver" and table != "patients" else warehouse.read(layer, table)

    counts = [
        rows(layer, table).agg(F.count(F.lit(1)).alias("lignes")).select(F.lit(f"{layer}.{table}").alias("table"), "lignes")
        for layer, table in tables
        if warehouse.has(layer, table)
    ]
    return stacked(counts) if counts else warehouse.spark.createDataFrame([], "table string, lignes bigint")


def days_state(warehouse: Warehouse, files: DataFrame) -> DataFrame:
    """Each drop day: ingested, or waiting."""
    daily = drops.daily_files(files)
    waiting = drops.days_pending(daily, warehouse.loaded_days(DAILY_FEEDS)).withColumn("_waiting", F.lit(1))
    state = F.when(F.col("_waiting").isNull(), "ingéré").otherwise("en attente")
    return drops.days_available(daily).join(waiting, "jour", "left").select("jour", state.alias("etat"))


def state_report(warehouse: Warehouse, steps: int = 5, files: DataFrame | None = None) -> DataFrame:
    """Volumes, the latest ledger lines with their durations, and the days of the drops if their list is given.

    One list of (section, cle, valeur).
    """
    volumes = table_volumes(warehouse).select(
        F.lit("volumes").alias("section"), F.col("table").alias("cle"), F.col("lignes").cast("string").alias("valeur")
    )
    ledger = latest_lines(warehouse.read("ops", "executions"), steps)
    name = F.concat_ws(" ", "run_id", "etape").alias("cle")
    lines = ledger.select(
        F.lit("étapes").alias("section"), name, F.concat_ws(" ", "statut", F.col("lignes").cast("string")).alias("valeur"))
    times = ledger.select(
        F.lit("durées").alias("section"), name,
        F.concat_ws(" ", F.col("demarre_a").cast("string"), F.col("duree_s").cast("string")).alias("valeur"))
    report = volumes.unionByName(lines).unionByName(times)
    if files is None:
        return report
    days = days_state(warehouse, files).select(
        F.lit("jours").alias("section"), F.col("jour").cast("string").alias("cle"), F.col("etat").alias("valeur"))
    return report.unionByName(days)
