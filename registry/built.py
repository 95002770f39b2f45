"""A warehouse built from the driver's tables, written once per session and folder.

Checks, dashboards and audits read tables a run has written, as they would in
production; the first entry that asks pays for the run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from lamina.contract import DIMENSIONS, KPI_TABLES, REFERENCES
from lamina.plans.run import bronze_tables, build_gold, build_silver, ledgered, new_run_id
from lamina.session import new_folder
from lamina.sources.bronze import stamped
from lamina.sources.warehouse import Warehouse
from registry.feeds import Feeds

COHORTS = ("coh_prevalence", "coh_description")
FACTS = ("fact_sejour", "fact_diagnostic", "fact_releve", "fact_acte")

_built: dict[tuple[str, str], Warehouse] = {}


def build(f: Feeds) -> Warehouse:
    warehouse, run_id = Warehouse(f.spark, new_folder(f.spark, "warehouse")), new_run_id()
    for name, df in f.bronze.items():
        if name in REFERENCES:
            df = df.withColumn("_fichier_source", F.concat(F.lit("lake/referentiels/"), F.lit(name)))
        warehouse.replace("bronze", name, stamped(df, run_id))
    ledgered(warehouse, run_id, "silver", lambda: build_silver(warehouse, bronze_tables(warehouse), run_id))
    ledgered(warehouse, run_id, "gold", lambda: build_gold(warehouse, bronze_tables(warehouse), run_id))
    return warehouse


def warehouse(f: Feeds) -> Warehouse:
    key = (f.spark.sparkContext.applicationId, f.folder)
    if key not in _built:
        _built[key] = build(f)
    return _built[key]


class Published(Mapping):
    """Tables of one warehouse by name, each opened when first asked for."""

    def __init__(self, home: Warehouse, layers: dict[str, str]):
        self.home, self.layers, self.frames = home, layers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = self.home.read(self.layers[name], name)
        return self.frames[name]

    def __iter__(self):
        return iter(self.layers)

    def __len__(self):
        return len(self.layers)


def gold(f: Feeds) -> Published:
    return Published(warehouse(f), dict.fromkeys((*DIMENSIONS, *FACTS), "gold_pilotage"))


def kpis(f: Feeds) -> Published:
    return Published(warehouse(f), dict.fromkeys(KPI_TABLES, "gold_pilotage"))


def cohorts(f: Feeds) -> Published:
    return Published(warehouse(f), dict.fromkeys(COHORTS, "gold_recherche"))


def published(f: Feeds) -> Published:
    layers = dict.fromkeys(KPI_TABLES, "gold_pilotage") | dict.fromkeys(COHORTS, "gold_recherche")
    return Published(warehouse(f), layers)


def silver(f: Feeds) -> dict[str, DataFrame]:
    w = warehouse(f)
    feeds = ("sejours", "diagnostics", "monitoring", "actes")
    return {"patients": w.read("silver", "patients"), **{feed: w.silver(feed) for feed in feeds}}


def register(f: Feeds) -> DataFrame:
    return warehouse(f).read("quarantaine", "rejets")
