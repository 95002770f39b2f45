"""Silver and gold brought up to date from what has changed, not from everything.

Every table remembers the versions it was made from. An update compares those
with the newest ones, folder by folder, and follows what really differs:

    days of deliveries      -> stays whose deliveries differ        -> months of the stay table
    stays that differ,
    days of child rows      -> child rows judged anew                -> months of the child tables
    months of judged tables -> the register's rejects of those months
    months of judged tables -> months of facts -> states of those months -> the indicators that follow from them
    stays that differ       -> stays of the same patient whose readmission they may answer -> months of the stay fact
    patients that differ    -> months of the facts that carry their age or sex

Only the months that come out are written; the folders of all others stay. Each
step compares with what its own table was made from, so an update that ended
between two tables is taken up by the next one. Where the past is not known any
more (a first build, a swept version, other labels or limits) a step says so by
None, and the caller builds in full.

The result equals a full build, but for the stamps of rows that were not made anew.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from lamina.contract import KEPT, READMISSION_DAYS, AlertThresholds
from lamina.operators.windows import starts_told, time_slot
from lamina.plans import rollup, run, silver, star
from lamina.sources.bronze import stamped
from lamina.sources.warehouse import LOT, Snapshot, Warehouse, changed_rows


class Past:
    """What a table was made from, and what has become of it."""

    def __init__(self, warehouse: Warehouse, layer: str, table: str):
        self.warehouse, self.table = warehouse, table
        self.now: Snapshot | None = warehouse.snapshot(layer, table)
        self.sources = self.now.sources if self.now else {}

    def known(self, *names: str) -> bool:
        """Whether the versions of these sources are still there to compare with, or the sources are as they were."""
        return bool(self.now) and all(
            name in self.sources and (
                not self.moved(name) or self.warehouse.snapshot(*name.split("/"), self.sources[name]) is not None)
            for name in names)

    def changes(self, name: str) -> tuple[DataFrame, DataFrame]:
        return self.warehouse.changes(*name.split("/"), self.sources[name])

    def values(self, name: str) -> list[str]:
        """Days or months whose folders are others now."""
        return self.warehouse.changed_values(*name.split("/"), self.sources[name]) if self.moved(name) else []

    def moved(self, name: str) -> bool:
        return self.warehouse.version(*name.split("/")) != self.sources.get(name)

    def differs(self, name: str, columns: list[str]) -> bool:
        return self.moved(name) and not changed_rows(*self.changes(name), columns).isEmpty()


def same_labels(past: Past, feed: str, references: dict[str, DataFrame]) -> bool:
    return not any(
        past.differs(f"bronze/{name}", run.deliveries(references[name]).drop("_fichier_source").columns)
        for name in run.LABELS[feed])


def listed(df: DataFrame, column: str) -> list[str]:
    """The different values of a column of months or slots: as many as the calendar has."""
    return sorted(row[0] for row in df.select(column).distinct().collect())


def among(df: DataFrame, keys: DataFrame, name: str, kind: str = "left_semi") -> DataFrame:
    """Rows whose key is (or is not) listed; NULL is a key like others."""
    return df.alias("a").join(keys.alias("b"), F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")), kind)


# ---- silver ----------------------------------------------------------------


def update_patients(warehouse: Warehouse, bronze: dict[str, DataFrame], run_id: str) -> int | None:
    """The patient table has no months: it is made anew if any delivery differs, else left as it is."""
    past = Past(warehouse, "silver", "patients")
    if not past.known("bronze/patients"):
        return None
    columns = run.deliveries(bronze["patients"]).columns
    known = run.made_from(warehouse, "bronze", "patients")
    if not past.differs("bronze/patients", columns):
        warehouse.restate("silver", "patients", known)
        return 0
    retained = silver.retained_patients(run.deliveries(bronze["patients"]))
    return warehouse.replace(
        "silver", "patients", stamped(silver.silver_patients(retained), run_id, "_built_at"), sources=known)


def changed_stays(past: Past, columns: list[str]) -> DataFrame:
    """Ids of the stays whose deliveries differ."""
    rows = changed_rows(*past.changes("bronze/sejours"), columns)
    return past.warehouse.scratch(rows.select("stay_id").distinct(), "changed-stays")


def renew_lots(warehouse: Warehouse, table: str, fresh: DataFrame, stale: DataFrame, keep, sources: dict) -> int:
    """Write the months that fresh rows go to or stale rows leave: fresh rows, and the old ones that `keep` keeps."""
    lots = sorted(set(listed(fresh, LOT)) | set(listed(stale, LOT)))
    old = warehouse.judged(table, lots=True)
    body = keep(old.where(F.col(LOT).isin(lots))).select(*old.columns).unionByName(fresh)
    body = body.hint("rebalance", LOT).sortWithinPartitions(LOT, "_motif")
    return warehouse.renew("silver", table, body, LOT, lots, sources)


def update_stays(warehouse: Warehouse, bronze: dict[str, DataFrame], run_id: str) -> int | None:
    past = Past(warehouse, "silver", "sejours")
    if not past.known("bronze/sejours", "bronze/ref_services") or not same_labels(past, "sejours", bronze):
        return None
    known = run.made_from(warehouse, "bronze", "sejours", *run.LABELS["sejours"])
    if not past.moved("bronze/sejours"):
        warehouse.restate("silver", "sejours", known)
        return 0
    delivered = run.deliveries(bronze["sejours"])
    changed = changed_stays(past, delivered.columns)
    judged = silver.judge_stays(silver.retained_stays(among(delivered, changed, "stay_id")), bronze["ref_services"])
    fresh = warehouse.scratch(stamped(silver.with_lot("sejours", judged), run_id, "_built_at"), "fresh-stays")
    stale = among(warehouse.judged("sejours", lots=True), changed, "stay_id")
    return renew_lots(
        warehouse, "sejours", fresh, stale, lambda old: among(old, changed, "stay_id", kind="left_anti"), known)


def changed_carriers(past: Past) -> DataFrame:
    """Ids of the stays that differ in what a child row takes from its stay."""
    if not past.moved("silver/sejours"):
        return past.warehouse.spark.createDataFrame([], "stay_id string")
    gone, come = (silver.stay_lookup(df) for df in past.changes("silver/sejours"))
    return past.warehouse.scratch(changed_rows(gone, come, gone.columns).select("stay_id").distinct(), "changed-carriers")


def update_child(warehouse: Warehouse, feed: str, bronze: dict[str, DataFrame], run_id: str) -> int | None:
    """Judge anew the rows of changed days and those of stays that differ in what a child row takes from its stay."""
    past = Past(warehouse, "silver", feed)
    names = [f"bronze/{feed}", "silver/sejours", *(f"bronze/{name}" for name in run.LABELS[feed])]
    if not past.known(*names) or not same_labels(past, feed, bronze):
        return None
    known = run.made_from(warehouse, "bronze", feed, *run.LABELS[feed]) | run.made_from(warehouse, "silver", "sejours")
    delivered = warehouse.snapshot("bronze", feed)
    if past.moved(f"bronze/{feed}") and delivered.column != "_jour_depot":
        return None  # deliveries that are not kept by day cannot be told apart
    days = past.values(f"bronze/{feed}")
    stays = changed_carriers(past)
    if not days and stays.isEmpty():
        warehouse.restate("silver", feed, known)
        return 0
    in_days = F.coalesce(F.col("_jour_depot").cast("string").isin(days), F.lit(False))

    def touched(df):
        # An orphan row may belong to a stay that has come; other rows of NULL stays never do.
        return df.where(in_days).unionByName(df.where(~in_days).join(stays, "stay_id", "left_semi"))

    lookup = silver.stay_lookup(warehouse.judged("sejours"))
    judged = run.judged_child(feed, touched(run.deliveries(bronze[feed])), lookup, bronze)
    fresh = warehouse.scratch(stamped(silver.with_lot(feed, judged), run_id, "_built_at"), f"fresh-{feed}")
    stale = touched(warehouse.judged(feed, lots=True).select("stay_id", "_jour_depot", LOT))
    return renew_lots(
        warehouse, feed, fresh, stale, lambda old: old.where(~in_days).join(stays, "stay_id", "left_anti"), known)


def update_register(warehouse: Warehouse, bronze: dict[str, DataFrame], run_id: str) -> int | None:
    """Rejects of the months that changed, replaced versions of the stays that did, corrections if patients did."""
    past = Past(warehouse, "quarantaine", "rejets")
    feeds = ("sejours", *run.CHILDREN)
    if not past.known("bronze/patients", "bronze/sejours", *(f"silver/{feed}" for feed in feeds)):
        return None
    known, lots, parts = run.register_sources(warehouse), [], []
    for feed in feeds:
        months = past.values(f"silver/{feed}")
        if months:
            judged = warehouse.judged(feed, lots=True).where(F.col(LOT).isin(months)).drop(LOT)
            parts.append(silver.register_of_feed(feed, judged))
            lots += silver.register_lot(feed, months)
    delivered = run.deliveries(bronze["sejours"])
    if past.moved("bronze/sejours"):
        changed = changed_stays(past, delivered.columns)
        fresh = warehouse.scratch(silver.register_of_versions(among(delivered, changed, "stay_id")), "fresh-versions")
        old = warehouse.read("quarantaine", "rejets", lots=True).where(F.col(LOT).startswith(f"{silver.VERSION_LOT}-"))
        named = changed.withColumnRenamed("stay_id", "cle")
        months = sorted(set(listed(fresh, LOT)) | set(listed(among(old, named, "cle"), LOT)))
        rest = among(old.where(F.col(LOT).isin(months)), named, "cle", kind="left_anti")
        parts += [fresh, rest]
        lots += months
    if past.differs("bronze/patients", run.deliveries(bronze["patients"]).columns):
        people = run.deliveries(bronze["patients"])
        parts.append(silver.register_of_patients(people, silver.retained_patients(people)))
        lots.append(silver.PATIENT_LOT)
    if not lots:
        warehouse.restate("quarantaine", "rejets", known)
        return 0
    columns = [c for c in past.now.schema.names if c not in ("_rejected_at", "_run_id")]
    stamps = {"_rejected_at": F.current_timestamp(), "_run_id": F.lit(run_id)}
    rows = None
    for part in parts:
        part = part.select(
            *columns, *[(F.col(c) if c in part.columns else value).alias(c) for c, value in stamps.items()])
        rows = part if rows is None else rows.unionByName(part)
    return warehouse.renew("quarantaine", "rejets", rows.hint("rebalance", LOT), LOT, lots, known)


def update_silver(warehouse: Warehouse, bronze: dict[str, DataFrame], run_id: str) -> dict[str, int] | None:
    """Rows written per table; None if any table needs a full build."""
    counts: dict[str, int] = {}
    if not all(warehouse.has("silver", feed) for feed in ("patients", "sejours", *run.CHILDREN)):
        return None
    steps = {
        "patients": lambda: update_patients(warehouse, bronze, run_id),
        "sejours": lambda: update_stays(warehouse, bronze, run_id),
        **{feed: lambda feed=feed: update_child(warehouse, feed, bronze, run_id) for feed in run.CHILDREN},
        "rejets": lambda: update_register(warehouse, bronze, run_id),
    }
    for name, task in steps.items():
        made = task()
        if made is None:
            return None
        counts[name] = made
    return counts


# ---- gold ------------------------------------------------------------------


def months_of_slots(slots: list[int], days: int) -> list[str]:
    """Months that share a day with some slots, and the lot of rows without a moment."""
    out = set()
    for slot in slots:
        first = date(1970, 1, 1) + timedelta(days=slot * days)
        for step in range(days + 1):
            out.add(f"{first + timedelta(days=step):%Y%m}")
    return sorted(out)


def kept_stays(df: DataFrame) -> DataFrame:
    return df.where(F.col("_motif") == KEPT).select("stay_id", "patient_pseudo", "admission_ts")


def readmission_months(warehouse: Warehouse, past: Past, days: int = READMISSION_DAYS) -> list[str]:
    """Months of the stays whose answer a changed admission may change: same patient, its slot or the one before."""
    gone, come = past.changes("silver/sejours")
    changed = changed_rows(kept_stays(gone), kept_stays(come), ["stay_id", "patient_pseudo", "admission_ts"])
    told = starts_told(changed, "patient_pseudo", "admission_ts", days)
    stays = warehouse.silver("sejours", lots=True).where(F.col("discharge_ts").isNotNull())
    asked = stays.select("patient_pseudo", time_slot(F.col("discharge_ts"), days).alias("_slot"), LOT)
    return listed(asked.join(told, ["patient_pseudo", "_slot"], "left_semi"), LOT)


def admissions_for(warehouse: Warehouse, stays: DataFrame, days: int = READMISSION_DAYS) -> tuple[DataFrame, list[int]]:
    """The admissions that can answer the discharges of some stays, read from their months alone, and the slots asked."""
    ended = stays.where(F.col("discharge_ts").isNotNull())
    slots = sorted({s for row in listed(ended.select(time_slot(F.col("discharge_ts"), days).alias("s")), "s")
                    for s in (row, row + 1)})
    months = months_of_slots(slots, days)
    return warehouse.silver("sejours", lots=True).where(F.col(LOT).isin(months)).drop(LOT), slots


def months_of_patients(warehouse: Warehouse, past: Past, feed: str) -> list[str]:
    """Months of a feed that hold patients whose year of birth or sex differs."""
    if not past.moved("silver/patients"):
        return []
    differ = changed_rows(*past.changes("silver/patients"), ["patient_pseudo", "birth_year", "sex"])
    people = differ.select("patient_pseudo").distinct()
    return listed(warehouse.silver(feed, lots=True).join(people, "patient_pseudo", "left_semi"), LOT)


def update_fact(warehouse: Warehouse, name: str, run_id: str, limits: AlertThresholds) -> int | None:
    past, feed = Past(warehouse, "gold_pilotage", name), run.FACT_SOURCE[name]
    known = run.fact_sources(warehouse, name, limits)
    tables = [source for source in known if source.startswith("silver/")]
    if not past.known(*tables) or any(past.sources.get(k) != v for k, v in known.items() if k not in tables):
        return None
    months = set(past.values(f"silver/{feed}"))
    if name in run.AGED:
        months |= set(months_of_patients(warehouse, past, feed))
    if name == "fact_sejour" and past.moved("silver/sejours"):
        months |= set(readmission_months(warehouse, past))
    months = sorted(months)
    if not months:
        warehouse.restate("gold_pilotage", name, known)
        return 0
    rows = warehouse.silver(feed, lots=True).where(F.col(LOT).isin(months)).drop(LOT)
    patients = star.dim_patient(warehouse.read("silver", "patients"))
    if name == "fact_sejour":
        fact = star.fact_sejour(rows, patients, admissions_for(warehouse, rows)[0])
    elif name == "fact_diagnostic":
        fact = star.fact_diagnostic(rows, patients)
    else:
        fact = star.fact_releve(rows, limits) if name == "fact_releve" else star.fact_acte(rows)
    fact = run.in_months(name, fact, run_id)
    if name in run.AGED:  # a join has dealt the rows out anew: the hint sizes files per month at run time
        fact = fact.hint("rebalance", "_mois")
    return warehouse.renew("gold_pilotage", name, fact, "_mois", months, known)


def update_state(warehouse: Warehouse, fact: str) -> int | None:
    """The states of the months that a fact has in other folders now."""
    source, past = f"gold_pilotage/{fact}", Past(warehouse, rollup.STATE, fact)
    if not past.known(source):
        return None
    known, months = run.made_from(warehouse, "gold_pilotage", fact), past.values(source)
    rows = warehouse.read("gold_pilotage", fact).where(F.col(rollup.MONTH).isin(months))
    states = rollup.in_parts(rollup.rolled_up(rows, rollup.STATES[fact]()))
    return warehouse.renew(rollup.STATE, fact, states, rollup.MONTH, months, known)


def update_gold(
    warehouse: Warehouse, references: dict[str, DataFrame], run_id: str, limits: AlertThresholds = AlertThresholds()
) -> dict[str, int] | None:
    """Facts and their states by the months that changed; of dimensions and indicators those that follow from
    something newer, as a whole: they are added up from states. None: build in full."""
    if not all(warehouse.has("gold_pilotage", name) for name in run.FACT_SOURCE):
        return None
    counts = run.build_dimensions(warehouse, references, run_id, anew=False)
    for name in run.FACT_SOURCE:
        made = update_fact(warehouse, name, run_id, limits)
        if made is None:
            return None
        counts[name] = made
        if update_state(warehouse, name) is None:
            run.build_state(warehouse, name)
    return counts | run.build_indicators(warehouse, run_id, anew=False)
