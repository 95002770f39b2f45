"""Silver tables, the reject register, and the joins behind them."""

from pyspark.sql import functions as F

from lamina.operators.versions import latest_version
from lamina.operators.windows import outside_window
from lamina.plans import silver
from registry.book import entry, shown

DAYS = ("_jour_depot",)


def register_of(source: str, motif: str = "") -> str:
    return shown("rejets", dates=DAYS, where=f"WHERE source = '{source}'" + (f" AND motif = '{motif}'" if motif else ""))


def motif(df, name):
    return df.where(F.col("motif") == name)


entry("quarantine_missing_key", register_of("patients", "patient_manquant"))(
    lambda f: silver.unidentified_patients(f.bronze_patients)
)
entry("quarantine_corrected", shown("rejets", dates=DAYS, where="WHERE action = 'corrige'"))(
    lambda f: silver.corrected_patients(f.retained_patients)
)
entry("quarantine_stay", register_of("sejours"))(
    lambda f: silver.feed_rejects("sejours", f.judged_stays).unionByName(silver.replaced_stays(f.bronze_sejours))
)


@entry("quarantine_orphan", shown("rejets", dates=DAYS, where="WHERE motif = 'sejour_inconnu'"))
def quarantine_orphan(f):
    feeds = ("diagnostics", "monitoring", "actes")
    parts = [motif(silver.feed_rejects(feed, f.judged(feed)), "sejour_inconnu") for feed in feeds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@entry("quarantine_no_patient", shown("rejets", dates=DAYS, where="WHERE motif = 'sejour_ecarte'"))
def quarantine_no_patient(f):
    feeds = ("diagnostics", "monitoring", "actes")
    parts = [motif(silver.feed_rejects(feed, f.judged(feed)), "sejour_ecarte") for feed in feeds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


entry("quarantine_out_of_range", register_of("monitoring", "capteur_hors_plage"))(
    lambda f: motif(silver.feed_rejects("monitoring", f.judged("monitoring")), "capteur_hors_plage")
)


@entry("quarantine_out_of_window", shown("rejets", dates=DAYS, where="WHERE motif LIKE '%hors_sejour'"))
def quarantine_out_of_window(f):
    readings = motif(silver.feed_rejects("monitoring", f.judged("monitoring")), "releve_hors_sejour")
    return readings.unionByName(motif(silver.feed_rejects("actes", f.judged("actes")), "acte_hors_sejour"))


STAMPS = ("admission_ts",)
entry(
    "silver_patient",
    shown("silver_patients", dates=("_jour_depot_retenu",)),
)(lambda f: f.silver("patients"))
entry("silver_stay", shown("silver_sejours", dates=DAYS, moments=("admission_ts", "discharge_ts")))(
    lambda f: f.silver("sejours")
)
entry("silver_diag", shown("silver_diagnostics", dates=DAYS, moments=STAMPS))(lambda f: f.silver("diagnostics"))
entry("silver_reading", shown("silver_monitoring", dates=DAYS, moments=("ts", "admission_ts"), decimals=("temp_c",)))(
    lambda f: f.silver("monitoring")
)
entry("silver_act", shown("silver_actes", dates=DAYS, moments=("acte_ts", "admission_ts")))(lambda f: f.silver("actes"))

entry(
    "retained_version",
    shown("retained_stays", dates=DAYS, moments=("admission_ts", "discharge_ts")),
)(lambda f: f.retained_stays)


@entry(
    "dedup_latest",
    """SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate
       FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def dedup_latest(f):
    orders = f.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return latest_version(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@entry(
    "denormalise_parent",
    """SELECT a.stay_id, code_ccam, strftime(acte_ts, '%Y-%m-%d %H:%M:%S.%f') AS acte_ts, patient_pseudo, service_code
       FROM bronze_actes AS a JOIN retained_stays AS s ON s.stay_id = a.stay_id""",
)
def denormalise_parent(f):
    joined = silver.with_stay(f.bronze_actes, f.lookup).where(F.col("sejour_coherent").isNotNull())
    return joined.select("stay_id", "code_ccam", "acte_ts", "patient_pseudo", "service_code")


@entry(
    "coherence_flag",
    """SELECT d.stay_id, d.code_cim10, CAST(s.stay_id IS NOT NULL AS INTEGER) AS sejour_coherent
       FROM bronze_diagnostics AS d LEFT JOIN silver_sejours AS s ON s.stay_id = d.stay_id""",
)
def coherence_flag(f):
    joined = silver.with_stay(f.bronze_diagnostics, f.lookup)
    return joined.select("stay_id", "code_cim10", F.coalesce("sejour_coherent", F.lit(0)).alias("sejour_coherent"))


@entry(
    "enrich_label",
    """SELECT source, service_code AS code, label, count(*) AS lignes
       FROM (SELECT 'sejours' AS source, service_code, service_label AS label FROM silver_sejours
             UNION ALL SELECT 'diagnostics', code_cim10, libelle FROM silver_diagnostics
             UNION ALL SELECT 'actes', code_ccam, libelle FROM silver_actes)
       GROUP BY ALL""",
)
def enrich_label(f):
    """Unresolved codes keep their rows under `inconnu`."""
    def labelled(feed, code, label):
        rows = f.silver(feed).groupBy(code, label).agg(F.count(F.lit(1)).alias("lignes"))
        return rows.select(F.lit(feed).alias("source"), F.col(code).alias("code"), F.col(label).alias("label"), "lignes")

    return (
        labelled("sejours", "service_code", "service_label")
        .unionByName(labelled("diagnostics", "code_cim10", "libelle"))
        .unionByName(labelled("actes", "code_ccam", "libelle"))
    )


@entry(
    "semi_join",
    """SELECT stay_id, CAST(_jour_depot AS VARCHAR) AS _jour_depot FROM bronze_sejours
       WHERE stay_id IN (SELECT stay_id FROM bronze_actes) AND (admission_ts IS NULL OR _discharge_illisible = 1)""",
)
def semi_join(f):
    unreadable = f.bronze_sejours.where(F.col("admission_ts").isNull() | (F.col("_discharge_illisible") == 1))
    return unreadable.join(f.bronze_actes, "stay_id", "left_semi").select("stay_id", "_jour_depot")


@entry(
    "window_containment",
    """SELECT CASE WHEN ts < s.admission_ts THEN 'avant' WHEN ts > s.discharge_ts THEN 'apres' ELSE 'dedans' END AS position,
              count(*) AS releves, count(DISTINCT m.stay_id) AS sejours
       FROM bronze_monitoring AS m JOIN silver_sejours AS s ON s.stay_id = m.stay_id GROUP BY ALL""",
)
def window_containment(f):
    joined = silver.with_stay(f.bronze_monitoring, f.lookup).where(F.col("sejour_coherent") == 1)
    moment, start, end = F.col("ts"), F.col("admission_ts"), F.col("_discharge_ts")
    place = (
        F.when(moment < start, "avant")
        .when(outside_window(moment, start, end), "apres")
        .otherwise("dedans")
    )
    by_stay = joined.groupBy(place.alias("position"), "stay_id").agg(F.count(F.lit(1)).alias("n"))
    return by_stay.groupBy("position").agg(F.sum("n").alias("releves"), F.count(F.lit(1)).alias("sejours"))
