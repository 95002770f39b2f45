"""Files: scans, whitelists, provenance, calendars, replay, ledger."""

from pyspark.sql import functions as F

from lamina.contract import BRONZE, DIAGNOSTICS_JSON, DIMENSIONS, KPI_TABLES, LEDGER, REFERENCES
from lamina.functions.privacy import pseudonymise
from lamina.plans import publish, quality
from lamina.session import new_folder
from lamina.sources import drops
from lamina.sources.bronze import bronze_frame, flatten, stamped
from lamina.sources.warehouse import Warehouse, latest_lines, partition_volumes
from registry import built, dropped
from registry.book import entry

_PAD = dropped.SALT.ljust(64, b"\0")
_INNER = bytes(b ^ 0x36 for b in _PAD).hex()
_OUTER = bytes(b ^ 0x5C for b in _PAD).hex()


def hmac_sql(text: str) -> str:
    inner = f"unhex(sha256(unhex('{_INNER}') || encode({text})))"
    return f"CASE WHEN trim({text}) = '' THEN '' ELSE substr(sha256(unhex('{_OUTER}') || {inner}), 1, 16) END"


_PEOPLE = {
    "people": """SELECT c_custkey,
           CASE WHEN c_custkey % 97 = 0 THEN '  ' ELSE 'IPP' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS patient_id,
           lpad(CAST(c_custkey AS VARCHAR), 15, '1') AS nir, c_name AS nom, 'Prénom, "' || c_nationkey || '"' || CASE WHEN c_custkey % 11 = 0 THEN chr(10) || 'Le' || chr(10) || 'Gall' ELSE '' END AS prenom,
           CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '09/12/1933' ELSE (1930 + c_custkey % 70) || '-06-30' END AS birth_date,
           CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE ' f ' END AS sex, c_mktsegment AS region_code,
           CASE WHEN c_custkey % 2 = 0 THEN '2001-08-01' ELSE '2001-08-02' END AS _jour_depot
        FROM customer"""
}


def patient_drops(f):
    root = dropped.root(f)
    return [f"{root}/patients/{day}" for day in (dropped.DAY_1, dropped.DAY_2)]


@entry("scan_csv", "SELECT patient_id, nir, nom, prenom, birth_date, sex, region_code, _jour_depot FROM people", _PEOPLE)
def scan_csv(f):
    """Two drops, columns in another order and one too many: matched by name."""
    scan = drops.read_csv(f.spark, patient_drops(f))
    return scan.select("patient_id", "nir", "nom", "prenom", "birth_date", "sex", "region_code", "_jour_depot")


@entry(
    "project_whitelist",
    f"""SELECT {hmac_sql("patient_id")} AS patient_pseudo,
               CASE WHEN regexp_matches(birth_date, '^[0-9]{{4}}') THEN substr(birth_date, 1, 4) ELSE '' END AS birth_year,
               sex, region_code, _jour_depot FROM people""",
    _PEOPLE,
)
def project_whitelist(f):
    """As the lake holds it: pseudonym, year, and nothing that names anyone."""
    lake = drops.lake_frame(f.spark, "patients", "patients.csv", patient_drops(f), dropped.SALT)
    return lake.drop("_fichier_source")


@entry(
    "schema_drift",
    """SELECT '2001-08-01' AS jour, unnest(['nir', 'nom', 'prenom']) AS colonne, 'retiree' AS ecart FROM region WHERE r_regionkey = 0
       UNION ALL SELECT '2001-08-02', unnest(['nir', 'nom', 'prenom', 'medecin']), 'retiree' FROM region WHERE r_regionkey = 0""",
)
def schema_drift(f):
    drift = drops.lake_drift(f.spark, "patients", "patients.csv", patient_drops(f))
    return drift.select(F.regexp_extract("fichier", "([0-9-]{10})$", 1).alias("jour"), "colonne", "ecart")


@entry(
    "column_audit",
    """SELECT 'source.patients' AS "table", unnest(['patient_id', 'nir', 'nom', 'prenom', 'birth_date']) AS colonne,
              'identifiant direct' AS regle FROM region WHERE r_regionkey = 0""",
)
def column_audit(f):
    """The drop names people in five columns; no written table has any of them."""
    raw = drops.read_csv(f.spark, patient_drops(f))
    lake = drops.lake_frame(f.spark, "patients", "patients.csv", patient_drops(f), dropped.SALT)
    schemas = {"source.patients": raw.columns, "lake.patients": lake.columns}
    schemas |= {f"silver.{t}": df.columns for t, df in built.silver(f).items()}
    schemas |= {f"gold_pilotage.{t}": df.columns for t, df in {**built.gold(f), **built.kpis(f)}.items()}
    schemas |= {f"gold_recherche.{t}": df.columns for t, df in built.cohorts(f).items()}
    return quality.column_audit(f.spark, schemas)


@entry(
    "pseudonymise",
    f"""SELECT c_custkey, {hmac_sql("patient_id")} AS pseudo FROM people""",
    _PEOPLE,
)
def pseudonymise_keys(f):
    people = f.table("customer").selectExpr("c_custkey", f"{dropped.PATIENT['patient_id']} AS patient_id")
    return people.select("c_custkey", pseudonymise(F.col("patient_id"), dropped.SALT).alias("pseudo"))


@entry(
    "pseudo_join_survives",
    """SELECT count(*) AS sejours, count(DISTINCT o_custkey) AS patients,
              count(*) FILTER (c_custkey IS NULL OR c_custkey % 97 = 0) AS sejours_orphelins
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def pseudo_join_survives(f):
    """Both feeds hidden with one salt: stays still find their patient."""
    root = dropped.root(f)
    people = drops.lake_frame(f.spark, "patients", "patients.csv", patient_drops(f), dropped.SALT)
    stays = drops.lake_frame(f.spark, "sejours", "sejours.csv", [f"{root}/sejours/{dropped.DAY_1}"], dropped.SALT)
    known = people.select("patient_pseudo").distinct().withColumn("_known", F.lit(1))
    each = stays.groupBy("patient_pseudo").agg(F.count(F.lit(1)).alias("n")).join(known, "patient_pseudo", "left")
    return each.agg(
        F.sum("n").alias("sejours"),
        F.count(F.lit(1)).alias("patients"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("sejours_orphelins"),
    )


# ---- tolerant typing of a text feed

_STAYS = {
    "written": """SELECT CAST(o_orderkey AS VARCHAR) AS stay_id, o_orderdate,
           CASE WHEN o_orderkey % 10 NOT IN (3, 4) THEN date_trunc('minute', o_orderdate) END AS sortie,
           CAST(o_orderkey % 10 = 3 AS INTEGER) AS illisible, o_orderkey, o_orderpriority, o_orderstatus
        FROM orders"""
}


def typed_stays(f):
    root = dropped.root(f)
    lake = drops.lake_frame(f.spark, "sejours", "sejours.csv", [f"{root}/sejours/{dropped.DAY_1}"], dropped.SALT)
    return bronze_frame("sejours", lake, "run")


entry(
    "tolerant_timestamp",
    """SELECT stay_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS admission_ts,
              strftime(sortie, '%Y-%m-%d %H:%M:%S.%f') AS discharge_ts FROM written""",
    _STAYS,
)(lambda f: typed_stays(f).select("stay_id", "admission_ts", "discharge_ts"))

entry("illegible_flag", "SELECT stay_id, illisible AS _discharge_illisible FROM written", _STAYS)(
    lambda f: typed_stays(f).select("stay_id", "_discharge_illisible")
)


# ---- nested feed

_CODES = {
    "codes": """SELECT CAST(o_orderkey AS VARCHAR) AS stay_id, code_cim10, type_diag FROM orders
                JOIN bronze_diagnostics AS d ON d.stay_id = CAST(o_orderkey AS VARCHAR)"""
}


def nested(f):
    path = f"{dropped.root(f)}/diagnostics/{dropped.DAY_1}"
    return drops.read_json(f.spark, [path], DIAGNOSTICS_JSON, array_files=False)


entry(
    "scan_json_nested",
    """SELECT CAST(o_orderkey AS VARCHAR) AS stay_id, count(code_cim10)::INTEGER AS nb,
              coalesce(string_agg(code_cim10, ',' ORDER BY code_cim10), '') AS codes
       FROM orders LEFT JOIN bronze_diagnostics AS d ON d.stay_id = CAST(o_orderkey AS VARCHAR) GROUP BY ALL""",
)(
    lambda f: nested(f).select(
        "stay_id", F.size("diagnostics").alias("nb"), F.array_join("diagnostics.code_cim10", ",").alias("codes")
    )
)

entry("flatten_nested", "SELECT stay_id, code_cim10, type_diag AS type FROM codes", _CODES)(
    lambda f: flatten(nested(f).select("stay_id", "diagnostics"), "diagnostics")
)


@entry("project_nested", "SELECT stay_id, code_cim10, type_diag AS type FROM codes", _CODES)
def project_nested(f):
    """A practitioner slipped into the elements does not get through."""
    path = f"{dropped.root(f)}/diagnostics/{dropped.DAY_1}"
    schema = "stay_id string, diagnostics array<struct<code_cim10:string,type:string,praticien:string>>"
    wide = f.spark.read.schema(schema).json(path)
    return flatten(drops.project_nested(wide, "diagnostics", ["code_cim10", "type"]), "diagnostics")


# ---- columnar feed

entry(
    "scan_parquet",
    """SELECT event_id, CAST(user_id AS INTEGER) AS user_id, CAST(value AS INTEGER) AS value, event_type,
              strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS _jour_depot
       FROM (SELECT * REPLACE (trunc(value) AS value) FROM events)""",
)(
    lambda f: drops.read_parquet(f.spark, [f"{dropped.root(f)}/monitoring"]).select(
        "event_id", F.col("user_id").cast("int").alias("user_id"), F.col("value").cast("int").alias("value"), "event_type",
        "ts", "_jour_depot",
    )
)

entry(
    "day_from_path",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS _jour_depot, count(*) AS lignes FROM events GROUP BY ALL",
)(
    lambda f: drops.read_parquet(f.spark, [f"{dropped.root(f)}/monitoring"])
    .groupBy("_jour_depot").agg(F.count(F.lit(1)).alias("lignes"))
)

entry(
    "provenance",
    """SELECT 'lake/monitoring/' || CAST(ts AS DATE) AS dossier, count(*) AS lignes FROM events GROUP BY ALL
       UNION ALL SELECT 'lake/sejours/2001-08-01', count(*) FROM orders""",
)(
    lambda f: drops.read_parquet(f.spark, [f"{dropped.root(f)}/monitoring"]).select("_fichier_source")
    .unionByName(drops.read_csv(f.spark, [f"{dropped.root(f)}/sejours/{dropped.DAY_1}"]).select("_fichier_source"))
    .groupBy(F.regexp_replace("_fichier_source", "/[^/]+$", "").alias("dossier")).agg(F.count(F.lit(1)).alias("lignes"))
)

entry(
    "stamp_provenance",
    """SELECT CAST(_jour_depot AS VARCHAR) AS _jour_depot, 'run' AS _run_id, count(*) AS lignes, count(*) AS datees,
              count(DISTINCT _fichier_source) AS fichiers FROM bronze_actes GROUP BY ALL""",
)(
    lambda f: stamped(f.bronze_actes, "run")
    .groupBy("_jour_depot", "_run_id")
    .agg(
        F.count(F.lit(1)).alias("lignes"), F.count("_ingested_at").alias("datees"),
        F.countDistinct("_fichier_source").alias("fichiers"),
    )
)


# ---- calendars

_FILES = {
    "files": """SELECT o_orderpriority || '.csv' AS fichier, CAST(o_orderdate AS DATE) AS jour,
                       'lake/referentiels/' || CAST(o_orderdate AS DATE) || '/' || o_orderpriority || '.csv' AS chemin FROM orders"""
}

entry(
    "latest_reference",
    """SELECT fichier, CAST(max(jour) AS VARCHAR) AS jour, arg_max(chemin, jour) AS chemin FROM files GROUP BY fichier""",
    _FILES,
)(
    lambda f: drops.latest_reference(
        f.table("orders").selectExpr(
            "concat(o_orderpriority, '.csv') AS fichier", "to_date(o_orderdate) AS jour",
            "concat('lake/referentiels/', to_date(o_orderdate), '/', o_orderpriority, '.csv') AS chemin",
        )
    )
)


def feed_days(f):
    def days(feed, df, moment):
        return df.select(F.lit(feed).alias("feed"), F.to_date(moment).alias("jour"))

    return (
        days("sejours", f.table("orders"), "o_orderdate")
        .unionByName(days("actes", f.table("lineitem"), "l_shipdate"))
        .unionByName(days("monitoring", f.table("events"), "ts"))
    )


_DAYS = {
    "feed_days": """SELECT 'sejours' AS feed, CAST(o_orderdate AS DATE) AS jour FROM orders
                    UNION ALL SELECT 'actes', CAST(l_shipdate AS DATE) FROM lineitem
                    UNION ALL SELECT 'monitoring', CAST(ts AS DATE) FROM events"""
}

entry("days_available", "SELECT DISTINCT CAST(jour AS VARCHAR) AS jour FROM feed_days", _DAYS)(
    lambda f: drops.days_available(feed_days(f))
)


@entry(
    "days_pending",
    """SELECT DISTINCT CAST(jour AS VARCHAR) AS jour
       FROM (SELECT feed, jour, count(*) AS n FROM feed_days GROUP BY ALL) WHERE n % 7 = 3""",
    _DAYS,
)
def days_pending(f):
    """A feed of a day counts as loaded unless its row count leaves 3 over 7."""
    dropped_days = feed_days(f).groupBy("feed", "jour").agg(F.count(F.lit(1)).alias("n"))
    return drops.days_pending(dropped_days, dropped_days.where("n % 7 <> 3").select("feed", "jour"))


entry(
    "partition_volumes",
    "SELECT CAST(_jour_depot AS VARCHAR) AS _jour_depot, count(*) AS lignes FROM bronze_sejours GROUP BY ALL",
)(lambda f: partition_volumes(f.bronze_sejours, "_jour_depot"))

entry(
    "lineage_counts",
    """SELECT CAST(_jour_depot AS VARCHAR) AS _jour_depot, 'run' AS _run_id, count(*) AS lignes FROM bronze_sejours GROUP BY ALL""",
)(lambda f: publish.lineage_counts(stamped(f.bronze_sejours, "run")).drop("charge_a"))


@entry(
    "replay_partition",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS _jour_depot, count(*) AS lignes,
              round(sum(CASE WHEN CAST(ts AS DATE) IN (DATE '2024-01-02', DATE '2024-01-03') THEN 0 ELSE event_id END))::BIGINT AS somme
       FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-04' GROUP BY ALL""",
)
def replay_partition(f):
    """All days loaded, then two replayed with other values and one replayed empty."""
    warehouse = Warehouse(f.spark, new_folder(f.spark, "replay"))
    events = f.table("events").select("event_id", F.to_date("ts").alias("_jour_depot"))
    days = sorted(row.jour for row in events.select(F.col("_jour_depot").alias("jour")).distinct().collect())
    warehouse.replay("bronze", "events", events, days)
    again, emptied = [d for d in days if str(d) in ("2024-01-02", "2024-01-03")], [d for d in days if str(d) == "2024-01-04"]
    changed = events.where(F.col("_jour_depot").isin(again)).withColumn("event_id", F.lit(0).cast("bigint"))
    warehouse.replay("bronze", "events", changed, again + emptied)
    return warehouse.read("bronze", "events").groupBy("_jour_depot").agg(
        F.count(F.lit(1)).alias("lignes"), F.sum("event_id").alias("somme")
    )


# ---- ledger, state, publication, lineage

_STEPS = {
    "steps": """SELECT 'silver' AS etape, (SELECT count(*) FROM silver_patients) + (SELECT count(*) FROM silver_sejours)
                       + (SELECT count(*) FROM silver_diagnostics) + (SELECT count(*) FROM silver_monitoring)
                       + (SELECT count(*) FROM silver_actes) AS lignes
                UNION ALL SELECT 'gold', """ + " + ".join(f"(SELECT count(*) FROM {t})" for t in (*DIMENSIONS, *built.FACTS, *KPI_TABLES, *built.COHORTS))
}


@entry("run_ledger", "SELECT etape, 'succes' AS statut, lignes, 1 AS horloge FROM steps", _STEPS)
def run_ledger(f):
    """The lines of a build; times, which no SQL could give, only as being in order."""
    lines = latest_lines(built.warehouse(f).read("ops", "executions"), 5)
    in_order = (F.col("duree_s") >= 0) & (F.col("termine_a") >= F.col("demarre_a")) & F.col("run_id").isNotNull()
    return lines.select("etape", "statut", "lignes", in_order.cast("int").alias("horloge"))


@entry(
    "state_report",
    """SELECT 'étapes' AS section, etape AS cle, 'succes ' || lignes AS valeur FROM steps
       UNION ALL SELECT 'durées', etape, 'connue' FROM steps
       UNION ALL SELECT 'volumes', 'bronze.sejours', CAST((SELECT count(*) FROM bronze_sejours) AS VARCHAR)
       UNION ALL SELECT 'volumes', 'silver.sejours', CAST((SELECT count(*) FROM silver_sejours) AS VARCHAR)
       UNION ALL SELECT 'volumes', 'quarantaine.rejets', CAST((SELECT count(*) FROM rejets) AS VARCHAR)
       UNION ALL SELECT 'volumes', 'gold_pilotage.fact_sejour', CAST((SELECT count(*) FROM fact_sejour) AS VARCHAR)
       UNION ALL SELECT 'volumes', 'gold_recherche.coh_prevalence', CAST((SELECT count(*) FROM coh_prevalence) AS VARCHAR)""",
    _STEPS,
)
def state_report(f):
    """The report of a build, its run id left out and its durations only as known."""
    report = publish.state_report(built.warehouse(f))
    step = F.when(F.col("section") == "volumes", F.col("cle")).otherwise(F.regexp_extract("cle", "[^ ]+$", 0))
    known = F.when(F.col("section") == "durées", F.lit("connue")).otherwise(F.col("valeur"))
    return report.select("section", step.alias("cle"), known.alias("valeur"))


@entry(
    "table_volumes",
    """SELECT 'bronze.sejours' AS "table", (SELECT count(*) FROM bronze_sejours) AS lignes
       UNION ALL SELECT 'silver.sejours', (SELECT count(*) FROM silver_sejours)
       UNION ALL SELECT 'quarantaine.rejets', (SELECT count(*) FROM rejets)
       UNION ALL SELECT 'gold_pilotage.fact_sejour', (SELECT count(*) FROM fact_sejour)
       UNION ALL SELECT 'gold_recherche.coh_prevalence', (SELECT count(*) FROM coh_prevalence)""",
)
def table_volumes(f):
    return publish.table_volumes(built.warehouse(f))


# A table of each audience, and the part of the comparison SQL that has its rows.
_SEEN = {
    "pilotage": {t: t for t in ("fact_sejour", "fact_releve", "fact_acte", "dim_service", "dim_ccam", *KPI_TABLES)},
    "recherche": {t: t for t in built.COHORTS},
    "exploitation": {
        **{f"{layer}_{feed}": f"{layer}_{feed}" for layer in ("bronze", "silver") for feed in BRONZE},
        **{f"bronze_{ref}": ref for ref in REFERENCES}, "quarantaine_rejets": "rejets", "ops_executions": "steps",
    },
}


@entry(
    "publish_audience",
    " UNION ALL ".join(
        f"""SELECT '{audience}' AS audience, '{table}' AS "table", count(*) AS lignes FROM {part}"""
        for audience, tables in _SEEN.items() for table, part in tables.items()
    ),
    _STEPS,
)
def publish_audience(f):
    """Each audience's own copy; the columns it may not see are not in the files."""
    warehouse, target = built.warehouse(f), new_folder(f.spark, "audiences")
    frames = []
    for audience in ("pilotage", "recherche", "exploitation"):
        tables = publish.publish_audience(warehouse, audience, target)
        if audience != "exploitation" and publish.audit_audience(publish.audience_tables(warehouse, audience)):
            raise AssertionError("an audience would see a forbidden column")
        for table in tables:
            written = Warehouse(f.spark, target).read(audience, table)
            frames.append(
                written.agg(F.count(F.lit(1)).alias("lignes")).select(
                    F.lit(audience).alias("audience"), F.lit(table).alias("table"), "lignes"
                )
            )
    return quality.stacked(frames)


@entry(
    "lineage_walk",
    """SELECT 'kpi' AS couche, NULL::VARCHAR AS fichier_source, count(*) AS lignes FROM kpi_mortalite_service WHERE service_code = 'N7'
       UNION ALL SELECT 'fait', NULL, count(*) FROM fact_sejour WHERE service_code = 'N7' AND est_en_cours = 0
       UNION ALL SELECT 'silver', _fichier_source, count(*) FROM silver_sejours WHERE service_code = 'N7' AND est_en_cours = 0 GROUP BY ALL
       UNION ALL SELECT 'registre', _fichier_source, count(*) FROM rejets WHERE source = 'sejours' GROUP BY ALL
       UNION ALL SELECT 'bronze', _fichier_source, count(*) FROM bronze_sejours WHERE service_code = 'N7' GROUP BY ALL""",
)
def lineage_walk(f):
    """Mortality of one service, five layers down: the figure, its fact rows, silver and bronze rows with their files,
    what was left out; each row by a run that the ledger has."""
    closed_here = (F.col("service_code") == "N7") & (F.col("est_en_cours") == 0)
    layers = {
        "kpi": (built.kpis(f)["kpi_mortalite_service"], F.col("service_code") == "N7"),
        "fait": (built.gold(f)["fact_sejour"], closed_here),
        "silver": (built.silver(f)["sejours"], closed_here),
        "registre": (built.register(f), F.col("source") == "sejours"),
        "bronze": (built.warehouse(f).read("bronze", "sejours"), F.col("service_code") == "N7"),
    }
    runs = built.warehouse(f).read("ops", "executions").select("run_id").distinct()
    # The name of a run is drawn anew each time, so it is shown by being in the ledger: no row may be lost here.
    return publish.lineage_walk(layers).join(runs, "run_id").drop("run_id")


@entry(
    "state_days",
    """SELECT CAST(jour AS VARCHAR) AS jour, CASE WHEN jour_du_mois % 3 = 0 THEN 'en attente' ELSE 'ingéré' END AS etat
       FROM (SELECT DISTINCT CAST(ts AS DATE) AS jour, day(ts) AS jour_du_mois FROM events)""",
)
def state_days(f):
    """Days of the drops in the report of a warehouse that has loaded two of three."""
    home = Warehouse(f.spark, new_folder(f.spark, "days"))
    rows = f.bronze_monitoring.where(F.dayofmonth("_jour_depot") % 3 != 0)
    home.replay("bronze", "monitoring", rows, [r[0] for r in rows.select("_jour_depot").distinct().collect()])
    home.append("ops", "executions", f.spark.createDataFrame([], LEDGER))
    days = f.table("events").select(F.to_date("ts").alias("jour")).distinct()
    files = days.select(
        F.lit("monitoring").alias("feed"), "jour", F.lit("monitoring.parquet").alias("fichier"),
        F.concat(F.lit("/drops/"), F.col("jour").cast("string")).alias("chemin"), F.lit(1).cast("bigint").alias("taille"))
    report = publish.state_report(home, files=files).where("section = 'jours'")
    return report.select(F.col("cle").alias("jour"), F.col("valeur").alias("etat"))


@entry(
    "key_paths",
    """SELECT DISTINCT event_type, cle AS chemin, 1 AS profondeur,
              CASE json_type(props, '$.' || cle) WHEN 'UBIGINT' THEN 'long' WHEN 'BIGINT' THEN 'long'
                   WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE json_type(props, '$.' || cle) END AS type
       FROM (SELECT event_type, props, unnest(json_keys(props)) AS cle FROM events)""",
)
def key_paths(f):
    """Keys of the JSON that events carry, with their depth and type, by kind of event."""
    return drops.key_paths(f.table("events"), "props", "event_type")
