"""The driver's tables in the shape of the bronze feeds, so every plan runs on them unchanged.

orders -> stays (last shipped 'F' line = discharge), lineitem -> acts, lines by
part brand -> diagnoses, events -> readings, one carrier stay per event user,
customer -> three cumulative patient snapshots, nation/part -> nomenclatures.
Faults the tables do not have (blank patients, unreadable dates, unknown
stays, redelivered stays) are derived from the keys, over whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lamina.operators.rules import kept
from lamina.plans import silver, star
from lamina.session import prepare

BRANDS_WITHOUT_LABEL = "Brand#13"

# Of `order_codes`: the stay of a diagnosis, one for each order, and its kind.
CODED_STAY = "if(l_orderkey % 101 = 0, concat('X', l_orderkey), cast(l_orderkey AS string))"
CODE_KIND = "if(principal, 'principal', 'associe')"

# Declared, so that no footer is read before a query runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Feeds:
    """Lazily composed frames of one data folder. Nothing runs until an action does."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read
            if name in SCHEMAS:
                reader = reader.schema(SCHEMAS[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # ---- nomenclatures

    @cached_property
    def ref_services(self) -> DataFrame:
        return self.table("nation").where("n_nationkey <> 24").selectExpr(
            "if(n_nationkey = 0, 'URGENCES', concat('N', n_nationkey)) AS service_code",
            "n_name AS service_label",
        )

    @cached_property
    def ref_description_service(self) -> DataFrame:
        beds = self.table("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
        return (
            self.table("nation")
            .where("n_regionkey < 4")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(beds, F.col("n_nationkey") == F.col("s_nationkey"), "left")
            .selectExpr(
                "if(n_nationkey = 0, 'URGENCES', concat('N', n_nationkey)) AS service_code",
                "r_name AS categorie",
                "cast(n AS int) AS capacite_lits",
                "concat('P', r_regionkey) AS pole",
            )
        )

    @cached_property
    def ref_cim10(self) -> DataFrame:
        brands = self.table("part").select("p_brand").distinct()
        return brands.where(F.col("p_brand") != BRANDS_WITHOUT_LABEL).selectExpr(
            "p_brand AS code_cim10", "concat('Pathologie ', p_brand) AS libelle"
        )

    @cached_property
    def ref_ccam(self) -> DataFrame:
        return self.table("part").where("p_size <= 45").selectExpr(
            "concat('C', p_partkey) AS code_ccam",
            "p_type AS libelle",
            "if(p_size = 45, NULL, cast(p_retailprice AS decimal(10,2))) AS tarif_euros",
        )

    # ---- feeds

    @cached_property
    def bronze_patients(self) -> DataFrame:
        drops = self.table("customer").select(
            "*", F.explode(F.expr("sequence(cast(c_custkey % 3 AS int), 2)")).alias("i")
        )
        return drops.selectExpr(
            "if(c_custkey % 97 = 0 AND i = 1, '', cast(c_custkey AS string)) AS patient_pseudo",
            "if(c_custkey % 50 = 0, NULL, cast(1930 + c_custkey % 70 AS int)) AS birth_year",
            "CASE (c_custkey + if(c_custkey % 59 = 0, i, 0)) % 4"
            " WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN ' f ' ELSE 'X' END AS sex",
            "if(c_custkey % 53 = 0 AND i < 2, 'AUTRE', c_mktsegment) AS region_code",
            "date_add(DATE'2001-08-01', i) AS _jour_depot",
            "concat('lake/patients/', date_add(DATE'2001-08-01', i), '/patients.csv') AS _fichier_source",
        )

    @cached_property
    def order_stays(self) -> DataFrame:
        closing = (
            self.table("lineitem")
            .where("l_linestatus = 'F'")
            .groupBy("l_orderkey")
            .agg(F.max("l_shipdate").alias("last_ship"))
        )
        orders = (
            self.table("orders")
            .join(closing, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
            .selectExpr(
                "*",
                "if(o_orderstatus = 'O' OR o_orderkey % 83 = 0, NULL, last_ship) AS out_ts",
                "explode(if(o_orderkey % 61 = 0, array(0, 1), array(0))) AS v",
            )
            .withColumn("n", F.expr("(c_nationkey + v) % 25"))
        )
        return orders.selectExpr(
            "cast(o_orderkey AS string) AS stay_id",
            "if(o_orderkey % 97 = 0, '', cast(o_custkey AS string)) AS patient_pseudo",
            "if(n = 0, 'URGENCES', concat('N', n)) AS service_code",
            "if(o_orderkey % 89 = 0, NULL, o_orderdate) AS admission_ts",
            "out_ts AS discharge_ts",
            "if(o_orderkey % 83 = 0, 1, 0) AS _discharge_illisible",
            "if(o_orderpriority = '1-URGENT', 'urgence', lower(substr(o_orderpriority, 3))) AS admission_mode",
            "CASE WHEN out_ts IS NULL OR o_orderkey % 71 = 0 THEN ''"
            " WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'deces'"
            " WHEN o_orderstatus = 'F' THEN 'domicile' ELSE 'transfert' END AS discharge_mode",
            "date_add(to_date(o_orderdate), v) AS _jour_depot",
            "concat('lake/sejours/', date_add(to_date(o_orderdate), v), '/sejours.csv') AS _fichier_source",
        )

    @cached_property
    def carrier_stays(self) -> DataFrame:
        users = self.table("events").groupBy("user_id").agg(
            F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("admission_ts"),
            F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("discharge_ts"),
            F.to_date(F.min("ts")).alias("_jour_depot"),
        )
        return users.withColumn("n", F.expr("user_id % 25")).selectExpr(
            "concat('U', user_id) AS stay_id",
            "if(user_id % 97 = 0, '', cast(user_id AS string)) AS patient_pseudo",
            "if(n = 0, 'URGENCES', concat('N', n)) AS service_code",
            "admission_ts",
            "discharge_ts",
            "0 AS _discharge_illisible",
            "'programme' AS admission_mode",
            "if(discharge_ts IS NULL, '', 'domicile') AS discharge_mode",
            "_jour_depot",
            "concat('lake/sejours/', _jour_depot, '/sejours.csv') AS _fichier_source",
        )

    @cached_property
    def bronze_sejours(self) -> DataFrame:
        return self.order_stays.unionByName(self.carrier_stays)

    @cached_property
    def order_codes(self) -> DataFrame:
        """(l_orderkey, p_brand, line, principal): the first line of each brand of an order.

        Lines are dealt by order once; the groups and the window above it need no further shuffle, and nothing is
        sorted before it: hardly any two lines of a task's input are of one order and brand.
        """
        line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        codes = (
            self.table("lineitem")
            .join(self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", "p_brand", line.alias("line"))
            .repartition("l_orderkey")
            .groupBy("l_orderkey", "p_brand")
            .agg(F.min("line").alias("line"))
        )
        # One row per brand of an order by now: 25 at most.
        first = F.min("line").over(Window.partitionBy("l_orderkey"))
        return codes.withColumn("principal", F.col("line") == first)

    @cached_property
    def bronze_diagnostics(self) -> DataFrame:
        return self.order_codes.selectExpr(
            f"{CODED_STAY} AS stay_id",
            "p_brand AS code_cim10",
            f"{CODE_KIND} AS type_diag",
            "to_date(line.l_shipdate) AS _jour_depot",
            "concat('lake/diagnostics/', to_date(line.l_shipdate), '/diagnostics.json') AS _fichier_source",
        )

    @cached_property
    def bronze_monitoring(self) -> DataFrame:
        return self.table("events").selectExpr(
            "concat(if(user_id % 101 = 0, 'X', 'U'), user_id) AS stay_id",
            "ts",
            "cast(if(value < 1, (event_id % 2) * 500, 60 + floor(value / 2)) AS int) AS heart_rate",
            "cast(if(value < 1, (event_id % 2) * 120, 88 + event_id % 13) AS int) AS spo2",
            "cast((360 + event_id % 40) / 10BD AS decimal(4,1)) AS temp_c",
            "to_date(ts) AS _jour_depot",
            "concat('lake/monitoring/', to_date(ts), '/monitoring.parquet') AS _fichier_source",
        )

    @cached_property
    def bronze_actes(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "if(l_orderkey % 101 = 0, concat('X', l_orderkey), cast(l_orderkey AS string)) AS stay_id",
            "concat('C', l_partkey) AS code_ccam",
            "l_shipdate AS acte_ts",
            "to_date(l_shipdate) AS _jour_depot",
            "concat('lake/actes/', to_date(l_shipdate), '/actes.parquet') AS _fichier_source",
        )

    @property
    def bronze(self) -> dict[str, DataFrame]:
        names = ("patients", "sejours", "diagnostics", "monitoring", "actes")
        refs = ("ref_services", "ref_cim10", "ref_ccam", "ref_description_service")
        return {n: getattr(self, f"bronze_{n}") for n in names} | {n: getattr(self, n) for n in refs}

    # ---- silver

    @cached_property
    def retained_patients(self) -> DataFrame:
        return silver.retained_patients(self.bronze_patients)

    @cached_property
    def retained_stays(self) -> DataFrame:
        return silver.retained_stays(self.bronze_sejours)

    @cached_property
    def judged_stays(self) -> DataFrame:
        return silver.judge_stays(self.retained_stays, self.ref_services)

    @cached_property
    def lookup(self) -> DataFrame:
        return silver.stay_lookup(silver.ruled_stays(self.retained_stays))

    @cached_property
    def judged_diagnostics(self) -> DataFrame:
        return silver.judge_diagnostics(self.bronze_diagnostics, self.lookup, self.ref_cim10)

    @cached_property
    def judged_monitoring(self) -> DataFrame:
        return silver.judge_readings(self.bronze_monitoring, self.lookup)

    @cached_property
    def judged_actes(self) -> DataFrame:
        return silver.judge_acts(self.bronze_actes, self.lookup, self.ref_ccam)

    def judged(self, feed: str) -> DataFrame:
        return self.judged_stays if feed == "sejours" else getattr(self, f"judged_{feed}")

    def silver(self, feed: str) -> DataFrame:
        return silver.silver_patients(self.retained_patients) if feed == "patients" else kept(self.judged(feed))

    # ---- star, in the parts an indicator needs

    @cached_property
    def dim_patient(self) -> DataFrame:
        return star.dim_patient(self.silver("patients"))

    @cached_property
    def dim_service(self) -> DataFrame:
        return star.dim_service(self.ref_services, self.ref_description_service)

    @cached_property
    def dim_cim10(self) -> DataFrame:
        return star.dim_cim10(self.ref_cim10)

    @cached_property
    def dim_ccam(self) -> DataFrame:
        return star.dim_ccam(self.ref_ccam)

    @cached_property
    def stays(self) -> DataFrame:
        """The stay fact without the columns that need a join."""
        return star.stay_measures(self.silver("sejours"))

    # Facts hold codes, not labels: these stop before the label join of silver.

    @cached_property
    def _carried_diagnostics(self) -> DataFrame:
        return kept(silver.carry_diagnostics(self.bronze_diagnostics, self.lookup))

    @cached_property
    def _carried_acts(self) -> DataFrame:
        return kept(silver.carry_acts(self.bronze_actes, self.lookup))

    @cached_property
    def fact_sejour(self) -> DataFrame:
        return star.fact_sejour(self.silver("sejours"), self.dim_patient)

    @cached_property
    def diagnoses(self) -> DataFrame:
        return star.diagnosis_measures(self._carried_diagnostics)

    @cached_property
    def fact_diagnostic(self) -> DataFrame:
        return star.fact_diagnostic(self._carried_diagnostics, self.dim_patient)

    @cached_property
    def fact_releve(self) -> DataFrame:
        return star.fact_releve(self.silver("monitoring"))

    @cached_property
    def fact_acte(self) -> DataFrame:
        return star.fact_acte(self._carried_acts)
