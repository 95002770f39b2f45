"""The driver's tables written out as drops, for the entries that read files.

Every row of a table lands in some drop. The two patient drops disagree on
column order and one carries a column nobody declared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.session import new_folder
from registry.feeds import CODE_KIND, Feeds

SALT = b"sel de test"
DAY_1, DAY_2 = "2001-08-01", "2001-08-02"

_written: dict[tuple[str, str], str] = {}

PATIENT = {
    "patient_id": "if(c_custkey % 97 = 0, '  ', concat('IPP', lpad(c_custkey, 7, '0')))",
    "nir": "lpad(c_custkey, 15, '1')",
    "nom": "c_name",
    "prenom": "concat('Prénom, \"', c_nationkey, '\"', if(c_custkey % 11 = 0, concat(char(10), 'Le', char(10), 'Gall'), ''))",
    "birth_date": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '09/12/1933' ELSE concat(1930 + c_custkey % 70, '-06-30') END",
    "sex": "if(c_custkey % 2 = 0, 'M', ' f ')",
    "region_code": "c_mktsegment",
}

WRITTEN_TS = """CASE o_orderkey % 10 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
    WHEN 1 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy HH:mm')
    WHEN 3 THEN 'n/a' WHEN 4 THEN '' WHEN 5 THEN date_format(o_orderdate, 'yyyyMMdd')
    WHEN 6 THEN concat(date_format(o_orderdate + INTERVAL 2 HOURS, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00')
    WHEN 7 THEN cast(unix_seconds(cast(o_orderdate AS timestamp)) AS string)
    WHEN 8 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE date_format(o_orderdate, 'dd.MM.yyyy HH:mm') END"""

STAY = {
    "stay_id": "cast(o_orderkey AS string)",
    "patient_id": "concat('IPP', lpad(o_custkey, 7, '0'))",
    "service_code": "o_orderstatus",
    "admission_ts": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')",
    "discharge_ts": WRITTEN_TS,
    "admission_mode": "o_orderpriority",
    "discharge_mode": "if(o_orderkey % 7 = 0, '', o_orderstatus)",
}


def root(f: Feeds) -> str:
    key = (f.spark.sparkContext.applicationId, f.folder)
    if key not in _written:
        _written[key] = write(f, new_folder(f.spark, "drops"))
    return _written[key]


def write(f: Feeds, target: str) -> str:
    people = f.table("customer").selectExpr("c_custkey", *[f"{sql} AS {name}" for name, sql in PATIENT.items()])
    names = list(PATIENT)
    first = people.where("c_custkey % 2 = 0").select(*names)
    second = people.where("c_custkey % 2 = 1").select("sex", *[c for c in names if c != "sex"], F.lit("Dr X").alias("medecin"))
    for day, frame in ((DAY_1, first), (DAY_2, second)):
        writer = frame.write.option("header", True).option("escape", '"')
        # The writer would trim blanks the source is known to have.
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.csv(f"{target}/patients/{day}")
    stays = f.table("orders").selectExpr(*[f"{sql} AS {name}" for name, sql in STAY.items()])
    stays.write.option("header", True).csv(f"{target}/sejours/{DAY_1}")
    # By order, as the codes lie already. A stay named `X...` is that of no order.
    item = F.struct(F.col("p_brand").alias("code_cim10"), F.expr(CODE_KIND).alias("type"), F.lit("Dr X").alias("praticien"))
    codes = f.order_codes.where("l_orderkey % 101 <> 0").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(item)).alias("diagnostics")
    )
    # Stays without any code come with an empty array.
    listed = f.table("orders").select("o_orderkey").join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    listed.select(
        F.col("o_orderkey").cast("string").alias("stay_id"), F.coalesce("diagnostics", F.array()).alias("diagnostics")
    ).write.json(f"{target}/diagnostics/{DAY_1}")
    events = f.table("events").withColumn("jour", F.to_date("ts"))
    events.write.partitionBy("jour").parquet(f"{target}/monitoring")
    return target
