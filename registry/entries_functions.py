"""Column expressions, over whole tables."""

from pyspark.sql import functions as F

from lamina.functions import measures, parsing
from lamina.functions.privacy import generalise_year
from registry.book import entry

_TEXTS = {
    "texts": """SELECT l_orderkey, l_linenumber,
        CASE l_linenumber % 6 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(l_partkey * 1000 AS VARCHAR)
             WHEN 3 THEN '-' || l_partkey WHEN 4 THEN CAST(l_extendedprice AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS t
        FROM lineitem"""
}


def texts(f):
    """Numbers as a careless source writes them."""
    return f.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE l_linenumber % 6 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN cast(l_partkey * 1000 AS string)"
        " WHEN 3 THEN concat('-', l_partkey) WHEN 4 THEN cast(l_extendedprice AS string) ELSE cast(l_partkey AS string) END AS t",
    )


entry(
    "tolerant_int",
    """SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(t, '[0-9]+') AND TRY_CAST(t AS BIGINT) <= 65535
                                             THEN TRY_CAST(t AS INTEGER) END AS n FROM texts""",
    _TEXTS,
)(lambda f: texts(f).select("l_orderkey", "l_linenumber", parsing.tolerant_int(F.col("t")).alias("n")))

entry(
    "tolerant_decimal",
    """SELECT l_orderkey, l_linenumber, CAST(TRY_CAST(t AS DECIMAL(10,2)) AS DOUBLE) AS n FROM texts""",
    _TEXTS,
)(lambda f: texts(f).select("l_orderkey", "l_linenumber", parsing.tolerant_decimal(F.col("t"), 10, 2).alias("n")))

_WRITTEN = """CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN {french} WHEN 3 THEN '  ' || {iso} ELSE {iso} END"""

entry(
    "generalise_year",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 >= 3 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '' END AS annee FROM orders""",
)(
    lambda f: f.table("orders").select(
        "o_orderkey",
        generalise_year(
            F.expr(_WRITTEN.format(french="date_format(o_orderdate, 'dd/MM/yyyy')", iso="date_format(o_orderdate, 'yyyy-MM-dd')"))
        ).alias("annee"),
    )
)

entry(
    "cast_measures",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS entier,
              CAST(CAST(CAST(l_discount * 100 + l_tax * 10 AS DECIMAL(10,4)) AS DECIMAL(4,1)) AS DOUBLE) AS temp FROM lineitem""",
)(
    lambda f: f.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("entier"),
        (F.col("l_discount") * 100 + F.col("l_tax") * 10).cast("decimal(10,4)").cast("decimal(4,1)").alias("temp"),
    )
)

entry(
    "normalise_category",
    """SELECT sex, CASE WHEN upper(trim(sex)) IN ('M', 'F') THEN upper(trim(sex)) ELSE 'inconnu' END AS norme, count(*) AS n
       FROM bronze_patients GROUP BY ALL""",
)(
    lambda f: f.bronze_patients.groupBy("sex", measures.normalise_sex(F.col("sex")).alias("norme")).agg(
        F.count(F.lit(1)).alias("n")
    )
)

entry(
    "default_label",
    """SELECT stay_id, CASE WHEN discharge_mode = '' THEN 'inconnu' ELSE discharge_mode END AS discharge_mode FROM bronze_sejours""",
)(lambda f: f.bronze_sejours.select("stay_id", measures.default_label(F.col("discharge_mode")).alias("discharge_mode")))

entry(
    "duration_days",
    """SELECT event_id, date_diff('minute', premier, ts) AS minutes, date_diff('minute', premier, ts) / 1440.0 AS jours
       FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id) AS premier FROM events)""",
)(
    lambda f: f.table("events")
    .join(f.table("events").groupBy("user_id").agg(F.min("ts").alias("premier")), "user_id")
    .select(
        "event_id",
        measures.minutes_between(F.col("premier"), F.col("ts")).alias("minutes"),
        measures.duration_days(F.col("premier"), F.col("ts")).alias("jours"),
    )
)

entry(
    "calendar_parts",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS jour, CAST(year(ts) AS INTEGER) AS annee,
              CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS mois, strftime(ts, '%Y%m') AS yyyymm FROM events""",
)(
    lambda f: f.table("events").select(
        "event_id", F.to_date("ts").alias("jour"), F.year("ts").alias("annee"),
        measures.month_start(F.to_date("ts")).alias("mois"), measures.partition_month(F.to_date("ts")).alias("yyyymm"),
    )
)

entry(
    "age_band",
    """SELECT o_orderkey, CAST(age AS INTEGER) AS age, CASE WHEN age IS NULL THEN 'inconnu'
              ELSE CAST(trunc(age / 10.0) * 10 AS INTEGER) || '-' || CAST(trunc(age / 10.0) * 10 + 9 AS INTEGER) END AS tranche
       FROM (SELECT o_orderkey, year(o_orderdate) - CASE WHEN o_custkey % 50 <> 0 THEN 1920 + o_custkey % 90 END AS age FROM orders)""",
)(
    lambda f: f.table("orders")
    .withColumn("age", measures.age_at(F.col("o_orderdate"), F.expr("if(o_custkey % 50 <> 0, cast(1920 + o_custkey % 90 AS int), NULL)")))
    .select("o_orderkey", "age", measures.decade_band(F.col("age")).alias("tranche"))
)

entry(
    "sentinel_partition",
    """SELECT coalesce(strftime(CAST(admission_ts AS DATE), '%Y%m'), '197001') AS mois, count(*) AS n FROM bronze_sejours GROUP BY ALL""",
)(
    lambda f: f.bronze_sejours.groupBy(measures.partition_month(F.to_date("admission_ts")).alias("mois")).agg(
        F.count(F.lit(1)).alias("n")
    )
)
