"""Deliveries as they come, writes that fail, and keys that hold much of the data."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.functions.parsing import tolerant_timestamp
from lamina.plans import profile
from lamina.plans.run import drift_report, ledgered
from lamina.sources import drops
from lamina.sources.warehouse import Warehouse


def test_a_quoted_line_break_is_part_of_a_value(spark, tmp_path):
    folder = tmp_path / "patients" / "2026-08-01"
    folder.mkdir(parents=True)
    (folder / "patients.csv").write_text(
        'patient_id,nir,nom,prenom,birth_date,sex,region_code\n'
        'IPP0000001,1,"Le\nGall","An""ne",1950-01-01,F,R1\nIPP0000002,2,Roy,Luc,1960-01-01,M,R2\n', encoding="utf-8")
    rows = drops.read_csv(spark, [str(folder / "patients.csv")]).orderBy("patient_id").collect()
    assert [(r.patient_id, r.nom, r.prenom) for r in rows] == [
        ("IPP0000001", "Le\nGall", 'An"ne'), ("IPP0000002", "Roy", "Luc")]
    lake = drops.lake_frame(spark, "patients", "patients.csv", [str(folder / "patients.csv")], b"sel")
    assert lake.select("patient_pseudo").distinct().count() == 2


@pytest.mark.parametrize("written, read", [
    ("2024-01-01T10:00:00+02:00", datetime(2024, 1, 1, 8)),
    ("2024-01-01 10:00:00Z", datetime(2024, 1, 1, 10)),
    ("2024-01-01 10:00:00-0530", datetime(2024, 1, 1, 15, 30)),
    ("1704103200", datetime(2024, 1, 1, 10)),
    ("12 Jan 2024", datetime(2024, 1, 12)),
    ("13.02.2024 07:05", datetime(2024, 2, 13, 7, 5)),
    ("2024-01-01 10:00:00", datetime(2024, 1, 1, 10)),
    ("2024-01-01", datetime(2024, 1, 1)),
    ("20240101", datetime(2024, 1, 1)),
    ("n/a", None), ("", None), (None, None),
])
def test_moments(spark, written, read):
    df = spark.createDataFrame([(written,)], "t string")
    assert df.select(tolerant_timestamp(F.col("t")).alias("m")).first().m == read


def test_drift_of_a_run(spark, tmp_path):
    for name, text in {
        "patients/2026-08-01/patients.csv": "patient_id,nir,nom,prenom,birth_date,sex,medecin\n1,2,a,b,c,d,e\n",
        "patients/2026-08-01/notes.txt": "x",
        "patients/2026-08-02/notes.txt": "x",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    home, files = Warehouse(spark, str(tmp_path / "home")), drops.inventory(spark, str(tmp_path))
    day = datetime(2026, 8, 1).date()
    found = {(r.fichier.split("/")[-1], r.colonne, r.ecart) for r in drift_report(home, files, [day]).collect()}
    assert ("notes.txt", None, "non declare") in found
    assert {("patients.csv", "medecin", "retiree"), ("patients.csv", "region_code", "manquante")} <= found


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path))
    home.replace("silver", "t", spark.range(3))
    broken = spark.range(5).select(F.assert_true(F.col("id") < 4, "stop " + "x" * 900).alias("x"), "id")
    with pytest.raises(Exception, match="stop"):
        ledgered(home, "run", "silver", lambda: {"t": home.replace("silver", "t", broken)})
    assert home.read("silver", "t").count() == 3
    line = home.read("ops", "executions").first()
    assert (line.statut, line.lignes) == ("echec", 0) and "x" * 900 in line.message


def test_a_hot_stay_is_split(spark, tmp_path):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        moments = spark.range(0, 120_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4000)).alias("stay_id"),
            F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
        stays = moments.groupBy("stay_id").agg(
            F.max("ts").alias("admission_ts"), F.lit(None).cast("timestamp_ntz").alias("discharge_ts"))
        stays.write.parquet(str(tmp_path / "stays"))
        stays = spark.read.parquet(str(tmp_path / "stays"))
        counted = profile.out_of_window(moments, stays)
        rows = {r.cote: (r.lignes, r.cles) for r in counted.collect()}
        keys = stays.count()
        assert rows == {"avant": (120_000 - keys, keys)}
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
