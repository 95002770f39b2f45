"""From dropped files to published tables, replays and faults included."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lamina.plans import publish, quality, run
from lamina.sources import drops
from lamina.sources.warehouse import Warehouse, latest_lines

from conftest import at, day, rows

SALT = b"sel de test"
PATIENT_HEAD = "patient_id,nir,nom,prenom,birth_date,sex,region_code"
STAY_HEAD = "stay_id,patient_id,service_code,admission_ts,discharge_ts,admission_mode,discharge_mode"


def put(root, feed, day_, name, text):
    folder = root / feed / day_
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def put_parquet(spark, root, feed, day_, name, data, ddl):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = root / feed / day_
    folder.mkdir(parents=True, exist_ok=True)
    columns = [part.strip().split()[0] for part in ddl.split(",")]
    pq.write_table(pa.table({c: [row[i] for row in data] for i, c in enumerate(columns)}), folder / name, coerce_timestamps="us")


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    put(root, "patients", "2026-08-26", "patients.csv", f"{PATIENT_HEAD}\nIPP1,111,Durand,Léa,1950-02-03,F,75\nIPP2,222,Petit,Max,09/12/1933,M,13\n")
    # Columns moved, one added.
    put(
        root, "patients", "2026-08-27", "patients.csv",
        "sex,medecin,patient_id,nir,nom,prenom,birth_date,region_code\nM,Dr X,IPP1,111,Durand,\"Léa, Anne\",1950-02-03,75\nF,Dr Y,  ,333,Roux,Eva,1990-01-01,69\n",
    )
    put(
        root, "sejours", "2026-08-26", "sejours.csv",
        f"{STAY_HEAD}\nS1,IPP1,CARDIO,2026-08-26 08:00:00,2026-08-27 08:00:00,urgence,domicile\nS2,IPP2,URGENCES,2026-08-26 10:00:00,,programme,\n",
    )
    put(
        root, "sejours", "2026-08-27", "sejours.csv",
        f"{STAY_HEAD}\nS3,IPP1,CARDIO,2026-08-27 09:00:00,bientôt,urgence,domicile\nS4,IPP1,CARDIO,2026-08-27 10:00:00,2026-08-27 12:00:00,mutation,deces\n",
    )
    nested = [
        {"stay_id": "S1", "diagnostics": [{"code_cim10": "I10", "type": "principal", "praticien": "Dr X"}, {"code_cim10": "E11", "type": "associe"}]},
        {"stay_id": "S2", "diagnostics": []},
    ]
    put(root, "diagnostics", "2026-08-26", "diagnostics.json", json.dumps(nested, indent=1))
    put_parquet(
        spark, root, "monitoring", "2026-08-27", "monitoring.parquet",
        [("S1", at("08-26 09:00"), 80, 95, 37.25, "Dr X"), ("S1", at("08-28 09:00"), 80, 95, 37.0, "Dr X")],
        "stay_id s, ts t, heart_rate i, spo2 i, temp_c d, medecin s",
    )
    put_parquet(
        spark, root, "actes", "2026-08-29", "actes.parquet", [("S1", "A1", at("08-26 12:00")), ("S4", "A9", at("08-27 11:00"))],
        "stay_id s, code_ccam s, acte_ts t",
    )
    put(root, "referentiels", "2026-08-26", "services.csv", "service_code,service_label\nCARDIO,Ancien nom\n")
    put(root, "referentiels", "2026-08-27", "services.csv", "service_code,service_label\nCARDIO,Cardiologie\nURGENCES,Urgences\n")
    put(root, "referentiels", "2026-08-26", "cim10.csv", 'code_cim10,libelle\nI10,"HTA, essentielle"\nE11,Diabète\n')
    put(root, "referentiels", "2026-08-29", "ccam.csv", "code_ccam,libelle,tarif_euros\nA1,Acte,12.50\nA2,Autre,gratuit\n")
    put(root, "referentiels", "2026-08-29", "description_service.csv", "service_code,categorie,capacite_lits,pole\nCARDIO,Médecine,10,P1\n")
    put(root, "sejours", "2026-08-26", "notes.txt", "Durand IPP1")
    return root


@pytest.fixture(scope="module")
def warehouse(spark, source, tmp_path_factory):
    home = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")))
    run.run(home, str(source), SALT)
    return home


def bronze_volumes(home):
    return {
        feed: rows(home.read("bronze", feed).groupBy("_jour_depot").count())
        for feed in ("patients", "sejours", "diagnostics", "monitoring", "actes")
    }


def test_lake_holds_no_identity(warehouse):
    lake = warehouse.read("lake", "patients")
    assert set(lake.columns) == {"patient_pseudo", "birth_year", "sex", "region_code", "_jour_depot", "_fichier_source"}
    people = rows(lake, "_jour_depot", "birth_year", "sex", "region_code")
    assert people == [
        (day("8-26"), "", "M", "13"), (day("8-26"), "1950", "F", "75"), (day("8-27"), "1950", "M", "75"), (day("8-27"), "1990", "F", "69"),
    ]
    identifiers = warehouse.spark.createDataFrame([("IPP1",), ("Durand",), ("111",), ("1950-02-03",)], "identifiant string")
    for feed in ("patients", "sejours", "diagnostics"):
        df = warehouse.read("lake", feed).withColumn("id", F.monotonically_increasing_id())
        texts = quality.string_cells(df.select("id", *[c for c, t in df.dtypes if t == "string"]), feed, "id")
        assert quality.identity_leak(texts.where(~F.col("origine").endswith("_fichier_source")), identifiers).count() == 0


def test_nested_feed_is_flattened_and_cut(warehouse):
    lake = warehouse.read("lake", "diagnostics")
    assert lake.schema["diagnostics"].dataType.elementType.fieldNames() == ["code_cim10", "type"]
    assert rows(warehouse.read("bronze", "diagnostics"), "stay_id", "code_cim10", "type_diag") == [
        ("S1", "E11", "associe"), ("S1", "I10", "principal"),
    ]


def test_bronze_types_and_origin(warehouse):
    stays = warehouse.read("bronze", "sejours")
    assert rows(stays, "stay_id", "discharge_ts", "_discharge_illisible") == [
        ("S1", at("08-27 08:00"), 0), ("S2", None, 0), ("S3", None, 1), ("S4", at("08-27 12:00"), 0),
    ]
    assert rows(stays.select("_fichier_source").distinct()) == [
        ("lake/sejours/2026-08-26/sejours.csv",), ("lake/sejours/2026-08-27/sejours.csv",),
    ]
    readings = warehouse.read("bronze", "monitoring")
    assert sorted(float(r.temp_c) for r in readings.collect()) == [37.0, 37.3]
    assert "medecin" not in readings.columns


def test_references_come_from_their_latest_drop(warehouse):
    assert rows(warehouse.read("bronze", "ref_services"), "service_code", "service_label") == [
        ("CARDIO", "Cardiologie"), ("URGENCES", "Urgences"),
    ]
    assert rows(warehouse.read("bronze", "ref_cim10"), "libelle") == [("Diabète",), ("HTA, essentielle",)]
    assert [r.tarif_euros is None for r in warehouse.read("bronze", "ref_ccam").orderBy("code_ccam").collect()] == [False, True]


def test_silver_gold_and_register(warehouse):
    assert rows(warehouse.silver("sejours"), "stay_id") == [("S1",), ("S2",), ("S4",)]
    assert rows(warehouse.read("quarantaine", "rejets"), "source", "cle", "motif") == [
        ("monitoring", "S1@2026-08-28 09:00:00", "releve_hors_sejour"), ("patients", "(vide)", "patient_manquant"),
        ("patients", rows(warehouse.read("silver", "patients").where("birth_year IS NULL"), "patient_pseudo")[0][0], "date_naissance_illisible"),
        ("sejours", "S3", "date_illisible"),
    ]
    facts = warehouse.read("gold_pilotage", "fact_sejour")
    assert rows(facts, "stay_id", "age_au_sejour", "readmission_30j_brute") == [("S1", 76, 1), ("S2", None, 0), ("S4", 76, 0)]
    assert rows(warehouse.read("gold_pilotage", "kpi_occupation_jour"), "jour", "service_code", "nb_presents") == [
        (day("8-26"), "CARDIO", 1), (day("8-26"), "URGENCES", 1), (day("8-27"), "CARDIO", 2), (day("8-27"), "URGENCES", 1),
    ]
    for name in ("kpi_dms_service", "kpi_facturation_service", "coh_prevalence"):
        home = "gold_recherche" if name.startswith("coh") else "gold_pilotage"
        assert {"_run_id", "_built_at"} <= set(warehouse.read(home, name).columns)


def test_ledger_and_state(warehouse, source):
    lines = latest_lines(warehouse.read("ops", "executions"), 10)
    assert [r.statut for r in lines.collect()] == ["succes"] * 5
    files = drops.inventory(warehouse.spark, str(source))
    assert rows(publish.days_state(warehouse, files)) == [
        (day(d), "ingéré") for d in ("8-26", "8-27", "8-29")
    ]
    # Five tables, and a line and a duration for each of five stages; then the days.
    assert publish.state_report(warehouse).count() == 15
    assert publish.state_report(warehouse, files=files).where("section = 'jours'").count() == 3


def test_second_run_changes_nothing(warehouse, source):
    before = bronze_volumes(warehouse)
    files = drops.inventory(warehouse.spark, str(source))
    assert run.pending(warehouse, files) == []
    run.run(warehouse, str(source), SALT, everything=True)
    assert bronze_volumes(warehouse) == before


def test_bad_and_missing_days_fail_before_any_write(warehouse, source):
    before = bronze_volumes(warehouse)
    for wrong in ("2026-02-30", "hier", "2026-08-01'; x"):
        with pytest.raises(ValueError):
            run.run(warehouse, str(source), SALT, days=[wrong])
    with pytest.raises(FileNotFoundError):
        run.run(warehouse, str(source), SALT, days=["2026-07-01"])
    assert bronze_volumes(warehouse) == before
    failed = warehouse.read("ops", "executions").where("statut = 'echec'").collect()
    assert len(failed) == 1 and failed[0].message.startswith("FileNotFoundError") and failed[0].lignes == 0


def test_a_lost_partition_is_found_again(warehouse, source):
    before = bronze_volumes(warehouse)
    empty = warehouse.read("bronze", "sejours").where("false")
    warehouse.replay("bronze", "sejours", empty, [date(2026, 8, 27)])
    assert len(bronze_volumes(warehouse)["sejours"]) == 1
    files = drops.inventory(warehouse.spark, str(source))
    assert run.pending(warehouse, files) == [date(2026, 8, 27)]
    run.run(warehouse, str(source), SALT)
    assert bronze_volumes(warehouse) == before


def test_replay_leaves_other_days_alone(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path))
    data = [(i, date(2026, 8, 1 + i % 3)) for i in range(30)]
    df = spark.createDataFrame(data, "v int, _jour_depot date")
    days = [date(2026, 8, d) for d in (1, 2, 3)]
    assert home.replay("bronze", "t", df, days) == dict.fromkeys(days, 10)
    assert home.replay("bronze", "t", df.where("v = 1"), [days[1]]) == {days[1]: 1}
    assert rows(home.read("bronze", "t").groupBy("_jour_depot").count()) == [(days[0], 10), (days[1], 1), (days[2], 10)]


def test_undeclared_files_and_columns_are_reported(spark, source):
    files = drops.inventory(spark, str(source))
    known = drops.declared_files(files)
    assert rows(files.join(known, ["chemin"], "left_anti"), "fichier") == [("notes.txt",)]
    paths = [r.chemin for r in known.where("feed = 'patients'").collect()]
    drift = drops.lake_drift(spark, "patients", "patients.csv", paths)
    assert rows(drift.groupBy("colonne", "ecart").count()) == [
        ("medecin", "retiree", 1), ("nir", "retiree", 2), ("nom", "retiree", 2), ("prenom", "retiree", 2),
    ]
    short = drops.schema_drift(spark, {"f": ["a", "c"]}, {"f": ["a", "b"]})
    assert rows(short) == [("f", "b", "manquante"), ("f", "c", "retiree")]


def test_missing_declared_column_and_files_without_rows(spark, tmp_path):
    put(tmp_path, "sejours", "2026-08-26", "sejours.csv", "stay_id,patient_id\nS1,IPP1\n")
    put(tmp_path, "sejours", "2026-08-27", "sejours.csv", STAY_HEAD + "\n")
    put(tmp_path, "sejours", "2026-08-28", "sejours.csv", "")
    home = Warehouse(spark, str(tmp_path / "w"))
    files = drops.inventory(spark, str(tmp_path))
    # A file of no bytes is no drop; one with a header alone is a drop of no rows.
    assert rows(files, "jour") == [(day("8-26"),), (day("8-27"),)]
    assert run.ingest(home, files, [date(2026, 8, 26), date(2026, 8, 27)], SALT, "r")["sejours"] == 1
    only = home.read("bronze", "sejours").first()
    assert only.stay_id == "S1" and only.service_code is None and only.admission_ts is None and only._discharge_illisible == 0


def test_latest_reference_is_per_file(spark):
    files = spark.createDataFrame(
        [("a.csv", day("8-3"), "3a"), ("a.csv", day("8-1"), "1a"), ("b.csv", day("8-1"), "1b")], "fichier string, jour date, chemin string"
    )
    assert rows(drops.latest_reference(files)) == [("a.csv", day("8-3"), "3a"), ("b.csv", day("8-1"), "1b")]


def test_a_day_is_done_when_every_feed_of_it_is(spark):
    expected = spark.createDataFrame([("a", day("8-1")), ("b", day("8-1")), ("a", day("8-2")), ("b", day("8-3"))], "feed string, jour date")
    loaded = spark.createDataFrame([("a", day("8-1")), ("a", day("8-2")), ("a", day("8-3"))], "feed string, jour date")
    assert rows(drops.days_pending(expected, loaded)) == [(day("8-1"),), (day("8-3"),)]


def test_audiences(warehouse, tmp_path):
    steering = publish.audience_tables(warehouse, "pilotage")
    assert publish.audit_audience(steering) == [] and len(steering) == 18
    assert set(publish.audience_tables(warehouse, "recherche")) == {"coh_prevalence", "coh_description"}
    publish.publish_audience(warehouse, "pilotage", str(tmp_path))
    written = Warehouse(warehouse.spark, str(tmp_path)).read("pilotage", "fact_sejour")
    assert "stay_id" not in written.columns and written.count() == 3


def test_checks_hold_on_a_real_run(warehouse):
    gold = {t: warehouse.read("gold_pilotage", t) for t in ("dim_patient", "dim_service", "dim_cim10", "dim_ccam", "fact_sejour", "fact_diagnostic", "fact_releve", "fact_acte")}
    kpis = {t: warehouse.read("gold_pilotage", t) for t in quality.kpi_recomputations(gold)}
    report = quality.kpi_report(kpis, gold)
    assert report.where("divergences > 0 OR lignes_kpi <> lignes_faits").count() == 0
    assert quality.null_iff(gold).where("ok = 0").count() == 0
    broken = {r.controle for r in quality.integrity_report(gold).where("ok = 0").collect()}
    assert broken == {"fact_acte.code_ccam -> dim_ccam"}
