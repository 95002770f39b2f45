"""Injected faults and the fate of each row."""

import pytest
from pyspark.sql import functions as F

from lamina.contract import MOTIFS
from lamina.operators.rules import kept
from lamina.plans import cohort, kpi, quality, silver, star

from conftest import at, day, rows

D = day("8-28")
ORIGIN = (D, "lake/x")

STAYS = [
    ("FEN", "P1", "CARDIO", at("08-28 08:00"), at("08-28 12:00"), 0, "urgence", "domicile"),
    ("OUVERT", "P2", "CARDIO", at("08-27 08:00"), None, 0, "programme", ""),
    ("ADM_NULL", "P1", "CARDIO", None, None, 0, "urgence", ""),
    ("SORTIE_KO", "P1", "CARDIO", at("08-28 08:00"), None, 1, "urgence", ""),
    ("SANS_PAT", "", "CARDIO", at("08-28 08:00"), at("08-28 12:00"), 0, "urgence", "domicile"),
    ("INVERSE", "P3", "XXX", at("08-28 12:00"), at("08-28 08:00"), 0, "urgence", "domicile"),
    ("SERVICE_KO", "P3", "XXX", at("08-28 08:00"), at("08-28 09:30"), 0, "mutation", "deces"),
]

PATIENTS = [
    ("P1", 1950, "M", "75", day("8-26"), "f1"), ("P1", None, "F", "75", day("8-27"), "f2"),
    ("P2", 1980, "X", "13", D, "f3"), ("P3", 1990, "  f  ", "69", D, "f3"),
    ("", 1970, "M", "69", day("8-26"), "f1"), ("", 1971, "M", "69", D, "f3"),
]

DIAGNOSES = [
    ("FEN", "I10", "principal"), ("FEN", "ZZZ", "associe"), ("INVERSE", "I10", "principal"),
    ("ADM_NULL", "I10", "principal"), ("SANS_PAT", "I10", "principal"), ("ABSENT", "I10", "principal"),
]

READINGS = [
    ("FEN", at("08-28 07:00"), 80, 95, 37.0), ("FEN", at("08-28 13:00"), 80, 95, 37.0),
    ("FEN", at("08-28 08:00"), 80, 95, 37.0), ("FEN", at("08-28 12:00"), 120, 95, 37.0),
    ("FEN", at("08-28 10:00"), 0, 0, 37.0), ("FEN", at("08-28 10:30"), None, 95, 37.0),
    ("INVERSE", at("08-28 01:00"), 80, 95, 37.0), ("SANS_PAT", at("08-28 09:00"), 80, 95, 37.0),
    ("ABSENT", at("08-28 09:00"), 80, 95, 37.0), ("ABSENT", at("08-28 09:00"), 500, 120, 37.0),
    ("OUVERT", at("08-30 09:00"), 80, 91, 39.0), ("ADM_NULL", at("08-28 09:00"), 80, 95, 37.0),
]

ACTS = [
    ("FEN", "A1", at("08-28 07:00")), ("FEN", "A1", at("08-28 13:00")), ("FEN", "INCONNU", at("08-28 09:00")),
    ("FEN", "A1", at("08-28 09:00")), ("ABSENT", "A1", at("08-28 09:00")), ("SANS_PAT", "A1", at("08-28 09:00")),
    ("INVERSE", "A1", at("08-28 09:00")),
]


@pytest.fixture(scope="module")
def built(spark):
    technical = ", _jour_depot date, _fichier_source string"

    def table(data, ddl):
        return spark.createDataFrame([(*row, *ORIGIN) for row in data], ddl + technical)

    bronze = {
        "patients": spark.createDataFrame(
            PATIENTS, "patient_pseudo string, birth_year int, sex string, region_code string" + technical
        ),
        "sejours": table(
            STAYS,
            "stay_id string, patient_pseudo string, service_code string, admission_ts timestamp_ntz,"
            " discharge_ts timestamp_ntz, _discharge_illisible int, admission_mode string, discharge_mode string",
        ),
        "diagnostics": table(DIAGNOSES, "stay_id string, code_cim10 string, type_diag string"),
        "monitoring": table(
            READINGS, "stay_id string, ts timestamp_ntz, heart_rate int, spo2 int, temp_c double"
        ).withColumn("temp_c", F.col("temp_c").cast("decimal(4,1)")),
        "actes": table(ACTS, "stay_id string, code_ccam string, acte_ts timestamp_ntz"),
    }
    refs = {
        "ref_services": spark.createDataFrame([("CARDIO", "Cardiologie"), ("NEURO", "Neurologie")], "service_code string, service_label string"),
        "ref_cim10": spark.createDataFrame([("I10", "HTA")], "code_cim10 string, libelle string"),
        "ref_ccam": spark.createDataFrame([("A1", "Acte")], "code_ccam string, libelle string").withColumn(
            "tarif_euros", F.lit("12.50").cast("decimal(10,2)")
        ),
        "ref_description_service": spark.createDataFrame(
            [("CARDIO", "Médecine", 10, "P1")], "service_code string, categorie string, capacite_lits int, pole string"
        ),
    }
    retained = silver.retained_patients(bronze["patients"])
    stays = silver.judge_stays(silver.retained_stays(bronze["sejours"]), refs["ref_services"])
    lookup = silver.stay_lookup(stays)
    judged = {
        "sejours": stays,
        "diagnostics": silver.judge_diagnostics(bronze["diagnostics"], lookup, refs["ref_cim10"]),
        "monitoring": silver.judge_readings(bronze["monitoring"], lookup),
        "actes": silver.judge_acts(bronze["actes"], lookup, refs["ref_ccam"]),
    }
    register = quality.stacked(
        [
            silver.unidentified_patients(bronze["patients"]), silver.corrected_patients(retained),
            silver.replaced_stays(bronze["sejours"]), *[silver.feed_rejects(f, j) for f, j in judged.items()],
        ]
    )
    tables = {feed: kept(j) for feed, j in judged.items()} | {"patients": silver.silver_patients(retained)}
    return {"bronze": bronze, "refs": refs, "judged": judged, "silver": tables, "rejets": register}


def motifs(built, source):
    return rows(built["rejets"].where(F.col("source") == source), "cle", "motif", "action")


def test_patients(built):
    assert rows(built["silver"]["patients"], "patient_pseudo", "birth_year", "sex") == [
        ("P1", None, "F"), ("P2", 1980, "inconnu"), ("P3", 1990, "F"),
    ]
    assert motifs(built, "patients") == [
        ("(vide)", "patient_manquant", "ecarte"), ("P1", "date_naissance_illisible", "corrige"),
        ("P2", "sexe_non_normalise", "corrige"),
    ]
    summary = built["rejets"].where("cle = '(vide)'").first()
    assert summary.nb_lignes == 2 and summary.detail.startswith("2 ligne(s)") and summary._jour_depot == D


def test_no_summary_row_when_every_patient_is_known(built):
    known = built["bronze"]["patients"].where("patient_pseudo <> ''")
    assert silver.unidentified_patients(known).count() == 0


def test_stays(built):
    assert rows(built["silver"]["sejours"], "stay_id", "service_label", "discharge_mode", "duree_jours", "est_en_cours") == [
        ("FEN", "Cardiologie", "domicile", 4 / 24, 0), ("OUVERT", "Cardiologie", "inconnu", None, 1),
        ("SERVICE_KO", "inconnu", "deces", 1.5 / 24, 0),
    ]
    assert motifs(built, "sejours") == [
        ("ADM_NULL", "date_illisible", "ecarte"), ("INVERSE", "incoherence_temporelle", "ecarte"),
        ("SANS_PAT", "patient_manquant", "ecarte"), ("SORTIE_KO", "date_illisible", "ecarte"),
    ]
    details = {r.cle: r.detail for r in built["rejets"].where("source = 'sejours'").collect()}
    assert "admission" in details["ADM_NULL"] and "sortie" in details["SORTIE_KO"]
    assert details["INVERSE"] == "admission=2026-08-28 12:00:00 sortie=2026-08-28 08:00:00"


def test_diagnoses(built):
    assert rows(built["silver"]["diagnostics"], "stay_id", "code_cim10", "libelle", "sejour_coherent") == [
        ("ADM_NULL", "I10", "HTA", 0), ("FEN", "I10", "HTA", 1), ("FEN", "ZZZ", "inconnu", 1), ("INVERSE", "I10", "HTA", 0),
    ]
    assert motifs(built, "diagnostics") == [
        ("ABSENT/I10", "sejour_inconnu", "ecarte"), ("SANS_PAT/I10", "sejour_ecarte", "ecarte"),
    ]


def test_readings(built):
    assert rows(built["silver"]["monitoring"], "stay_id", "ts") == sorted(
        [
            ("ADM_NULL", at("08-28 09:00")), ("FEN", at("08-28 08:00")), ("FEN", at("08-28 12:00")),
            ("INVERSE", at("08-28 01:00")), ("OUVERT", at("08-30 09:00")),
        ],
        key=lambda r: tuple(map(str, r)),
    )
    got = [(c, m) for c, m, _ in motifs(built, "monitoring")]
    assert got == [
        ("ABSENT@2026-08-28 09:00:00", "capteur_hors_plage"), ("ABSENT@2026-08-28 09:00:00", "sejour_inconnu"),
        ("FEN@2026-08-28 07:00:00", "releve_hors_sejour"), ("FEN@2026-08-28 10:00:00", "capteur_hors_plage"),
        ("FEN@2026-08-28 10:30:00", "capteur_hors_plage"), ("FEN@2026-08-28 13:00:00", "releve_hors_sejour"),
        ("SANS_PAT@2026-08-28 09:00:00", "sejour_ecarte"),
    ]
    details = {r.cle: r.detail for r in built["rejets"].where("motif = 'releve_hors_sejour'").collect()}
    assert "antérieur à l'admission=2026-08-28 08:00:00" in details["FEN@2026-08-28 07:00:00"]
    assert "postérieur à la sortie=2026-08-28 12:00:00" in details["FEN@2026-08-28 13:00:00"]


def test_acts(built):
    assert rows(built["silver"]["actes"], "stay_id", "code_ccam", "libelle", "sejour_coherent") == [
        ("FEN", "A1", "Acte", 1), ("FEN", "INCONNU", "inconnu", 1), ("INVERSE", "A1", "Acte", 0),
    ]
    assert sorted(m for _, m, _ in motifs(built, "actes")) == [
        "acte_hors_sejour", "acte_hors_sejour", "sejour_ecarte", "sejour_inconnu",
    ]


def test_conservation_and_known_motifs(built):
    children = {f: built["silver"][f] for f in ("sejours", "diagnostics", "monitoring", "actes")}
    report = quality.conservation(built["bronze"], children, built["rejets"])
    assert report.count() == 4 and report.where("ok = 0").count() == 0
    assert quality.unknown_motifs(built["rejets"]).count() == 0
    seen = {(r.source, r.motif) for r in built["rejets"].select("source", "motif").distinct().collect()}
    declared = {(s, m) for s, ms in MOTIFS.items() for m in ms}
    assert declared - seen == {("sejours", "version_remplacee")}


def test_residuals_are_empty_but_for_unresolved_codes(built):
    report = quality.rule_residuals(built["bronze"]["sejours"], built["silver"], built["rejets"])
    assert {r.controle for r in report.where("ok = 0").collect()} == {
        "silver.sejours : service non résolu", "silver.diagnostics : code non résolu", "silver.actes : code non résolu",
    }


def test_star_and_indicators(built):
    patients = star.dim_patient(built["silver"]["patients"])
    services = star.dim_service(built["refs"]["ref_services"], built["refs"]["ref_description_service"])
    assert rows(services, "service_code", "categorie", "capacite_lits") == [
        ("CARDIO", "Médecine", 10), ("NEURO", "non renseigné", None),
    ]
    facts = star.fact_sejour(built["silver"]["sejours"], patients)
    assert rows(facts, "stay_id", "age_au_sejour", "tranche_age", "est_urgence", "est_sejour_index") == [
        ("FEN", None, "inconnu", 1, 1), ("OUVERT", 46, "40-49", 0, 0), ("SERVICE_KO", 36, "30-39", 0, 0),
    ]
    diagnoses = star.fact_diagnostic(built["silver"]["diagnostics"], patients)
    assert rows(diagnoses.where("stay_id = 'ADM_NULL'"), "date_admission", "age_au_sejour", "tranche_age", "sexe") == [
        (None, None, "inconnu", "F")
    ]
    readings = star.fact_releve(built["silver"]["monitoring"])
    assert rows(readings.where("en_alerte = 1"), "stay_id", "alerte_fc", "alerte_spo2", "alerte_temp") == [
        ("FEN", 1, 0, 0), ("OUVERT", 0, 1, 1),
    ]
    acts = star.fact_acte(built["silver"]["actes"])
    assert "patient_pseudo" not in acts.columns
    # The unknown service drops out of its indicators, the undescribed one stays.
    assert rows(kpi.kpi_dms_service(facts, services), "service_code", "nb_sejours_clos") == [("CARDIO", 1)]
    assert rows(kpi.kpi_actes_service(acts, facts, services), "service_code", "nb_actes", "nb_sejours") == [
        ("CARDIO", 2, 2), ("NEURO", 0, 0),
    ]
    assert rows(kpi.kpi_densite_actes_lit(acts, services), "service_code", "actes_par_lit") == [("CARDIO", 0.2)]
    assert rows(kpi.kpi_actes_type(acts, star.dim_ccam(built["refs"]["ref_ccam"])), "code_ccam", "acte", "nb_actes") == [
        ("A1", "Acte", 2), ("INCONNU", "inconnu", 1),
    ]
    billed = kpi.kpi_facturation_service(acts, services, star.dim_ccam(built["refs"]["ref_ccam"])).first()
    assert (billed.nb_actes, billed.nb_actes_sans_tarif, float(billed.montant_euros), billed.montant_moyen_euros) == (2, 1, 12.5, 12.5)
    urgent = kpi.kpi_urgences_jour(facts, "CARDIO")
    assert rows(urgent, "jour", "nb_passages_urgences", "nb_encore_presents", "duree_moy_heures", "nb_sejours") == [
        (day("8-27"), 1, 1, 0.0, 1), (D, 1, 0, 4.0, 2),
    ]


@pytest.mark.parametrize(("size", "present"), [(4, False), (5, True)])
def test_small_cohorts_do_not_leave(spark, size, present):
    data = [(f"P{i}", f"S{i}", "C1", "40-49", "F", 1) for i in range(size)] + [("P0", "S9", "C1", "40-49", "F", 0)]
    facts = spark.createDataFrame(
        data, "patient_pseudo string, stay_id string, code_cim10 string, tranche_age string, sexe string, est_principal int"
    )
    codes = spark.createDataFrame([("C1", "Mucoviscidose")], "code_cim10 string, pathologie string")
    prevalence, cells = cohort.coh_prevalence(facts, codes), cohort.coh_description(facts, codes)
    assert rows(prevalence, "nb_patients", "nb_patients_principal", "nb_sejours") == ([(5, 5, 6)] if present else [])
    assert rows(cells, "nb_patients") == ([(5,)] if present else [])
    assert quality.cohort_min({"coh_prevalence": prevalence, "coh_description": cells}).where("ok = 0").count() == 0


def test_a_redelivered_stay_is_one_stay(spark, built):
    again = built["bronze"]["sejours"].where("stay_id = 'FEN'")
    later = again.withColumn("_jour_depot", F.date_add("_jour_depot", 1)).withColumn("service_code", F.lit("NEURO"))
    bronze = built["bronze"]["sejours"].unionByName(later).unionByName(again).unionByName(again)
    judged = silver.judge_stays(silver.retained_stays(bronze), built["refs"]["ref_services"])
    assert rows(kept(judged).where("stay_id = 'FEN'"), "service_code") == [("NEURO",)]
    replaced = silver.replaced_stays(bronze)
    assert rows(replaced, "cle", "motif", "nb_lignes") == [("FEN", "version_remplacee", 3)]
    register = silver.feed_rejects("sejours", judged).unionByName(replaced)
    report = quality.conservation({"sejours": bronze}, {"sejours": kept(judged)}, register)
    assert report.first().ok == 1
    readings = silver.judge_readings(built["bronze"]["monitoring"], silver.stay_lookup(judged))
    assert readings.count() == len(READINGS)


def test_kpi_consistency_sees_what_changed(spark):
    kpis = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 2), ("d", 1.0, 2)], "k string, mesure double, effectif bigint")
    facts = spark.createDataFrame([("a", 1.004, 2), ("b", 1.2, 2), ("c", 1.0, 2)], "k string, mesure double, effectif bigint")
    assert tuple(quality.kpi_consistency(kpis, facts, ["k"], "t").first()) == ("t", 3, 3, 1)


def test_conformity_tolerates_a_tenth(spark):
    schema = "indicateur string, cle string, valeur double"
    expected = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 1.0), ("i", "c", 1.0), ("i", "d", None)], schema)
    observed = spark.createDataFrame([("i", "a", 1.09), ("i", "b", 1.2)], schema)
    assert rows(quality.conformity(observed, expected), "cle", "ok") == [("a", 1), ("b", 0), ("c", 0), ("d", 1)]


def test_identity_leak_finds_whole_names(spark):
    texts = spark.createDataFrame(
        [("t", "1", "vu Jean-Paul Le Gall, né le 1933-12-09"), ("t", "2", "Legall et 1933"), ("t", "3", "")],
        "origine string, ligne string, texte string",
    )
    names = spark.createDataFrame([("Le Gall",), ("Jean-Paul",), ("1933-12-09",), ("",)], "identifiant string")
    assert rows(quality.identity_leak(texts, names, longest=2), "ligne", "nb_identifiants") == [("1", 3)]
    assert rows(quality.identity_leak(texts, names), "ligne", "nb_identifiants") == [("1", 2)]


def test_pseudonym_collisions_and_log_scan(spark):
    pairs = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "a"), ("3", "b"), ("4", ""), ("5", "")], "identifiant string, pseudo string")
    assert rows(quality.pseudo_collisions(pairs)) == [("a", 2)]
    lines = spark.createDataFrame(
        [("run abcdef012345",), ("stay 0123456789abcdef lost",), ("IPP0000012",), ("nir 123456789012345.",), ("1234567890123456789",)],
        "texte string",
    )
    assert quality.personal_data(lines).count() == 3


def test_column_audit(spark):
    found = quality.column_audit(
        spark,
        {
            "silver.sejours": ["stay_id", "age_au_sejour"], "gold_recherche.c": ["region", "nb"], "gold_pilotage.f": ["patient_pseudo", "nom"],
        },
    )
    assert rows(found, "table", "colonne") == [
        ("gold_pilotage.f", "nom"), ("gold_recherche.c", "region"), ("silver.sejours", "age_au_sejour"),
    ]


def test_provenance_audit(spark):
    df = spark.createDataFrame([("a", "f"), ("b", "")], "x string, _fichier_source string")
    assert rows(quality.provenance_audit(df, "t", ["_fichier_source", "_run_id"])) == [
        ("t", "_fichier_source", 1, 1), ("t", "_run_id", 0, 2),
    ]
