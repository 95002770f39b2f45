"""Indicators from states against indicators from facts, in any split, and what a state forgets."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lamina.functions.measures import partition_month
from lamina.plans import cohort, kpi, rollup, run

from conftest import rows

FIRST = date(2026, 1, 1)


@pytest.fixture(scope="module")
def gold(spark):
    def frame(data, ddl):
        return spark.createDataFrame(data, ddl)

    stays, codes, acts, readings = [], [], [], []
    for k in range(120):
        start, open_ = FIRST + timedelta(days=k * 5 % 150), k % 11 == 0
        end = None if open_ else start + timedelta(days=k % 13)
        minutes = None if open_ else 600 + 1440 * (k % 13) + k % 7
        stays.append((
            f"S{k}", f"p{k % 17}", ["URGENCES", "CARDIO", "LOST"][k % 3], start, end, "deces" if k % 9 == 0 else "domicile",
            None if minutes is None else minutes / 1440.0, int(open_), k % 2, int(not open_ and k % 9 != 0), k % 5 % 2, k % 7 % 2))
        codes.append((f"S{k}", f"p{k % 17}", f"D{k % 3}", ["URGENCES", "CARDIO", "LOST"][k % 3], start, k % 2, ["40-49", "inconnu", "50-59"][k % 3], "F"))
        acts += [(f"S{k}", f"A{(k + i) % 4}", ["URGENCES", "CARDIO", "LOST"][k % 3], start + timedelta(days=31 * i)) for i in range(1 + k % 3)]
        readings.append((["URGENCES", "CARDIO"][k % 2], start, int(k % 4 == 0)))
    facts = {
        "fact_sejour": frame(stays, "stay_id string, patient_pseudo string, service_code string, date_admission date, date_sortie date, discharge_mode string, duree_jours double, est_en_cours int, est_urgence int, est_sejour_index int, suivi_readmission_30j int, readmission_30j_brute int"),
        "fact_diagnostic": frame(codes, "stay_id string, patient_pseudo string, code_cim10 string, service_code string, date_admission date, est_principal int, tranche_age string, sexe string"),
        "fact_releve": frame(readings, "service_code string, date_mesure date, en_alerte int"),
        "fact_acte": frame(acts, "stay_id string, code_ccam string, service_code string, date_acte date"),
    }
    facts = {n: df.withColumn("_mois", partition_month(F.col(run.FACT_MONTH[n]))) for n, df in facts.items()}
    return facts | {
        "dim_patient": frame([(f"p{k}", f"R{k % 3}") for k in range(15)], "patient_pseudo string, region string"),
        "dim_service": frame([("URGENCES", "Urgences", "Aigu", 10, "P"), ("CARDIO", "Cardiologie", "Aigu", None, "P"), ("VIDE", "Vide", "Long", 3, "P")],
                             "service_code string, service string, categorie string, capacite_lits int, pole string"),
        "dim_cim10": frame([("D0", "zéro"), ("D1", "un")], "code_cim10 string, pathologie string"),
        "dim_ccam": frame([("A0", "acte", 10.5), ("A1", "autre", None)], "code_ccam string, acte string, tarif_euros double").withColumn(
            "tarif_euros", F.col("tarif_euros").cast("decimal(10,2)")),
    }


def states_of(gold, split):
    """States of each fact, made from parts that `split` tells and put together."""
    out = {}
    for fact, state in rollup.STATES.items():
        parts = [rollup.rolled_up(gold[fact].where(part), state()) for part in split(run.FACT_MONTH[fact])]
        out[fact] = parts[0]
        for part in parts[1:]:
            out[fact] = out[fact].unionByName(part)
    return rollup.Totals(out)


@pytest.mark.parametrize("split", ["whole", "days"])
def test_indicators_from_states_equal_those_from_facts(gold, split):
    cut = {"whole": lambda day: [F.lit(True)], "days": lambda day: [F.dayofmonth(day) % 3 == k for k in range(3)]}[split]
    totals = states_of(gold, cut)
    if split == "days":  # a day and service of readings is in one part, as a part holds whole days
        assert totals.states["fact_releve"].count() > 0
    want = run.indicators_of(gold)
    got = rollup.indicators(totals, gold) | rollup.cohorts(totals, gold)
    assert set(got) == set(want) == set(run.INDICATOR_SOURCES)
    for name in want:
        expected = want[name]()
        assert rows(got[name](), *expected.columns) == rows(expected), name


def test_each_fact_is_scanned_once(gold, spark, tmp_path):
    for fact, state in rollup.STATES.items():
        gold[fact].write.parquet(f"{tmp_path}/{fact}")
        plan = rollup.rolled_up(spark.read.parquet(f"{tmp_path}/{fact}"), state())._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan parquet") == 1


def test_a_person_vanishes_with_the_last_row(gold):
    """A cell of five persons is shown; without one person's only month it is not, and the rest still counts once."""
    cells = [(f"q{k}", "D0", FIRST if k else date(2026, 3, 1)) for k in range(5)] + [("q1", "D0", date(2026, 2, 1))]
    df = gold["fact_diagnostic"].sparkSession.createDataFrame(
        [(f"T{i}", p, c, "CARDIO", d, 1, "40-49", "F") for i, (p, c, d) in enumerate(cells)],
        gold["fact_diagnostic"].drop("_mois").schema).withColumn("_mois", partition_month(F.col("date_admission")))
    states = rollup.rolled_up(df, rollup.diagnosis_state())

    def shown(kept):
        totals = rollup.Totals({"fact_diagnostic": kept})
        tables = rollup.cohorts(totals, gold)
        return [rows(tables[name](), "nb_patients") for name in ("coh_prevalence", "coh_description")]

    assert shown(states) == [[(5,)], [(5,)]]
    assert shown(states.where("_mois <> '202602'")) == [[(5,)], [(5,)]]   # q1 has rows in January still
    assert shown(states.where("_mois <> '202603'")) == [[], []]


def test_quantiles_merge_exactly(spark):
    """Median and P90 of any split, from (minutes, count) rows put together."""
    values = [(datetime(2026, 1, 1).date() + timedelta(days=k % 40), (k * 7919 % 4001)) for k in range(999)]
    df = spark.createDataFrame(values, "date_admission date, m int").select(
        F.lit("X").alias("service_code"), "date_admission", (F.col("m") / 1440.0).alias("duree_jours"), F.lit(0).alias("est_en_cours"))
    whole = df.agg(F.round(F.percentile("duree_jours", 0.5), 2), F.round(F.percentile("duree_jours", 0.9), 2)).first()
    parts = None
    for k in range(4):
        part = kpi.duration_counts(df.where(F.dayofmonth("date_admission") % 4 == k), F.col("service_code"))
        parts = part if parts is None else parts.unionByName(part)
    summary = kpi.duration_summary()
    merged = parts.groupBy("service_code").agg(*[summary[n].alias(n) for n in ("mediane_jours", "p90_jours")]).first()
    assert (merged.mediane_jours, merged.p90_jours) == tuple(whole)
    # Taking a part away again is the histogram of the others.
    less = parts.unionByName(kpi.duration_counts(df.where(F.dayofmonth("date_admission") % 4 == 3), F.col("service_code")).withColumn("n", -F.col("n")))
    left = less.groupBy("service_code", "est_en_cours", "minutes").agg(F.sum("n").alias("n")).where("n > 0")
    rest = df.where(F.dayofmonth("date_admission") % 4 != 3).agg(F.round(F.percentile("duree_jours", 0.5), 2)).first()
    assert left.groupBy("service_code").agg(summary["mediane_jours"].alias("m")).first().m == rest[0]


def test_cohort_cells_of_unknown_age_are_left_out(gold):
    totals = states_of(gold, lambda day: [F.lit(True)])
    bands = {r[0] for r in rollup.cohorts(totals, gold)["coh_description"]().select("tranche_age").collect()}
    assert "inconnu" not in bands and bands <= {"40-49", "50-59"} and cohort.CELLS[0] == "code_cim10"
