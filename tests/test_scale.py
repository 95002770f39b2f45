"""Feeds and drops on their own small tables: the same rows, with no more shuffles than the work needs."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.plans import kpi, quality, run, silver
from lamina.sources.warehouse import in_lots
from registry import dropped
from registry.feeds import SCHEMAS, Feeds

DAY = datetime(2001, 5, 4)


def tables(spark, folder, **given):
    """The given rows as tables; those not given are empty."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(given.get(name, []), schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return Feeds(spark, str(folder))


def line(order, part, number, supplier=1):
    return (order, part, supplier, number, 1.0, 2.0, 0.0, 0.0, "N", "F", DAY)


def coded(spark, folder):
    parts = [(k, "p", f"Brand#{brand}", "t", 1, 1.0) for k, brand in ((1, 11), (2, 12), (3, 11))]
    lines = [
        line(5, 1, 2), line(5, 2, 1), line(5, 2, 1), line(5, 3, 3),  # a line that comes twice, a brand of two parts
        line(101, 1, 1), line(None, 2, 1), line(None, 1, None), line(6, 9, 1), line(7, None, 1),
    ]
    orders = [(k, 1, "O", 1.0, DAY, "1-URGENT") for k in (5, 5, 6, 101, None)]
    return tables(spark, folder, part=parts, lineitem=lines, orders=orders)


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_codes_of_an_order_take_one_shuffle(spark, tmp_path):
    feed = coded(spark, tmp_path).bronze_diagnostics
    found = {(r.stay_id, r.code_cim10, r.type_diag) for r in feed.collect()}
    assert found == {
        ("5", "Brand#11", "associe"), ("5", "Brand#12", "principal"), ("X101", "Brand#11", "principal"),
        (None, "Brand#11", "principal"), (None, "Brand#12", "associe"),
    }
    assert feed.count() == 5
    assert shuffles(coded(spark, tmp_path / "again").bronze_diagnostics) == 1


def test_dropped_codes_are_those_of_the_feed(spark, tmp_path):
    feeds = coded(spark, tmp_path / "tables")
    root = dropped.write(feeds, str(tmp_path / "drops"))
    lines = spark.read.text(f"{root}/diagnostics/{dropped.DAY_1}").collect()
    listed = sorted((json.loads(r.value) for r in lines), key=lambda r: str(r.get("stay_id")))
    codes = [{"code_cim10": "Brand#11", "type": "associe", "praticien": "Dr X"},
             {"code_cim10": "Brand#12", "type": "principal", "praticien": "Dr X"}]
    assert [(r.get("stay_id"), r["diagnostics"]) for r in listed] == [
        ("101", []), ("5", codes), ("5", codes), ("6", []), (None, [])]


def test_no_feed_or_fact_is_shuffled_for_its_files(spark):
    rows = spark.range(20).selectExpr(
        "cast(id AS string) AS stay_id", "concat('2001', lpad(id % 12 + 1, 2, '0')) AS _lot",
        "if(id % 3 = 0, 'retenu', 'x') AS _motif", "date_add(DATE'2001-01-01', cast(id * 20 AS int)) AS date_admission")
    for made in (in_lots(rows), run.in_months("fact_sejour", rows, "r"), run.in_months("fact_diagnostic", rows, "r")):
        assert made.count() == 20
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_replaced_deliveries_are_the_same_when_repeated_stays_are_at_hand(spark):
    bronze = spark.createDataFrame(
        [(k, p, DAY.date(), f) for k, p, f in (
            ("a", "1", "f1"), ("a", "1", "f1"), ("a", "2", "f2"), ("b", "1", "f1"), (None, "1", "f1"), (None, "2", "f2"), ("c", "1", "f1"),
            ("c", "1", "f1"))],
        "stay_id string, patient_pseudo string, _jour_depot date, _fichier_source string")
    plain, told = silver.register_of_versions(bronze), silver.register_of_versions(bronze, silver.repeated_stays(bronze))
    assert sorted(map(str, plain.collect())) == sorted(map(str, told.collect()))
    assert sorted((r.cle, r.nb_lignes) for r in told.collect()) == [("a", 2), ("c", 1)]


def test_texts_are_cut_into_stretches_once(spark):
    texts = spark.createDataFrame(
        [("t", "1", "xLeroyx"), ("t", "1", "xLeroyx"), ("t", "2", "N"), ("t", None, "Leroy"), ("t", "3", "Lerox Leroyal")],
        "origine string, ligne string, texte string")
    names = spark.createDataFrame([("Leroy",), ("Leroyal",)], "identifiant string")
    found = quality.identity_inside(texts, names)
    assert sorted(map(tuple, found.collect())) == [("t", "1", 1), ("t", "3", 2)]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def rows_shuffled(plan):
    """Rows that the exchanges of an executed plan wrote, each exchange once."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return rows_shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    children = plan.children()
    return own + sum(rows_shuffled(children.apply(i)) for i in range(children.size()))


def test_candidates_are_searched_where_their_text_lies(spark):
    names = spark.createDataFrame([(f"Leroy{c}",) for c in "abcdefghijklmnopqrst"], "identifiant string")
    alike = "Leroy. " + " ".join(f"xeroy{c}" for c in "abcdefghijklmnopqrst")
    texts = spark.createDataFrame(
        [("t", str(k), alike) for k in range(50)] + [("t", "50", f"{alike} Leroyb Leroyc"), ("t", None, "Leroya")],
        "origine string, ligne string, texte string").repartition(2)
    found = quality.identity_inside(texts, names)
    assert sorted(map(tuple, found.collect())) == [("t", "50", 2)]
    # 52 texts are dealt out by the test itself; each of 50 texts is a candidate for each of 20 names.
    assert rows_shuffled(found._jdf.queryExecution().executedPlan()) < 500


@pytest.mark.parametrize("sent", [1, 2, 3])
def test_identifiers_are_sent_to_the_texts_in_parts(spark, sent):
    names = spark.createDataFrame([(n,) for n in ("Leroy", "Leroyal", "12345678", "12345", "Roy", " ", None)], "identifiant string")
    texts = spark.createDataFrame(
        [("t", "1", "xLeroyalx 912345678"), ("t", "1", "Leroy"), ("t", "2", "Roy Leroy"), ("t", "3", "Royal 1234"), ("t", None, "Leroy"),
         (None, "4", "Leroy"), (None, "4", "un Roy"), ("u", "1", "a12345b")], "origine string, ligne string, texte string")
    found = quality.identity_inside(texts, names, sent=sent)
    assert sorted(map(tuple, found.collect()), key=str) == [("t", "1", 4), ("t", "2", 2), ("u", "1", 1), (None, "4", 1)]


def test_the_total_of_acts_takes_no_shuffle_by_code_of_its_own(spark):
    acts = spark.createDataFrame([("s1", "C1"), ("s1", "C2"), ("s2", "C1"), (None, None)], "stay_id string, code_ccam string")
    codes = spark.createDataFrame([("C1", "x", 1.0)], "code_ccam string, acte string, tarif_euros double")
    found = kpi.kpi_actes_type(acts, codes)
    assert {(r.code_ccam, r.nb_actes, r.part_pct) for r in found.collect()} == {("C1", 2, 50.0), ("C2", 1, 25.0), (None, 1, 25.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange hashpartitioning\((code_ccam#\d+), \d+\)", plan))) == 2
