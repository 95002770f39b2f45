"""Differences between tables, cells that follow by subtraction, identifiers inside words, nested drift."""

import json

import pytest
from pyspark.sql import functions as F

from lamina.operators import reconcile, suppression
from lamina.plans import publish, quality
from lamina.sources import drops
from lamina.sources.warehouse import Warehouse

from conftest import rows


def test_one_altered_row_among_a_million_is_named(spark):
    left = spark.range(0, 1_000_000, 1, 8).select("id", (F.col("id") % 1000).alias("v"), F.lit(None).cast("string").alias("w"))
    right = left.orderBy(F.col("id").desc()).withColumn("v", F.when(F.col("id") == 777_777, F.lit(-1)).otherwise(F.col("v")))
    assert reconcile.differing_buckets(left, left.repartition(3), ["id"], ["v", "w"]) == []
    opened = reconcile.differing_buckets(left, right, ["id"], ["v", "w"])
    assert len(opened) == 1
    assert rows(reconcile.differences(left, right, ["id"], ["v", "w"])) == [(777777, -1, None, 1), (777777, 777, None, -1)]


def test_rows_lost_repeated_and_null_are_told_apart(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, ""), (None, "x")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, ""), (3, ""), (None, "x"), (None, "x")], "k int, v string")
    assert rows(reconcile.differences(left, right, ["k"], ["v"], buckets=2)) == sorted(
        [(1, "a", -1), (2, None, -1), (2, "", 1), (None, "x", 1)], key=lambda r: tuple(map(str, r)))
    assert reconcile.differences(left.limit(0), right.limit(0), ["k"], ["v"]).count() == 0


DIMS, MARGINS = ["code", "band", "sex"], [["code", "band"], ["code", "sex"], ["code"]]


def cells(spark, data):
    return spark.createDataFrame(data, "code string, band string, sex string, n int")


def told(marked):
    """Held-back cells that follow from the totals, worked out line by line."""
    data = [r.asDict() for r in marked.collect()]
    out = set()
    for margin in MARGINS:
        groups = {}
        for r in data:
            groups.setdefault(tuple(r[d] for d in margin), []).append(r)
        for group in groups.values():
            held = [r for r in group if r[suppression.HELD]]
            if held and (len(held) == 1 or sum(r["n"] for r in held) < 5):
                out |= {(r["code"], r["band"], r["sex"]) for r in held}
    return out


def test_planted_cells_are_found_and_none_remains(spark):
    data = [("A", b, s, n) for b, s, n in [("40", "F", 3), ("40", "M", 30), ("50", "F", 20), ("50", "M", 25), ("60", "F", 9), ("60", "M", 8)]]
    data += [("B", "40", "F", 4), ("B", "40", "M", 4), ("B", "50", "F", 40), ("B", "50", "M", 41)]  # 8 persons, two cells: safe in their band
    data += [("C", "40", "F", 1), ("C", "40", "M", 2)]                                             # three persons in all: the total goes too
    data += [("D", "40", "F", 50), ("D", None, "M", 60)]
    marked = suppression.small_cells(cells(spark, data), "n")
    found = suppression.recoverable(marked, DIMS, MARGINS, "n")
    assert {tuple(r)[:3] for r in found.collect()} == told(marked) >= {("A", "40", "F"), ("B", "40", "F"), ("C", "40", "F")}
    held, totals = suppression.hold_back(cells(spark, data), DIMS, MARGINS, "n")
    left = {c for c in told(held) if c[0] != "C"}
    assert left == set()
    assert {r.ligne for r in totals.collect()} == {"code=C|band=40|sex=*", "code=C|band=*|sex=F", "code=C|band=*|sex=M", "code=C|band=*|sex=*"}
    shown = {(r.code, r.band, r.sex) for r in held.where(f"{suppression.HELD} = 0").collect()}
    assert {("D", "40", "F"), ("D", None, "M")} <= shown and all(r.n >= 5 for r in held.where(f"{suppression.HELD} = 0").collect())


def test_no_cells(spark):
    held, totals = suppression.hold_back(cells(spark, []), DIMS, MARGINS, "n")
    assert held.count() == totals.count() == 0


@pytest.mark.parametrize("q", [4, 5])
def test_identifiers_inside_words(spark, q):
    texts = spark.createDataFrame([
        ("t", "1", "xIPP0000012y et MLeroy"), ("t", "2", "un Roy, une Royauté"), ("t", "3", "code9912345678a"), ("t", "4", None),
        ("t", "5", "Leroy\nLeroy"), ("t", "6", "leroy"), ("t", "7", ""), ("t", "8", "Le roy 1234567"), ("u", "1", "Leroy"), ("u", "1", "Leroy")],
        "origine string, ligne string, texte string")
    names = spark.createDataFrame([("IPP0000012",), ("Leroy",), ("Roy",), ("12345678",), (" ",), (None,), ("Leroy",)], "identifiant string")
    assert rows(quality.identity_inside(texts, names, q)) == [
        ("t", "1", 2), ("t", "2", 1), ("t", "3", 1), ("t", "5", 1), ("u", "1", 1)]
    assert quality.identity_inside(texts.limit(0), names, q).count() == 0
    assert quality.identity_inside(texts, names.limit(0), q).count() == 0


def test_the_lake_is_searched_in_all_text_columns(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path))
    people = spark.createDataFrame([("p1", "xDurandy", "R1", "lake/patients/a"), ("p2", "F", "R2", "lake/patients/b")],
                                   "patient_pseudo string, sex string, region_code string, _fichier_source string")
    home.replace("lake", "patients", people)
    nested = spark.createDataFrame([("S1", [("I10", "aDurandb")], "lake/diagnostics/a")],
                                   "stay_id string, diagnostics array<struct<code_cim10:string,type:string>>, _fichier_source string")
    home.replace("lake", "diagnostics", nested)
    names = spark.createDataFrame([("Durand",)], "identifiant string")
    assert rows(publish.lake_identity(home, names)) == [
        ("diagnostics.diagnostics", "lake/diagnostics/a", 1), ("patients.sex", "lake/patients/a", 1)]


def test_a_new_key_inside_an_element_is_reported(spark, tmp_path):
    files = {
        "a.json": json.dumps([{"stay_id": "S1", "diagnostics": [{"code_cim10": "I10", "type": "p", "praticien": {"nom": "X"}}, {"code_cim10": "E"}]}], indent=1),
        "b.json": '{"stay_id": "S2", "diagnostics": [{"code_cim10": "I10", "type": "p"}], "notes": "n"}\n{"stay_id": "S3", "diagnostics": []}\n',
        "c.json": '[{"stay_id": "S4"}]',
        "d.json": '[{"stay_id": ',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = drops.lake_drift(spark, "diagnostics", "diagnostics.json", [f"{tmp_path}/{n}" for n in files])
    assert rows(found.select(F.element_at(F.split("fichier", "/"), -1), "colonne", "ecart")) == [
        ("a.json", "diagnostics[].praticien", "retiree"), ("a.json", "diagnostics[].praticien.nom", "retiree"),
        ("b.json", "notes", "retiree"), ("c.json", "diagnostics", "manquante"), ("d.json", "", "illisible")]


def test_key_paths(spark):
    df = spark.createDataFrame([("x", '{"a": {"b": [1, 2.5]}, "c d": null}'), ("x", '{"a": {"e": "t"}}'), ("y", "{"), ("y", "")], "g string, j string")
    got = {(r.g, r.chemin, r.profondeur) for r in drops.key_paths(df, "j", "g").collect()}
    assert got == {("x", "a", 1), ("x", "a.b", 2), ("x", "a.e", 2), ("x", "c d", 1), ("y", "", 0)}
