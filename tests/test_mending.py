"""CSV records read in splits against one reader that sees whole files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from lamina.sources import drops
from lamina.sources.mending import lines_of, open_after, records

VALUES = ["a", "", "plain text", 'quo"te', "com,ma", "line\nbreak", 'all "three",\nof it', "\n", '"', '""', "\n\n\"x\"\n", "é x", "ends\r\nso", " b "]


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def day(root):
    folder = root / "sejours" / "2026-08-01"
    folder.mkdir(parents=True)
    return folder


def write(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n", **options).writerows(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits_equal_whole_files(spark, small_splits, tmp_path, seed):
    rng, tmp_path = random.Random(seed), day(tmp_path)
    files = []
    for n in range(3):
        rows = [[f"{n}-{k}", rng.choice(VALUES), rng.choice(VALUES)] for k in range(60)]
        files.append((f"{tmp_path}/f{n}.csv", rows))
        write(files[-1][0], [["id", "x", "y"], *rows], quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    paths = [p for p, _ in files]
    assert lines_of(spark, paths).select("_fichier", "_bloc").distinct().count() > 20
    got = {r.id: (r.x, r.y) for r in drops.read_csv(spark, paths).collect()}
    whole = spark.read.schema("id string, x string, y string").options(**drops.CSV).csv(paths)
    want = {r.id: (r.x, r.y) for r in whole.collect()}
    assert len(got) == 180 and got == want


def test_more_than_one_task_reads_a_large_file(spark, small_splits, tmp_path):
    write(f"{tmp_path}/f.csv", [["id", "x"], *[[k, "one\ntwo" if k % 3 else "three"] for k in range(400)]])
    df = records(spark, [f"{tmp_path}/f.csv"])
    assert lines_of(spark, [f"{tmp_path}/f.csv"]).rdd.getNumPartitions() > 10
    assert df.where(~F.col("_premier")).count() == 400 and df.where("_premier").count() == 1


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('b",c', False, False), ('b"', False, False),
    ('"a""', True, False), ('"a"""', False, False), ('5" pipe,x', False, False), ('a,"b","c', True, True), ('""', False, True),
    ('"', True, False), ("", False, True), ('x""y', False, True), ('a,"', True, False), ('","', False, True),
])
def test_what_a_line_does_to_a_reader(spark, line, outside, inside):
    df = spark.createDataFrame([(line,)], "l string").select(open_after(F.col("l"), False).alias("o"), open_after(F.col("l"), True).alias("i"))
    assert tuple(df.first()) == (outside, inside)


@pytest.mark.parametrize("limit", ["16", "128m"])
def test_breaks_of_other_kinds_and_blank_lines(spark, tmp_path, limit):
    """Alike whether a file is one split or many."""
    file = str(day(tmp_path) / "f.csv")
    with open(file, "wb") as out:
        out.write(b'id,x\r\n1,"a\r\nb"\r\n\r\n2,c\r\n3,"open\r\nto the end')
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        assert [len(side) for side in drops.by_splits(spark, [file])] == ([0, 1] if limit == "16" else [1, 0])
        got = {r.id: r.x for r in drops.read_csv(spark, [file], {file: ("id", "x")}).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {"1": "a\nb", "2": "c", "3": "open\nto the end"}
