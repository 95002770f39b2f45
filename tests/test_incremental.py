"""Updates against full builds, atomic versions, and what an update leaves untouched."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lamina.contract import BRONZE, REFERENCES
from lamina.operators.windows import returns_within, starts_told, time_slot
from lamina.plans import incremental, run
from lamina.sources.bronze import conform
from lamina.sources import folders
from lamina.sources.warehouse import LOT, Warehouse, changed_rows

from conftest import rows

STAMPS = ("_built_at", "_run_id", "_rejected_at", "_ingested_at")
TABLES = [("silver", t) for t in ("patients", "sejours", *run.CHILDREN)] + [("quarantaine", "rejets")]
FACTS = list(run.FACT_SOURCE)
INDICATORS = [
    "kpi_dms_service", "kpi_readmission_service", "kpi_occupation_jour", "kpi_origine_service", "kpi_actes_type",
]
START = datetime(2026, 1, 1)


def at(day, hour=8):
    return START + timedelta(days=day, hours=hour)


def bronze(spark, feed, data):
    """Rows of one feed; each ends with its delivery day, counted from the start."""
    names = [f.split()[0] for f in BRONZE[feed].replace("decimal(4,1)", "decimal").split(", ")][: -4]
    body = spark.createDataFrame(
        [(*r[:-1], (START + timedelta(days=r[-1])).date(), f"lake/{feed}/{r[-1]}") for r in data],
        ", ".join(f"{n} {t}" for n, t in [*[(n, KINDS.get(n, "string")) for n in names],
                                          ("_jour_depot", "date"), ("_fichier_source", "string")]))
    return conform(body, BRONZE[feed])


KINDS = {
    "birth_year": "int", "admission_ts": "timestamp_ntz", "discharge_ts": "timestamp_ntz", "_discharge_illisible": "int",
    "ts": "timestamp_ntz", "heart_rate": "int", "spo2": "int", "temp_c": "int", "acte_ts": "timestamp_ntz",
}


def stay(nr, patient, start, end, day, service="CARDIO", mode="domicile", bad=0):
    return (f"S{nr}", patient, service, start, end, bad, "urgence", mode, day)


def first_days():
    """Forty stays of nine patients over three months, with children, all delivered on the day of admission."""
    stays, diagnoses, readings, acts = [], [], [], []
    for k in range(40):
        begun, length = 2 * k, 1 + k % 9
        stays.append(stay(k, f"p{k % 9}", at(begun), at(begun + length, 12), begun, ["CARDIO", "URGENCES", "X"][k % 3]))
        diagnoses += [(f"S{k}", "I10", "principal", begun), (f"S{k}", ["E11", "ZZ"][k % 2], "associe", begun)]
        readings += [(f"S{k}", at(begun + i, 10), 60 + k, 80 + k % 20, None if k == 7 else 37 + k % 3, begun + i) for i in range(3)]
        acts += [(f"S{k}", f"A{k % 4}", at(begun + 1), begun + 1)]
    stays += [stay(90, "", at(3), at(4), 3), stay(91, "p1", None, at(4), 3), stay(92, "p2", at(9), at(5), 9)]
    diagnoses += [("S90", "I10", "principal", 3), ("S777", "I10", "principal", 4), (None, "I10", "principal", 4)]
    acts += [("S777", "A1", at(50), 50), ("S92", "A1", at(9), 9)]
    people = [(f"p{k}", None if k == 3 else 1940 + 5 * k, "MFx"[k % 3], "R1", 0) for k in range(9)] + [(" ", 1950, "M", "R1", 0)]
    return {"patients": people, "sejours": stays, "diagnostics": diagnoses, "monitoring": readings, "actes": acts}


def references(spark):
    text = {
        "ref_services": [("CARDIO", "Cardiologie"), ("URGENCES", "Urgences")], "ref_cim10": [("I10", "HTA"), ("E11", "Diabète")],
        "ref_ccam": [("A0", "Acte 0", "10"), ("A1", "Acte 1", "20.5"), ("A2", "Acte 2", None)],
        "ref_description_service": [("CARDIO", "Médecine", "10", "P1")],
    }
    return {
        name: conform(spark.createDataFrame(text[name], ", ".join(
            f"{c.split()[0]} string" for c in REFERENCES[name].replace("decimal(10,2)", "decimal").split(", ")[:-3])), REFERENCES[name])
        for name in text
    }


def deliver(spark, homes, feed, data, days=None):
    """Replay days of a feed in several warehouses."""
    days = sorted({r[-1] for r in data}) if days is None else days
    wanted = [(START + timedelta(days=d)).date() for d in days]
    for home in homes:
        home.replay("bronze", feed, bronze(spark, feed, data), wanted)


def content(home, layer, table):
    df = home.read(layer, table)
    return rows(df.drop(*STAMPS))


def equal(updated, full):
    names = [*TABLES, *(("gold_pilotage", t) for t in (*FACTS, *INDICATORS)), ("gold_recherche", "coh_prevalence")]
    for name in names:
        assert content(updated, *name) == content(full, *name), name


def build(home, limits=None):
    frames = run.bronze_tables(home)
    run.build_silver(home, frames, "full")
    run.build_gold(home, frames, "full")


def update(home):
    frames = run.bronze_tables(home)
    made = incremental.update_silver(home, frames, "again")
    gold = incremental.update_gold(home, frames, "again")
    assert made is not None and gold is not None
    return made | gold


def files(home, layer, table):
    return set(home.snapshot(layer, table).parts)


@pytest.fixture(scope="module")
def homes(spark, tmp_path_factory):
    pair = [Warehouse(spark, str(tmp_path_factory.mktemp(n))) for n in ("updated", "full")]
    for home in pair:
        for name, df in references(spark).items():
            home.replace("bronze", name, df)
    for feed, data in first_days().items():
        deliver(spark, pair, feed, data)
    build(pair[0])
    return pair


def test_update_equals_full_build(spark, homes):
    updated, full = homes
    data = first_days()
    assert not any(n for t, n in update(updated).items() if t in (*run.CHILDREN, "sejours", "rejets", *FACTS))

    # A new day: a late stay of long ago (with an orphan that now finds it), a stay delivered again, children.
    before = {name: files(updated, *name) for name in [("gold_pilotage", f) for f in FACTS] + [("silver", "sejours")]}
    late = [stay(777, "p0", at(45), at(52), 95), stay(4, "p4", at(8), at(30), 95, mode="deces"), stay(96, "p99", at(94), None, 95)]
    deliver(spark, homes, "sejours", late)
    deliver(spark, homes, "monitoring", [("S96", at(95, 9), 130, 99, 36, 95), ("S4", at(28), 70, 90, 39, 95)])
    counts = update(updated)
    build(full)
    equal(updated, full)
    months = {m for name in before for m in (p.rpartition("=")[2] for p in files(updated, *name) - before[name])}
    assert months == {"202601", "202602", "202604"} and counts["fact_sejour"] > 0
    assert before["gold_pilotage", "fact_sejour"] & files(updated, "gold_pilotage", "fact_sejour")  # March stayed as it was

    # A day replayed with other rows, one emptied, and a patient who is another.
    deliver(spark, homes, "sejours", [r for r in data["sejours"] if r[-1] == 4] + [stay(200, "p2", at(4), at(5), 4)])
    deliver(spark, homes, "sejours", [], days=[10])
    deliver(spark, homes, "actes", [], days=[21])
    deliver(spark, homes, "diagnostics", [("S3", "E11", "principal", 6)])
    deliver(spark, homes, "patients", [("p1", 1999, "F", "R2", 96)])
    update(updated)
    build(full)
    equal(updated, full)

    # Nothing new but other stamps and the same rows again.
    deliver(spark, homes, "sejours", late)
    assert update(updated)["fact_sejour"] == 0
    equal(updated, full)


def test_other_labels_ask_for_a_full_build(spark, homes):
    updated = homes[0]
    frames = run.bronze_tables(updated)
    updated.replace("bronze", "ref_services", references(spark)["ref_services"])
    assert incremental.update_silver(updated, run.bronze_tables(updated), "r") is not None  # the same labels, written again
    renamed = references(spark)["ref_services"].withColumn("service_label", F.upper("service_label"))
    updated.replace("bronze", "ref_services", renamed)
    assert incremental.update_silver(updated, run.bronze_tables(updated), "r") is None
    assert set(frames) == {*BRONZE, *REFERENCES}


def test_other_limits_ask_for_a_full_build(homes):
    updated = homes[0]
    limits = run.AlertThresholds(fc_haute=120)
    assert incremental.update_fact(updated, "fact_releve", "r", limits) is None


def test_only_needed_admissions_are_read(spark, homes):
    updated = homes[0]
    february = updated.silver("sejours", lots=True).where(F.col(LOT) == "202602").where("discharge_ts IS NOT NULL")
    found, slots = incremental.admissions_for(updated, february)
    ends = [r[0] for r in february.select(time_slot(F.col("discharge_ts"), 30)).collect()]
    assert slots == sorted({s + k for s in ends for k in (0, 1)})
    opened = {f.split(f"{LOT}=")[1].split("/")[0] for f in found.inputFiles()}
    assert "202602" in opened and "202601" not in opened or min(slots) * 30 <= 20484 + 31


def test_a_start_answers_its_slot_and_the_one_before(spark):
    """Every interval whose answer a new start changes lies where `starts_told` says."""
    first = datetime(2026, 1, 1)
    data = [(k, f"e{k % 3}", first + timedelta(days=7 * k % 200), first + timedelta(days=7 * k % 200 + k % 50, hours=k)) for k in range(60)]
    df = spark.createDataFrame(data, "id int, who string, a timestamp_ntz, b timestamp_ntz")
    old = {r.id: r.back for r in returns_within(df, "who", "a", "b", 30, "back").collect()}
    alone = next(r for r in data if not old[r[0]])
    extra = spark.createDataFrame([(99, alone[1], alone[3] + timedelta(days=29), None)], df.schema)
    new = {r.id: r.back for r in returns_within(df.union(extra), "who", "a", "b", 30, "back").collect()}
    told = {tuple(r) for r in starts_told(extra, "who", "a", 30).collect()}
    slots = {r.id: (r.who, r.s) for r in df.withColumn("s", time_slot(F.col("b"), 30)).collect()}
    moved = {i for i in old if old[i] != new[i]}
    assert moved and all(slots[i] in told for i in moved)
    part = df.where("id % 4 = 0")
    asked = {s + k for i, (_, s) in slots.items() if i % 4 == 0 for k in (0, 1)}
    near = df.where(time_slot(F.col("a"), 30).isin(sorted(asked)))
    assert {r.id: r.back for r in returns_within(part, "who", "a", "b", 30, "back", near).collect()} == {
        i: v for i, v in old.items() if i % 4 == 0}


# ---- versions


def numbers(home, table="t"):
    return rows(home.read("silver", table))


def test_a_killed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    home = Warehouse(spark, str(tmp_path))
    days = [date(2026, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([(k, days[k % 3]) for k in range(9)], "v int, _jour_depot date")
    home.replay("silver", "t", df, days)
    before = numbers(home)
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):  # data is written, its line is not
            home.replay("silver", "t", df.withColumn("v", F.col("v") + 100), days[:2])
    assert numbers(home) == before and numbers(Warehouse(spark, str(tmp_path))) == before
    (tmp_path / "silver/t/log/v=0000000002/_temporary").mkdir(parents=True)  # killed while the line was written
    assert numbers(home) == before
    broken = df.select(F.assert_true(F.col("v") < 5, "stop").isNull().cast("int").alias("v"), "_jour_depot")
    with pytest.raises(Exception, match="stop"):
        home.replay("silver", "t", broken, days)
    assert numbers(home) == before
    assert home.replay("silver", "t", df.where("v < 2"), days[:2]) == {days[0]: 1, days[1]: 1}
    assert numbers(home) == sorted([(0, days[0]), (1, days[1]), (2, days[2]), (5, days[2]), (8, days[2])])


def test_versions_without_a_file_system_at_hand(spark, tmp_path, monkeypatch):
    """As under Spark Connect: lines are listed and written by Spark itself, and mean the same."""
    home = Warehouse(spark, str(tmp_path / "catalog log"))
    df = spark.createDataFrame([(k, date(2026, 1, 1 + k % 2)) for k in range(4)], "v int, _jour_depot date")
    home.replace("silver", "t", spark.range(2))
    with monkeypatch.context() as patch:
        patch.setattr(folders, "hadoop", lambda *a: None)
        other = Warehouse(spark, home.root)
        assert other.version("silver", "t") == 1 and other.version("silver", "u") == 0 and not other.has("silver", "u")
        other.replace("silver", "t", spark.range(5))
        assert other.read("silver", "t").count() == 5 and other.version("silver", "t") == 2
        other.replay("bronze", "d", df, [date(2026, 1, 1), date(2026, 1, 2)])
        other.replay("bronze", "d", df.limit(0), [date(2026, 1, 2)])
    assert home.read("silver", "t").count() == 5
    assert rows(home.read("bronze", "d")) == [(0, date(2026, 1, 1)), (2, date(2026, 1, 1))]


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path))
    home.replace("silver", "t", spark.range(3))
    opened = home.read("silver", "t")
    home.replace("silver", "t", spark.range(10))
    assert opened.count() == 3 and home.read("silver", "t").count() == 10
    assert Warehouse(spark, str(tmp_path)).version("silver", "t") == 2


def test_sweep_removes_what_no_version_needs(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path))
    df = spark.createDataFrame([(k, k % 3) for k in range(9)], "v int, k int")
    home.replace("silver", "t", df, "k")
    home.replace("gold", "made", spark.range(1), sources={"silver/t": 1})
    home.renew("silver", "t", df.where("k = 1").withColumn("v", F.lit(7)), "k", ["1"])
    home.renew("silver", "t", df.where("k = 2"), "k", ["2"])
    home.renew("silver", "t", df.where("k = 2").limit(1), "k", ["2"])
    after = numbers(home)
    assert home.sweep() == [] and numbers(home) == after          # all too young
    removed = home.sweep(older_than_s=-5)
    assert len([r for r in removed if "/_version=" in r]) == 1 and len([r for r in removed if "/v=" in r]) == 2
    assert numbers(home) == after
    gone, come = home.changes("silver", "t", 1)                   # what `made` was made from is still there
    assert gone.count() == 6 and come.count() == 4
    home.replace("gold", "made", spark.range(1), sources={"silver/t": 4})
    home.sweep(older_than_s=-5)
    assert home.changes("silver", "t", 1) is None and numbers(home) == after
    assert rows(changed_rows(df, df.where("v <> 3"), ["v"])) == [(3, -1)]


def test_renewing_values(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path))
    df = spark.createDataFrame([(k, f"k{k % 3}") for k in range(9)], "v int, k string")
    home.replace("silver", "t", df, "k")
    first = files(home, "silver", "t")
    home.renew("silver", "t", df.where("k = 'k9'"), "k", ["k1"])
    assert {r[1] for r in numbers(home)} == {"k0", "k2"} and files(home, "silver", "t") < first
    assert home.changed_values("silver", "t", 1) == ["k1"]
    home.renew("silver", "t", df, "k", ["k0", "k1", "k2"])
    assert len(numbers(home)) == 9 and home.read("silver", "t").columns == ["v", "k"]
    home.renew("silver", "t", df.limit(0), "k", ["k0", "k1", "k2"])
    assert numbers(home) == []
    assert home.renew("silver", "t", df, "k", []) == 0 and numbers(home) == []
