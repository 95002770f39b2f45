"""Texts stay where they lie unless the work needs them elsewhere."""

from collections import Counter

from pyspark.sql import functions as F

from lamina.llm import secrets, simhash
from lamina.llm.common import perhaps, shared_folder, written

SECRET = "password: abcdef123"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_repeated_texts_are_shuffled_for_a_scan(spark):
    texts = ["one", "two", SECRET, SECRET, SECRET, None, "", "three"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    todo = secrets.pending(docs, None, secrets.RULES)
    assert Counter(r.text for r in todo.collect()) == Counter(["one", "two", SECRET, "", "three"])
    alone = plan(todo).split("Union")[1].split("SortAggregate")[0]
    assert "BroadcastHashJoin" in alone and "hashpartitioning" not in alone
    known = secrets.update(docs.where("doc_id < 2"), shared_folder(spark, "t"), first=True)
    assert Counter(r.text for r in secrets.pending(docs, known, secrets.RULES).collect()) == Counter([SECRET, "", "three"])


def test_only_texts_with_secrets_are_joined(spark):
    rows = [(1, SECRET, "a"), (1, SECRET, "a"), (2, "plain", None), (3, None, "b"), (None, f"x {SECRET}", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, told string")
    ledger = secrets.update(docs, shared_folder(spark, "t"), first=True)
    found = secrets.findings(docs, ledger)
    assert found.columns == ["doc_id", "text", "told", "found"]
    got = Counter((r.doc_id, r.told, tuple((s.start, s.kind) for s in r.found)) for r in found.collect())
    assert got == Counter({(1, "a", ((0, "assign"),)): 2, (2, None, ()): 1, (3, "b", ()): 1, (None, "c", ((2, "assign"),)): 1})
    assert "SortMergeJoin" not in plan(found)


def test_only_repeated_rows_are_shuffled_to_be_told_apart(spark):
    rows = [(1, "a", "fr"), (1, "a", "en"), (1, "b", "fr"), (2, "a", None), (None, "c", "x"), (None, "c", "x"), (3, None, "y"), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    single = simhash.different_rows(docs, "doc_id", "text")
    got = Counter((r.row.doc_id, r.row.text or "", r.row.lang) for r in single.collect())
    assert got == Counter({(1, "a", "en"): 1, (1, "b", "fr"): 1, (2, "a", None): 1, (None, "c", "x"): 1, (3, "", "y"): 1})
    alone = plan(single).split("Union")[1].split("SortAggregate")[0]
    assert "BroadcastHashJoin" in alone and "hashpartitioning" not in alone


def test_no_text_is_shuffled_to_be_kept(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(1500)]
    rows += [(2000 + k, rows[k][1]) for k in range(100)] + [(None, rows[7][1]), (None, "alone")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "t")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "2k")  # the ids kept are more than that, those to be looked at twice are not
    try:
        kept = simhash.keep_one(docs)
        assert "SortMergeJoin" not in plan(kept)
        got = Counter((r.doc_id, r.text) for r in kept.collect())
    finally:
        spark.conf.set(setting, before)
    own = {7: (None, rows[7][1])}  # a row without an id has a negative one, the smallest
    assert got == Counter([own.get(k, rows[k]) for k in range(1500)] + [(None, "alone")])


def test_spared_rows_stay_where_the_bits_are_full(spark, monkeypatch):
    monkeypatch.setattr(simhash, "perhaps", lambda ids: perhaps(ids, 6))
    rows = [(k, " ".join(f"w{k % 200}x{i}" for i in range(20))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(200))


def test_what_is_perhaps_there(spark):
    seen = perhaps(spark.createDataFrame([(k,) for k in range(0, 1000, 10)], "id long"))
    got = {r.id for r in spark.range(1000).where(seen(F.col("id"))).collect()}
    assert set(range(0, 1000, 10)) <= got and len(got) < 110
    assert not spark.range(9).where(perhaps(spark.range(0))(F.col("id"))).count()


def test_large_cells_have_larger_tiles_not_more_pairs(spark):
    points = spark.range(4000).select("id", F.array("id").alias("fp"), F.lit(1).alias("n"))
    def count(**settings):
        packed = written(simhash.tiles(points, [F.lit(0)], **settings), "tiles")
        assert packed.agg(F.sum(F.size("ids"))).first()[0] == 4000
        return packed.count(), simhash.tile_pairs(packed, [(0,)]).count()
    assert count(size=10, slots=8, most=1000) == (8, 36)
    assert count(size=10, slots=8, most=100) == (40, 820)
    assert count(size=2000, slots=8, most=3000) == (2, 3)


def test_a_group_in_one_tile_is_compared_where_it_lies(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 2, 40))) for k in range(6)]
    docs = spark.createDataFrame(rows, "id long, text string")
    groups = spark.createDataFrame([(k, 0) for k in range(5)], "id long, component long")
    for tile in (2, 100):
        links = simhash.verified(groups, docs, 5, 0.8, tile)
        ends = {x for r in links.collect() for x in (r.left, r.right)}
        assert ends == set(range(5))
    inside = plan(links).split("Union")[1].split("MapInArrow")[1]
    assert "Join" not in inside
