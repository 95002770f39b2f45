"""Cases in which the text operators once did less than the whole job."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")
from lamina.llm import decontaminate, language, licenses, pieces, quality, secrets, simhash, topk
from lamina.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in enumerate(texts)], DOCS)


# ---------------------------------------------------------------- 10 quality

def test_copies_and_blanks_take_no_room_in_the_sample(spark, monkeypatch):
    sample = 50
    texts = [f"text number {k} says that {k * 7} birds flew over the hills" for k in range(1200)]
    order = frame(spark, texts).orderBy(F.shiftrightunsigned(F.xxhash64("text", F.lit(sample)), 11)).select("text")
    common = order.first().text
    docs = frame(spark, texts + [common] * 2600 + [" \t\n\f", "", None, "\x0b"] * 1000)
    seen = []
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, labels: seen.append(rows) or np.zeros(quality.DIMENSIONS + 1))
    quality.fit(docs, sample=sample)
    assert len(seen[0]) == sample == len(np.unique(seen[0], axis=0))
    few = ["one text", "another text", "one text", " "]
    quality.fit(frame(spark, few), sample=sample)
    assert len(seen[1]) == 2


# ---------------------------------------------------------------- 9 decontamination

def fewest_replaced(masks, longest):
    """For runs of 1 to `longest` words, the fewest replaced words with which no mask fits anywhere."""
    wide = max(map(len, masks))
    looked_at = [(len(m), int(m, 2)) for m in masks]
    states, out = {0: 0}, []
    for n in range(1, longest + 1):
        after = {}
        for state, count in states.items():
            for replaced in (0, 1):
                bits = state << 1 | replaced
                if all(n < width or bits & mask for width, mask in looked_at):
                    kept = bits & (1 << wide - 1) - 1
                    after[kept] = min(after.get(kept, n), count + replaced)
        states = after
        out.append(min(states.values()))
    return out


def test_masks_hit_every_run_with_a_quarter_replaced():
    least = fewest_replaced(decontaminate.MASKS, 26)
    # A longer run splits into parts of these lengths, one of which has a quarter of it replaced at most.
    assert all(least[n - 1] > n // 4 for n in range(max(map(len, decontaminate.MASKS)), 27))
    assert max(map(len, decontaminate.MASKS)) <= 13


def test_worn_items_are_found_wherever_words_are_replaced(spark):
    rows, items = [], []
    for length, lost in ((10, 2), (11, 2), (12, 2), (13, 2), (15, 3)):
        words = [f"b{length}x{k}" for k in range(length)]
        items.append((length, " ".join(words)))
        for gone in combinations(range(length), lost):
            alike = np.ones(length, bool)
            alike[list(gone)] = False
            if decontaminate.best_run(alike, np.flatnonzero(alike)) == [(0, length)]:
                worn = [w if a else f"r{k}" for k, (w, a) in enumerate(zip(words, alike))]
                rows.append((length * 1000 + len(rows), " ".join(["before it"] + worn + ["after it"])))
    docs = frame(spark, []).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc for r in found} == {i for i, _ in rows}


def test_a_verbatim_stretch_is_found_in_a_long_worn_run(spark):
    item = [f"w{k}" for k in range(181)]
    worn = [w if 84 <= k < 97 or (k if k < 84 else 180 - k) % 7 not in (3, 5) else f"r{k}" for k, w in enumerate(item)]
    alike = np.array([a == b for a, b in zip(item, worn)])
    [(start, end)] = decontaminate.best_run(alike, np.array([88]))
    assert end - start > 100 and alike[start:end].mean() < 0.75
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontaminate.overlaps(frame(spark, [" ".join(worn)]), items).collect()
    assert any(r.start <= 84 and r.start + r.n_words >= 97 for r in found)
    assert all(r.n_words >= 13 and r.n_alike >= 0.75 * r.n_words for r in found)


def test_runs_inside_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        alike = rng.random(rng.integers(1, 40)) < 0.7
        total = np.concatenate(([0], np.cumsum(alike)))
        for spot in np.flatnonzero(alike):
            right = {(a, b) for a in range(spot + 1) for b in range(spot + 1, len(alike) + 1)
                     if b - a >= 9 and alike[a] and alike[b - 1] and total[b] - total[a] >= 0.75 * (b - a)}
            got = decontaminate.within(alike, np.array([spot]), 9, 0.75)
            assert bool(got) == bool(right) and all(total[b] - total[a] >= 0.75 * (b - a) - 1e-9 for a, b in got)


# ---------------------------------------------------------------- 7 licences

def test_whole_licences_are_found_under_their_own_names(spark):
    names = [n for n, _ in licenses.TEMPLATES]
    assert {"bsd-2-clause", "bsd-3-clause", "mpl-2.0-header", "gpl-2-header", "gpl-3-header", "lgpl-2.1-header",
            "agpl-3-header", "cc-by-4.0-notice", "cc-by-sa-4.0-notice", "unlicense", "bsl-1.0", "mit", "isc"} <= set(names)
    prose = "quiet rivers ran along seven hills while nobody listened"
    docs = frame(spark, [f"{prose}\n{text}\n{prose}" for _, text in licenses.TEMPLATES])
    rows = licenses.scanned(docs).collect()
    whole = {(r.key, r.license) for r in rows if r.coverage == 1}
    assert {(k, n) for k, n in enumerate(names)} <= whole
    # A licence is not taken for its neighbours; only the Apache header holds another notice.
    other = {(names[k], n) for k, n in whole if names[k] != n}
    assert other <= {("apache-2.0-header", "apache-2.0-notice")}
    for name, ending in (("mit", "OTHER DEALINGS IN THE SOFTWARE"), ("isc", "PERFORMANCE OF THIS SOFTWARE")):
        [row] = [r for r in rows if r.license == name and names[r.key] == name]
        text = dict(licenses.TEMPLATES)[name]
        assert text.rstrip(".").endswith(ending) and row.end - row.start == len(text.rstrip("."))


def test_the_closest_hits_equal_a_search_of_all():
    rng = np.random.default_rng(8)
    templates = [licenses.Template(name, text, 0.8) for name, text in licenses.TEMPLATES]
    for _ in range(50):
        hits = []
        for _ in range(rng.integers(0, 40)):
            template, start = templates[rng.integers(len(templates))], int(rng.integers(0, 300))
            hits.append((template, start, start + int(rng.integers(1, 40)), int(rng.integers(1, 6))))
        expected = []
        for hit in sorted(hits, key=lambda h: (-h[3], -h[3] / len(h[0].words), h[1], h[0].name)):
            if all(h[0].family != hit[0].family or h[2] <= hit[1] or hit[2] <= h[1] for h in expected):
                expected.append(hit)
        assert licenses.closest(hits) == expected
    notice = dict(licenses.TEMPLATES)["cc-by-4.0-notice"]
    [template] = [t for t in templates if t.name == "cc-by-4.0-notice"]
    many = [(template, 100 * k, 100 * k + 50, 9) for k in range(50_000)]
    assert notice and licenses.closest(many) == many  # not quadratic: this ends


# ---------------------------------------------------------------- 2 near copies of short texts

def differing(a, b):
    fps = [simhash.majority(np.unique(simhash.shingle_hashes(t, 5)), 4) for t in (a, b)]
    return int(np.bitwise_count(fps[0] ^ fps[1]).sum())


def test_near_copies_of_few_shingles_are_found(spark):
    far = []
    for k in range(2000):
        text = " ".join(f"t{k}w{i}" for i in range(8))
        if differing(text, f"{text} more") > 60:
            far.append((text, f"{text} more"))
    assert len(far) > 10
    texts = [t for pair in far for t in pair]
    kept = simhash.keep_one(frame(spark, texts)).collect()
    assert {r.doc_id for r in kept} == set(range(0, len(texts), 2))


def test_groups_of_short_texts_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    texts = ["", "", "one", "one two", "a b c d e f g h"]
    for base in range(60):
        words = [f"b{base}w{i}" for i in range(rng.integers(5, 30))]
        # A shared ending makes frequent shingles, which similar texts may share and others do too.
        words += ["this", "page", "was", "last", "seen", "here", "today"] * int(base % 3 == 0)
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(copy) + 1)
                copy[at:at + rng.integers(0, 2)] = [f"x{rng.integers(0, 3)}"]
            texts.append(" ".join(copy))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))

    def similar(a, b):
        return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9

    for x in range(len(texts)):
        for y in range(x):
            if similar(sets[x], sets[y]) and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = [low if z == high else z for z in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.component for r in simhash.similar_groups(docs).collect()}
    assert got == dict(enumerate(label))


def test_unrelated_short_texts_are_no_candidates(spark):
    texts = [" ".join(f"k{k}w{i}" for i in range(8)) for k in range(50_000)] + ["k7w0 k7w1 k7w2 k7w3 k7w4 k7w5 k7w6 k7w7 end"]
    sets = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 5)
    assert [tuple(r) for r in simhash.rare_sharing(sets, 0.8).collect()] == [(7, 50_000)]


def test_radii_lose_one_similar_pair_in_a_million():
    wide = simhash.radii(60, 256, 0.8)
    assert (wide >= 60).all() and wide[-1] == 60
    rng = np.random.default_rng(6)
    for n, m, common in ((4, 5, 4), (12, 15, 12), (20, 25, 20), (9, 9, 8)):
        hashes = rng.integers(0, 1 << 63, (300, n + m - common, 2), np.int64).astype(np.uint64)
        hashes = hashes[..., 0] << np.uint64(32) ^ hashes[..., 1]
        bits = [np.bitwise_count(simhash.majority(h[:n], 4) ^ simhash.majority(h[n - common:], 4)).sum() for h in hashes]
        assert abs(np.mean(bits) / 256 - simhash.chance_to_differ(n, m, common)) < 0.01
        assert max(bits) <= wide[min(n, m)] and simhash.lost(256, simhash.chance_to_differ(n, m, common), wide[n]) <= 1e-6


# ---------------------------------------------------------------- names, ids and sizes that once went wrong

ODD = "doc_id long, text string, `a.b` string, Score string, _own int, _blob string, _spans string, _judged string, `x``y` int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, f"ab{n}", "s", n, "b", "sp", "j", n) for n, (i, t) in enumerate(rows)], ODD)


def varied(seed, words=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(words))


def test_rows_of_one_id_and_different_texts_all_stay(spark):
    a, b = varied(1), varied(2)
    docs = odd(spark, [(1, a), (1, b), (1, a), (2, b + " more"), (3, a), (None, varied(3)), (None, varied(3)), (None, None)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # a stays under id 1 (as the copy whose other columns come first), b under its smaller id by number
    assert sorted((r.doc_id or 0, r.text or "", r["a.b"]) for r in kept.collect() if r.text in (a, varied(3), None)) == sorted(
        [(1, a, "ab0"), (0, varied(3), "ab5"), (0, "", "ab7")])
    assert len([r for r in kept.collect() if r.text and r.text.startswith(b)]) == 1


def test_odd_names_pass_through_every_stage(spark, tmp_path):
    key = "AKIA" + "Z9" * 8
    texts = [f"{varied(k, 90)}. {key}" if k == 3 else varied(k, 90) for k in range(8)]
    docs = odd(spark, list(enumerate(texts)))
    spark.createDataFrame([(1, varied(5, 90))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == [*docs.columns, *(["n_chars"] if "n_chars" in out.columns else [])], name
    found = secrets.findings(docs, secrets.update(docs, shared_folder(spark, "t"), first=True))
    assert {c for c in docs.columns} <= set(found.columns) and sum(len(r.found) for r in found.collect()) == 1
    judged = quality.scored(docs, quality.fit(docs))
    assert [c for c in docs.columns if c != "Score"] == [c for c in judged.columns if c not in ("score", "posterior", "kept")]
    parser = language.fit(docs.withColumn("lang", F.lit("xx")))
    assert {"a.b", "_judged", "x`y"} <= set(language.identified(docs, parser).columns)


def test_a_leaked_text_does_not_take_others_of_its_id(spark, tmp_path):
    import corpus_pipeline

    item = varied(70, 40)
    docs = odd(spark, [(1, f"{varied(71)} {item}"), (1, varied(72)), (2, varied(73))]).withColumn("n_chars", F.lit(1).cast("long"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.text for r in corpus_pipeline.off_benchmark(spark, docs, str(tmp_path)).collect()) == sorted([varied(72), varied(73)])


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [2e6, 1.0]), (50, [3e6, 1.0]), (1, [2.0**32, 2.0**32]), (2, [2.0**32, -(2.0**32)]), (3, [1e30, 0.0]), (4, [-3e6, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.id): r.score for r in topk.top_k(df).collect()}

    def entry(x):
        return max(-(1 << 62), min(1 << 62, math.floor(256 * x)))

    vectors = {i: [entry(c) for c in v] for i, v in rows}
    want = {(q, i): sum(a * b for a, b in zip(vectors[q], vectors[i])) for q in (0, 50) for i in vectors if i != q}
    assert got == {k: max(topk.LOWEST, min(topk.HIGHEST, v)) for k, v in want.items()}
    assert got[0, 50] == 393216000000065536


def test_a_scan_twice_at_once_counts_once(spark):
    docs = odd(spark, [(1, "AKIA" + "Q1" * 8), (2, "plain")])
    ledger = secrets.update(docs, shared_folder(spark, "t"), first=True)
    assert [len(r.found) for r in secrets.findings(docs, ledger.union(ledger)).orderBy("doc_id").collect()] == [1, 0]


def test_a_run_further_from_its_seed_than_any_fixed_margin(spark):
    words = varied(9, 400).split()
    worn = [w if k % 3 else w + "x" for k, w in enumerate(words[:150])] + words[150:]
    docs = spark.createDataFrame([(1, " ".join(worn))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    best = max(r.n_words for r in decontaminate.overlaps(docs, items).collect())
    assert best >= 250 + 100  # two thirds alike before the seeds still belong to the run, which keeps its share


def test_small_chances_are_not_lost():
    chance = np.array([0.9, 0.1, 1.0, 1 - 1e-15, 1e-15, 1e-300])
    assert pieces.beside(chance, np.array([0, 2, 3, 6])).tolist() == [0.1, 0.9, 0.0, 1e-15, 1 - 1e-15, 1.0] or np.allclose(
        pieces.beside(chance, np.array([0, 2, 3, 6])), [0.1, 0.9, 0.0, 1e-15, 1 - 1e-15, 1.0], rtol=1e-9)
