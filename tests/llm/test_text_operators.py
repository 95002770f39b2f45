"""The text operators against brute force, and on the awkward inputs each of them documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from lamina.llm import (
    decontaminate, language, licenses, pieces, quality, records, revisits, secrets, simhash, topk,
)
from lamina.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = (
    "The quick brown fox jumps over the lazy dog while seven wise men walk along the quiet river and talk of "
    "weather, bread and the price of wool. Nobody listens, and the evening comes slowly over the hills. "
)
LONG = " ".join(f"{PROSE}{k}" for k in range(300))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, blanks, one letter, a very long text, ties and repeated rows."""
    return frame(spark, [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, LONG), (6, PROSE), (7, PROSE), (7, PROSE), (8, "é" * 50),
        (9, "\U0001f600 你好"), (None, PROSE),
    ])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 1 secrets

KEY = "AKIA" + "B7" * 8


def spans_of(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.RULES[0].pattern, text, re.I | re.A)
             if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def scan(spark, docs, folder, **more):
    ledger = secrets.update(docs, folder, **more)
    return ledger, secrets.findings(docs, ledger)


def test_secrets_equal_brute_force(spark, awkward, nothing):
    texts = [f"é password: hunter22 {KEY} x", "token=abc secret = 'Zx9_yT.77'", "ab" * 12, "PASSWD=" + "0f" * 20,
             "token=secret:abcdefgh", "password:Kelvin99", f"{KEY}{KEY}"]
    docs = frame(spark, list(enumerate(texts, 100))).union(awkward)
    _, found = scan(spark, docs, shared_folder(spark, "t"), first=True)
    got = Counter((r.text, r.s) for r in found.select("text", secrets.as_text(F.col("found")).alias("s")).collect())
    assert got == Counter((r.text, spans_of(r.text or "")) for r in docs.collect())
    _, none = scan(spark, nothing, shared_folder(spark, "t"), first=True)
    assert none.count() == 0


def test_ledger_scans_only_what_is_new(spark):
    folder = shared_folder(spark, "t")
    first = frame(spark, [(1, f"x {KEY}"), (2, f"x {KEY}"), (3, "plain")])
    ledger, _ = scan(spark, first, folder, first=True)
    assert ledger.count() == 2 * len(secrets.RULES)
    ledger, _ = scan(spark, first, folder)
    assert ledger.count() == 2 * len(secrets.RULES)
    grown = first.union(frame(spark, [(4, "new " + "ab" * 12)]))
    ledger, found = scan(spark, grown, folder)
    assert ledger.count() == 3 * len(secrets.RULES)
    newer = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{20,}", 20, version=2))
    ledger, found = scan(spark, grown, folder, rules=newer)
    assert ledger.where("version = 2").count() == 3
    again = secrets.findings(grown, ledger, newer)
    assert {(r.doc_id, len(r.found)) for r in again.collect()} == {(1, 1), (2, 1), (3, 0), (4, 1)}


def test_redaction(spark):
    text = f"{KEY} é password={'ab' * 12} end"
    docs = frame(spark, [(1, text), (2, None), (3, "clean")])
    _, found = scan(spark, docs, shared_folder(spark, "t"), first=True)
    out = {r.doc_id: r.t for r in found.select("doc_id", secrets.redacted(F.col("text"), F.col("found")).alias("t")).collect()}
    assert out == {1: "[secret] é [secret] end", 2: None, 3: "clean"}


# ---------------------------------------------------------------- 2 simhash

def brute_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    grams = [" ".join(words[k:k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(spark, awkward):
    got = Counter((r.id, r.fp[0] & (1 << 64) - 1) for r in simhash.fingerprints(awkward).collect())
    assert got == Counter((r.doc_id, brute_fingerprint(r.text)) for r in awkward.collect())


@pytest.mark.parametrize("tile", [4, 2048])
def test_components_equal_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    points = []
    for base in rng.integers(0, 1 << 62, 40).tolist():
        value = base
        for step in range(int(rng.integers(1, 6))):
            points.append(value)
            for bit in rng.integers(0, 63, int(rng.integers(0, 4))).tolist():
                value ^= 1 << bit
    points += [0, 0, 1]
    rows = [(k, [v], 0) for k, v in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, fp array<long>, n int")
    got = {r.id: r.component for r in simhash.near_groups(df, 2, tile).collect()}
    parent = list(range(len(points)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(points)):
        for b in range(a):
            if (points[a] ^ points[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in range(len(points))}
    assert simhash.near_groups(df.limit(0), 2).count() == 0


def test_long_chain_and_star_components(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(300)]
    df = spark.createDataFrame(chain + star, "left long, right long")
    got = {r.id: r.component for r in simhash.components(df).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1301)}


def test_one_of_each_group_stays(spark, awkward):
    words = [f"v{k}" for k in range(120)]
    near = " ".join(["Another"] + words[1:])
    other = " ".join(words[:30] + [f"w{k}" for k in range(70)])
    docs = frame(spark, [(20, " ".join(words)), (21, near), (22, other)]).union(awkward).withColumn("id", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    # The row without an id has the smallest number of its own, so it stands for its copies 6 and 7.
    assert ids == [0, 1, 4, 5, 8, 9, 20, 22]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_comparison_keeps_components_in_dense_tiles():
    fps = np.array([[k % 7] for k in range(50)], np.uint64).T
    own = (np.arange(50), fps, np.zeros(50, np.int64))
    links = [p for left, right in simhash.Comparison(3)(own, own, True) for p in zip(left.tolist(), right.tolist())]
    assert len(links) == 49


def test_similarity_of_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 50)))) for _ in range(40)]
    got = simhash.similar(sets[:25], sets[25:], 0.5, step=7)
    for a, x in enumerate(sets[:25]):
        for b, y in enumerate(sets[25:]):
            common = len(np.intersect1d(x, y))
            assert got[a, b] == (common > 0 and common >= 0.5 * (len(x) + len(y) - common))


def test_large_group_of_near_copies(spark):
    """200 texts, each with one word of its own: more than a tile; and 60 that only share their first half."""
    words = [f"v{k}" for k in range(150)]
    rows = [(k, " ".join(words[:70] + [f"own{k}"] + words[71:])) for k in range(200)]
    rows += [(500 + k, " ".join(words[:75] + [f"x{k}y{j}" for j in range(75)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.component for r in simhash.similar_groups(docs).collect()}
    assert got == {k: 0 for k in range(200)} | {500 + k: 500 + k for k in range(60)}


# ---------------------------------------------------------------- 3 language

TRAIN = {
    "xx": ["tumba rolo mita kansi rolo tumba " * 5], "yy": ["grelk strofen mjauk strofen grelk " * 5],
}


def brute_phrases(text, sample):
    joined = " ".join(re.sub(r"[^a-zé]+", " ", s.lower()).strip() for s in sample) + " "
    letters = re.sub(r"[^a-zé]+", " ", text.lower()).strip(" ")
    at = total = 0
    while at < len(letters):
        size = 1
        while at + size < len(letters) and letters[at:at + size + 1] in joined and letters[at:at + size] in joined:
            size += 1
        at, total = at + size, total + 1
    return total


@pytest.mark.parametrize("cells", [language.CELLS, 0, 1500])
def test_phrases_equal_brute_force(cells):
    parser = language.Parser(TRAIN, cells)
    rng = np.random.default_rng(5)
    words = ["tumba", "rolo", "mita", "kansi", "strofen", "mjauk", "grelk", "qqq", "zé"]
    texts = [
        "tumba grelk rolo", "mitakansi strofen qqq mjauk zé", "é", "rolo " * 200, "Tumba, rolo! 77 mita", "", "7",
        (TRAIN["xx"][0] + " ") * 40,  # longer than the sample's repeats: borders of phrases that never fall into step
        *[" ".join(rng.choice(words, n)) for n in (40, 300, 2000)],
    ]
    total, letters = parser.count(texts)
    for row, name in enumerate(parser.names):
        assert total[row].tolist() == [brute_phrases(t, TRAIN[name]) for t in texts]
    assert letters.tolist() == [sum(map(str.isalpha, t)) for t in texts]


def test_every_letter_of_a_large_alphabet_is_known():
    own = "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
    full, tight = (language.Parser({"han": [own], "xx": TRAIN["xx"]}, cells) for cells in (language.CELLS, 50_000))
    texts = [own, own[300:700], own[::-1], own[:3] + "tumba" + own[500:503], "丂" * 700]
    assert tight.width < full.width
    for parser in (full, tight):
        total, _ = parser.count(texts)
        assert total[0].tolist() == [1, 1, 900, 7, 700]
        assert total[1].tolist() == [900, 400, 900, 7, 700]


def test_excerpts_of_a_large_language_are_the_first_by_hash(spark):
    rows = spark.range(6000).selectExpr("concat('tumba rolo ', id) AS text", "IF(id % 3 = 0, 'xx', 'yy') AS lang")
    parser = language.fit(rows, excerpts=20)
    order = rows.orderBy("lang", F.xxhash64("text")).collect()
    for name in ("xx", "yy"):
        assert parser.samples[name] == [r["text"] for r in order if r["lang"] == name][:20]


def test_languages(spark, awkward, nothing):
    rows = [(k, (TRAIN[n][0] + f"{k}"), n, None, 0) for k, n in enumerate(["xx", "yy"] * 4)]
    labelled = spark.createDataFrame(rows + [(99, "ignored text", None, None, 0)], DOCS)
    parser = language.fit(labelled, excerpts=3)
    assert parser.names == ["xx", "yy"]
    asked = frame(spark, [(1, "kansi rolo tumba"), (2, "mjauk grelk"), (3, "123"), (4, None), (5, "")]).union(awkward)
    out = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identified(asked, parser).collect()}
    assert out[1, "kansi rolo tumba"][0] == "xx" and out[2, "mjauk grelk"][0] == "yy"
    assert out[3, "123"] == out[4, None] == out[5, ""] == ("und", 0.0)
    assert all(0 <= score <= 1 for _, score in out.values())
    empty = language.fit(nothing)
    assert {r.lang_pred for r in language.identified(asked, empty).collect()} == {"und"}


# ---------------------------------------------------------------- 4 top-k

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(0, 0.3, (230, 8)), 2)
    vectors[50:60] = vectors[0]  # ties
    rows = [(k, [float(x) for x in v], k) for k, v in enumerate(vectors)]
    odd = [(300, None, 0), (350, [float("nan")] * 8, 0), (400, [None] * 8, 0), (450, [float("inf")] * 8, 0),
           (None, [1.0] * 8, 0), (500, [1.0, 2.0], 0), (550, [], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int")
    got = [tuple(r) for r in topk.top_k(df, every=10, shard=32, block=2, leaf=4).collect()]
    whole = np.floor(256 * vectors).astype(np.int64)
    want = []
    for q in range(0, 230, 10):
        scores = whole @ whole[q]
        order = [k for k in np.lexsort((np.arange(230), -scores)).tolist() if k != q][:5]
        want += [(q, n, k, int(scores[k])) for n, k in enumerate(order, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_hands_each_vector_over_a_bounded_number_of_times(spark, monkeypatch):
    handed = []
    frame_class = type(spark.range(1))
    given = frame_class.mapInArrow

    def counting(self, *args, **named):
        longs = [c for c, kind in self.dtypes if kind == "array<bigint>"]
        handed.append(sum(self.agg(*[F.sum(F.size(c)) for c in longs]).first()[i] or 0 for i in range(len(longs))))
        return given(self, *args, **named)

    monkeypatch.setattr(frame_class, "mapInArrow", counting)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, rng.normal(0, 1, 8).tolist()) for k in range(400)], "vec_id long, embedding array<double>")
    assert topk.top_k(df, every=2, shard=16, block=2, leaf=4).count() == 200 * 5
    assert sum(handed) <= 400 * 8  # a pilot's vectors and the others; each was paired with each block of queries


def test_top_k_in_waves_over_lengths_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 400, raising=False)
    monkeypatch.setattr(topk, "HELD", 300, raising=False)
    rng = np.random.default_rng(6)
    vectors = {k: rng.integers(-3, 4, k % 3 + 2).astype(float).tolist() for k in range(150)}
    rows = [(k, v) for k, v in vectors.items()] + [(k, [9.0, *vectors[k][1:]]) for k in range(0, 150, 4)] + [(8, None), (3, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, every=5, k=3, scale=1, shard=10, block=3, leaf=2).collect())
    want = []
    for q in range(0, 150, 5):
        found = sorted((-sum(int(a * b) for a, b in zip(vectors[q], v)), k) for k, v in vectors.items() if k != q and len(v) == len(vectors[q]))
        want += [(q, n, k, -score) for n, (score, k) in enumerate(found[:3], 1)]
    assert got == want


# ---------------------------------------------------------------- 5 revisits

RECORDS = ("record_id long, url string, at long, kind string, status int, headers map<string,string>, digest string, "
           "body string")


def test_revisits(spark):
    full = {"ETag": '"a"', "Content-Length": "5", "X": "old", "content-type": "text/html"}
    rows = [
        (1, "http://www.x.org/p/?b=2&a=1&utm_s=q#f", 10, "response", 200, full, "d1", "first"),
        (2, "https://x.org:443/p?a=1&b=2", 90_000, "response", 200, {"etag": '"b"', "Etag": '"b"'}, "d2", "second"),
        (3, "x.org/p?a=1&b=2", 95_000, "response", 404, {}, None, "gone"),
        (4, "X.org/p?a=1&b=2", 20, "revisit", 304, {"etag": 'W/"a"', "content-length": "0", "x": "new"}, None, None),
        (5, "x.org/p?a=1&b=2", 99_000, "revisit", 304, {"ETag": '"a"'}, None, None),
        (6, "x.org/p?a=1&b=2", 99_000, "revisit", 304, {}, "d2", None),
        (7, "x.org/p?a=1&b=2", 10, "revisit", 304, {}, "d1", None),
        (8, None, 50, "revisit", 304, None, None, None),
        (9, "x.org/p?a=1&b=2", None, "revisit", 304, {}, "d1", None),
        (10, "x.org/p?a=1&b=2", 500_000, "revisit", 304, None, None, None),
        (11, " ", 50, "revisit", 304, {}, "d1", None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    for slot in (7, 86_400):
        out = {r.record_id: r for r in revisits.resolved(df, slot).collect()}
        assert {k: (r.verdict, r.refers_to) for k, r in out.items()} == {
            4: ("resolved", 1), 5: ("mismatch", 2), 6: ("resolved", 2), 7: ("unmatched", None), 8: ("unmatched", None),
            9: ("unmatched", None), 10: ("unverified", 2), 11: ("unmatched", None)}
        assert out[4].body == "first" and out[4].digest == "d1" and out[4].status == 200
        assert out[4].headers == {"etag": 'W/"a"', "content-length": "5", "x": "new", "content-type": "text/html"}
        assert out[5].body is None and out[5].headers is None
    assert revisits.resolved(df.limit(0)).count() == 0
    assert revisits.resolved(df.union(df)).count() == 16


# ---------------------------------------------------------------- 6 pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def all_ways(vocabulary, text):
    """Every segmentation of a text and its chance."""
    def go(rest):
        if not rest:
            yield (), 1.0
        for size in range(1, len(rest) + 1):
            piece = vocabulary.piece_id.get(rest[:size])
            if piece is not None:
                for tail, chance in go(rest[size:]):
                    yield (piece, *tail), vocabulary.weight[piece] * chance

    found = dict(go("▁" + text.replace(" ", "▁")))
    whole = sum(found.values())
    return {ids: c / whole for ids, c in found.items()}


def test_samples_follow_the_lattice(vocabulary):
    ways = all_ways(vocabulary, "a cat.")
    n = 6000
    lattices = pieces.Lattices(vocabulary)
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = pieces.sample(lattices, [vocabulary.units("a cat.")] * n, keys, 3)
    first, weights = Counter(), Counter()
    for search in found:
        ids = [tuple(lattices.ids(edges).tolist()) for edges, _, _ in search.paths]
        assert len(set(ids)) == 3
        values = [value for _, _, value in search.paths]
        bound = -search.closed[0][0]
        assert values == sorted(values, reverse=True) and bound <= values[-1]
        first[ids[0]] += 1
        for own, (_, before, _) in zip(ids, search.paths):
            assert math.isclose(before[-1], math.log(ways[own]), abs_tol=1e-9)
            weights[own] += 1 / -math.expm1(-math.exp(before[-1] - bound))
    for own in sorted(ways, key=ways.get)[-3:]:
        assert abs(first[own] / n - ways[own]) < 0.02
        assert abs(weights[own] / n - 1) < 0.25  # inverse inclusion chances count each segmentation once


def test_units_are_where_no_piece_runs_on(vocabulary):
    text = "Hello,  world!\n\n(tab)\there ▁ ok... x$$$ é² a_b"
    units = vocabulary.units(text)
    assert "".join(units) == "▁" + text.replace(" ", "▁")
    borders, at = set(), 0
    for unit in units[:-1]:
        at += len(unit)
        borders.add(at)
    whole = "".join(units)
    for start in range(len(whole)):
        for size in range(2, 17):
            if whole[start:start + size] in vocabulary.piece_id:
                assert not borders & set(range(start + 1, min(len(whole), start + size)))


def test_encoding_round_trip(spark, awkward, nothing, vocabulary):
    docs = awkward.union(frame(spark, [(30, "x" * 3000), (31, "tab\tand ☃☃ snow"), (32, "  two  spaces ")]))
    rows = pieces.encoded(docs, MODEL, k=3)
    back = pieces.decoded(rows, MODEL).collect()
    assert all(r.exact for r in back)
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert {(r.key, r.text) for r in back} == set(texts)
    assert all(-math.inf < r.log_inclusion <= 0 for r in back)
    empty = [r for r in back if r.key == 2]
    assert [(r.sample, list(r.ids), r.log_inclusion) for r in empty] == [(1, [], 0.0)]
    by_row = Counter((r.key, r.sample, tuple(r.ids)) for r in back)
    assert all(by_row[r.key, r.sample, tuple(r.ids)] == texts[r.key, r.text] for r in back)
    again = pieces.encoded(docs.repartition(3), MODEL, k=3).collect()
    assert Counter((r.key, r.sample, tuple(r.ids)) for r in again) == by_row
    assert pieces.encoded(nothing, MODEL).count() == 0


def test_small_room_changes_nothing(vocabulary):
    texts = [vocabulary.units(PROSE + str(k)) for k in range(5)]
    keys = np.arange(5, dtype=np.uint64)
    wide, tight = pieces.Lattices(vocabulary), pieces.Lattices(vocabulary, room=10)
    for start in range(5):
        a = pieces.sample(wide, texts[start:start + 1], keys[start:start + 1], 2)[0]
        b = pieces.sample(tight, texts[start:start + 1], keys[start:start + 1], 2)[0]
        assert [wide.ids(e).tolist() for e, _, _ in a.paths] == [tight.ids(e).tolist() for e, _, _ in b.paths]


# ---------------------------------------------------------------- 7 licences

def test_alignment_is_a_common_subsequence():
    text, template = "a b x c d e y f".split(), "a b c d f".split()
    pairs = licenses.aligned(text, template)
    assert [text[i] for i, _ in pairs] == [template[j] for _, j in pairs] == template
    assert licenses.aligned([], template) == [] == licenses.aligned(text, [])
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 9, rng.integers(0, 30)).tolist() for _ in "ab")
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_licences(spark, awkward, nothing):
    mit = dict(licenses.TEMPLATES)["mit"]
    worn = mit.replace("free of charge", "gratis").replace("(the \"Software\")", "")
    notice = "Released under the MIT License."
    docs = frame(spark, [
        (1, f"{PROSE}\n{notice}\n{PROSE}"), (2, f"{notice} {notice}\n{LONG}\n{notice}"), (3, f"{LONG} {worn} {LONG}"),
        (4, "Released the license under"), (5, mit.upper()),
    ])
    rows = licenses.scanned(docs.union(awkward)).collect()
    found = Counter((r.key, r.license) for r in rows)
    assert found == {(1, "mit-notice"): 1, (2, "mit-notice"): 3, (3, "mit"): 1, (5, "mit"): 1}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.key][r.start:r.end] == notice[:-1] for r in rows if r.license == "mit-notice")
    assert licenses.scanned(nothing).count() == 0
    assert licenses.scanned(docs, templates=(("none", "..."),)).count() == 0


# ---------------------------------------------------------------- 8 records

WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("encoder", [records.WordEncoder(WORDS), records.WordEncoder(WORDS, room=5), records.PlainEncoder(WORDS)])
def test_records_equal_the_library(spark, awkward, nothing, encoder):
    strange = "It's A.B.C... <|endoftext|> don't!! Écolé $$$x 12ab34 …,“q” straße... İ̧ ΣΣ"
    docs = awkward.union(frame(spark, [(40, strange), (41, strange + " " + PROSE.upper())]))
    folder = shared_folder(spark, "t")
    manifest = records.write_records(docs, folder, encoder)
    rows = records.read_records(manifest, folder, keep_ids=True).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    start = 0
    assert len(rows) == len(want)
    for r, (keyed, key, text) in zip(sorted(rows, key=lambda r: r.start), want):
        ids = brute_ids(text)
        assert (r.key, r.start, r.n_tokens, list(r.ids)) == (key if keyed else None, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    mixed = records.read_shuffled(manifest, folder, seed=1, parts=3).collect()
    assert Counter((r.key, tuple(r.ids)) for r in mixed) == Counter((r.key, tuple(r.ids)) for r in rows)
    none = records.write_records(nothing, shared_folder(spark, "t"), encoder)
    assert records.read_records(none, folder).count() == 0


def test_damage_is_seen(tmp_path):
    payload = b"\x02\x01" + bytes(8) + b"\x05\x00"
    data = bytearray(records.framed(payload))
    (tmp_path / "part-0.rec").write_bytes(data)
    assert list(records.read_file(str(tmp_path), "part-0.rec")) == [payload]
    for spot in (3, 9, 20, len(data) - 1):
        broken = bytearray(data)
        broken[spot] ^= 1
        (tmp_path / "part-1.rec").write_bytes(broken)
        with pytest.raises(ValueError, match="damaged"):
            list(records.read_file(str(tmp_path), "part-1.rec"))


# ---------------------------------------------------------------- 9 decontamination

def test_overlaps(spark, awkward, nothing):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    item = words[:40]
    changed = item[:]
    for spot in (9, 18, 27, 33):
        changed[spot] = "zzz"
    items = spark.createDataFrame(
        [(1, " ".join(item)), (2, " ".join(words[40:46])), (3, None), (4, ""), (1, " ".join(item))], "item_id long, text string")
    filler = " ".join(words[100:300])
    docs = frame(spark, [
        (1, f"{filler} {' '.join(item)} {filler}"), (2, f"{filler}, {'! '.join(changed).upper()}."),
        (3, filler), (4, " ".join(words[40:46])), (5, " ".join(item[:12])), (6, " ".join(item[10:30])),
        (7, " ".join(item[:8] + ["q"] * 30)), (8, " ".join(words[40:45])),
    ]).union(awkward.where("doc_id > 8 OR doc_id IS NULL"))
    got = {(r.doc, r.item): (r.start, r.n_words, r.n_alike) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 1): (200, 40, 40), (2, 1): (200, 40, 36), (4, 2): (0, 6, 6), (6, 1): (0, 20, 20)}
    assert decontaminate.overlaps(nothing, items).count() == 0
    assert decontaminate.overlaps(docs, items.limit(0)).count() == 0
    # A table too small to tell hashes apart changes nothing: hits are joined by the whole hash.
    few = {(r.doc, r.item) for r in decontaminate.overlaps(docs, items, bits=8).collect()}
    assert few == set(got)


# ---------------------------------------------------------------- 10 quality

def test_vote_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    n = 20_000
    good = rng.random(n) < 0.8
    said = np.full((n, quality.LABELLERS), quality.SILENT)
    for k in range(quality.LABELLERS):
        speaks = rng.random(n) < 0.7
        right = rng.random(n) < np.where(good, 0.99, 0.6)
        said[speaks, k] = np.where(good == right, quality.GOOD, quality.BAD)[speaks]
    patterns, counts = np.unique(said @ 3 ** np.arange(quality.LABELLERS), return_counts=True)
    model = quality.fit_votes(patterns, counts.astype(float), slander=0.01, trust=0.0)
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.right[:, 0] - 0.6).max() < 0.05 and np.abs(model.right[:, 1] - 0.99).max() < 0.01


def test_quality(spark, awkward, nothing):
    rows = []
    for k in range(60):
        rows.append((100 + k, f"{PROSE}{PROSE}\n{k} {PROSE}"))
    for k in range(10):
        rows += [(300 + k, (f"BUY NOW {k}!! " * 40).upper()), (320 + k, "".join(f"w{k}$$$ %%% ### " for _ in range(60)))]
    docs = frame(spark, rows).union(awkward).withColumn("score_", F.lit(0))
    fitted = quality.fit(docs)
    out = quality.scored(docs, fitted)
    assert out.columns == [*docs.columns, "score", "posterior", "kept"]
    got = out.collect()
    assert all(r.kept for r in got if r.doc_id and 100 <= r.doc_id < 160)
    assert not any(r.kept for r in got if r.doc_id and r.doc_id >= 300)
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert quality.scored(nothing, quality.fit(nothing)).count() == 0


# ---------------------------------------------------------------- hashes

def test_no_span_is_the_hash_of_nothing(spark):
    docs = frame(spark, [(1, None)])
    _, found = scan(spark, docs, shared_folder(spark, "t"), first=True)
    text = found.select(F.sha2(secrets.as_text(F.col("found")), 256).alias("h")).first().h
    assert text == hashlib.sha256(b"").hexdigest()


def test_lattices_keep_little_of_a_worker():
    """The edges kept from task to task, with room to grow by half, stay under 180 MB in a Python worker."""
    lattices = pieces.Lattices(pieces.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"), 0.5))
    own = (lattices.chance, lattices.up_to, lattices.others, lattices.end, lattices.piece)
    assert lattices.room * sum(a.itemsize for a in own) * 3 // 2 <= 180 << 20
