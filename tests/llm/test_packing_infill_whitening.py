"""Whitening, packing and fill-in-the-middle against brute force, and on the awkward inputs each documents."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import infill, packing, queries, records, whitening

DOCS = "doc_id long, text string, key string, place int, ids string, `a.b` string, Text2 string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"naïve words {k} of a long text, 你好 \U0001f600" for k in range(9000))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, LONG), (6, "two copies"), (7, "two copies"), (7, "two copies"),
    (8, "é" * 50), (9, "x <P> y"), (10, "<S><M>"), (11, "<"), (None, "no id"), (None, None), (-12, "negative, with <P and P>"),
] + [(k, f"text {k} " * (k % 17)) for k in range(100, 160)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).repartition(7)


# ---------------------------------------------------------------- 13 fill in the middle

def brute_fill(own, text):
    text, key = text or "", "" if own is None else str(own)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    x, y = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return own, len(text), "plain", None, None, text
    p, m, s = text[:x], text[x:y], text[y:]
    if h[3] % 100 < 20:
        return own, len(text), "spm", x, y - x, f"<S>{s}<P>{p}<M>{m}"
    return own, len(text), "psm", x, y - x, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_the_middle_equals_brute_force(docs):
    out = infill.transformed(docs)
    want = Counter(brute_fill(i, t) for i, t in TEXTS)
    assert Counter(tuple(r) for r in out.collect()) == want
    assert {form for _, _, form, *_ in want} == {"plain", "psm", "spm"}
    again = out.select("key", infill.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter((r.key, r.t) for r in again.collect()) == Counter((i, t or "") for i, t in TEXTS)


def test_fill_without_rows(docs):
    assert infill.transformed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_round_trip(spark, docs, unit):
    out = infill.transformed(docs, unit=unit, seed=3, plain_percent=0, spm_percent=50)
    rows = out.withColumn("t", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.key, r.t) for r in rows) == Counter((i, t or "") for i, t in TEXTS)
    pieces = "one two\nthree\n\n  four"
    cut = infill.boundaries(pieces.encode(), unit)
    places = [cut.select(k) for k in range(len(cut))]
    assert places == ([0, 4, 8, 17, 21] if unit == "word" else [0, 8, 14, 15, 21])


def test_other_sentinels_are_checked():
    infill.Sentinels("[p]", "[s]", "[m]")
    for bad in (("", "b", "c"), ("aba", "b", "c"), ("ab", "xaby", "c")):
        with pytest.raises(ValueError):
            infill.Sentinels(*bad)
    with pytest.raises(ValueError):
        infill.transformed(None, unit="verse")


@pytest.mark.parametrize("share,forms", [(1.0, {"run"}), (0.5, {"bitmap", "array", "run"}), (0.001, {"array", "run"}), (0.0, set())])
def test_containers_select_every_member(share, forms):
    rng = np.random.default_rng(4)
    mask = rng.random(3 * infill.SPAN + 77) < share
    mask[infill.SPAN : 2 * infill.SPAN] = False  # an empty block has no container
    made = infill.Boundaries(mask)
    want = np.flatnonzero(mask)
    assert len(made) == len(want) and {c.form for c in made.containers} <= forms
    assert made.blocks == sorted({int(k) // infill.SPAN * infill.SPAN for k in want})
    for rank in {0, 1, len(want) // 2, len(want) - 1, *rng.integers(0, max(1, len(want)), 300).tolist()} & set(range(len(want))):
        assert made.select(rank) == want[rank]
    for rank in (-1, len(want)):
        with pytest.raises(IndexError):
            made.select(rank)


def test_smallest_container():
    def container(mask):
        return infill.Container(np.array(mask, bool))

    stretches = np.zeros(infill.SPAN, bool)
    stretches[100:30000] = stretches[40000:60000] = True
    assert container(stretches).form == "run" and container(stretches).bytes == 8
    every_other = np.arange(infill.SPAN) % 2 == 0
    assert container(every_other).form == "bitmap" and container(every_other).bytes == infill.BITMAP_BYTES
    assert container(np.arange(infill.SPAN) % 900 == 0).form == "array"


def test_mixed_text_cuts_on_code_points():
    text = ("ascii " * 12000 + "é" * 40000 + "\U0001f600x" * 30000)
    data = text.encode()
    cut = infill.boundaries(data)
    assert len(cut) == len(text) + 1 and len({c.form for c in cut.containers}) > 1
    for rank in (0, 1, 71999, 72000, 72001, 111999, 112000, 130001, len(text)):
        assert data[: cut.select(rank)].decode() == text[:rank]


# ---------------------------------------------------------------- 12 packing

@pytest.fixture(scope="module")
def library():
    plain = Tokenizer.from_file(WORDS)
    return lambda text: [*plain.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("size,parts", [(4096, 7), (16, 7), (16, 1), (100, 3)])
def test_every_id_lies_in_one_piece(spark, library, size, parts):
    df = frame(spark, TEXTS).repartition(parts)
    packed = packing.sequences(df, records.WordEncoder(WORDS), size=size).collect()
    total = sum(len(library(t)) for _, t in TEXTS)
    lengths = [r.length for r in sorted(packed, key=lambda r: r.sequence_id)]
    assert [r.sequence_id for r in sorted(packed, key=lambda r: r.sequence_id)] == list(range(len(packed)))
    rest = [n for n in lengths if n != size]
    assert sum(lengths) == total and lengths[: total // size] == [size] * (total // size)
    assert all(n & (n - 1) == 0 for n in rest) and rest == sorted(set(rest), reverse=True)  # nothing to pad

    found = {}
    for r in packed:
        ids, at = np.frombuffer(r.ids, "<u4"), 0
        for p in r.pieces:
            assert p.offset == at
            at += p.length
            found.setdefault(p.key, []).append((p.start, p.length, p.tokens, ids[p.offset : at].tolist()))
        assert at == r.length == len(ids)
    want = Counter((i, tuple(library(t))) for i, t in TEXTS)
    for own, pieces in found.items():
        texts = [ids for (i, ids), n in want.items() if i == own for _ in range(n)]
        assert sum(n for _, n, _, _ in pieces) == sum(map(len, texts))
        for start, length, tokens, ids in pieces:
            assert any(len(t) == tokens and list(t[start : start + length]) == ids for t in texts)
        if len(texts) == 1:
            assert [x for p in sorted(pieces) for x in p[3]] == list(texts[0])
    assert set(found) == {i for i, _ in TEXTS}


def test_digests_come_from_the_sequences(spark, library, tmp_path):
    rows = [(i, t) for i, t in TEXTS if i != 7]
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_packing"](spark, str(tmp_path)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for own, text in rows:
        if own is None:
            continue
        ids, at = library(text), 0
        for r in sorted(by_doc[own], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (a, x, n), (b, y, _) in zip(places, places[1:]):
        assert (y == x + n) if a == b else (b == a + 1 and y == 0)


def test_no_documents_and_no_ids(spark, docs):
    encoder = records.WordEncoder(WORDS)
    assert packing.sequences(docs.limit(0), encoder).count() == 0
    assert packing.sequences(frame(spark, [(1, ""), (2, None)]), encoder, end_id=None).count() == 0
    only = packing.sequences(frame(spark, [(1, ""), (2, None), (3, "a")]), encoder).collect()
    assert [r.length for r in only] == [4]


def test_one_document_fills_many_windows(spark, library):
    packed = packing.sequences(frame(spark, [(5, LONG)]), records.WordEncoder(WORDS), size=64)
    rows = sorted(packed.collect(), key=lambda r: r.sequence_id)
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist() == library(LONG)
    assert all(len(r.pieces) == 1 and r.pieces[0].key == 5 for r in rows)


# ---------------------------------------------------------------- 11 whitening

VECTORS = "vec_id long, embedding array<double>, x string, id int, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "t", 3, 4) for i, v in rows], VECTORS)


def integers(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def check_whitened(out, rows, most=16):
    """Against Python integers and numpy, for vectors of one length."""
    usable = [(i, integers(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    cross = [[sum(x[a] * x[b] for x in fit) for b in range(dims)] for a in range(dims)]
    cov = np.array([[(n * cross[a][b] - sums[a] * sums[b]) / (n * n) for b in range(dims)] for a in range(dims)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    kept = min(most, dims)
    assert len(out) == len(usable) * kept
    got = {}
    for r in out:
        assert r.n == n and r.identity_error < 1e-6
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
        got.setdefault((r.id, r.component), []).append(r)
    signs = {}
    for own, x in usable:
        centred = np.array([(n * x[k] - sums[k]) / n for k in range(dims)])
        deviation = sum((n * x[k] - sums[k]) ** 2 for k in range(dims))
        for c in range(kept):
            want = centred @ basis[:, c] / math.sqrt(values[c])
            near = [r for r in got[own, c + 1] if int(r.deviation) == deviation]
            assert near
            if abs(want) > 1e-6:
                sign = signs.setdefault(c, math.copysign(1, want * near[0].whitened))
                assert any(abs(r.whitened * sign - want) < 1e-6 * max(1, abs(want)) for r in near)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    some = (rng.standard_normal((300, 20)) * np.linspace(0.2, 3, 20)).tolist()
    rows = list(enumerate(some)) + [(900, some[0]), (901, some[0]), (0, some[1]), (None, some[2])]
    rows += [(910, None), (911, [None] * 20), (912, some[3][:19] + [float("nan")]), (913, [float("inf")] + some[4][1:])]
    df = vectors(spark, rows).repartition(5)
    check_whitened(whitening.whitened(df, whitening.fitted(df)).collect(), rows)


def test_whitening_of_far_entries_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate((rng.standard_normal((90, 4)) * 1e7).tolist()))
    df = vectors(spark, rows).repartition(3)
    check_whitened(whitening.whitened(df, whitening.fitted(df)).collect(), rows)


def test_scatter_is_exact_for_any_longs():
    rng = np.random.default_rng(8)
    for low, high, rows in ((-50, 50, 300), (0, 1, 65), (-(1 << 62), 1 << 62, 70), (5, 6, 1)):
        x = rng.integers(low, high, (rows, 5))
        x[:, 2] = x[0, 2]  # a dimension of one value has no plane
        u = [[1, *(int(v) - 7 for v in row)] for row in x]
        want = np.array([[sum(r[a] * r[b] for r in u) if b >= a else 0 for b in range(6)] for a in range(6)], object)
        assert (whitening.scatter(x, 7) == want).all()
        for values in want:
            parts = list(whitening.split(values))
            assert (sum(np.array(p, object) * (1 << whitening.LIMB * k) for k, p in parts) == values).all()


def test_whitening_defines_the_awkward_cases(spark):
    def run(rows):
        df = vectors(spark, rows)
        return whitening.whitened(df, whitening.fitted(df)).collect()

    assert run([]) == [] and run([(1, None), (2, [float("nan")])]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []      # one distinct vector
    assert run([(1, []), (2, [])]) == []
    same = run([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [2.0, 5.0])])  # the second dimension does not vary
    assert {(r.id, r.component, r.n) for r in same} == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}
    assert sorted(round(r.whitened, 9) for r in same) in ([-1, 1, 1], [-1, -1, 1])
    two = run([(1, [1.0]), (2, [2.0]), (3, [1.0, 5.0]), (4, [3.0, 4.0])])  # lengths have models of their own
    assert Counter((r.id, r.n) for r in two) == Counter({(1, 2): 1, (2, 2): 1, (3, 2): 1, (4, 2): 1})
    far = run([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])])
    top = math.floor(np.nextafter(2.0**63 - 1_000_000, 0)) + 1_000_000
    assert {r.id for r in far} == {1, 2, 3} and top < 1 << 63
    assert {r.id for r in far if r.deviation is None} == {1, 2}   # beyond 38 digits
    assert all(math.isfinite(r.whitened) for r in far)


def test_whitening_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = list(enumerate(rng.standard_normal((200, 24)).tolist())) + [(300, None)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.QUERIES["op11_whitening"](spark, str(tmp_path))
    assert dict(out.dtypes)["deviation"] == "bigint"
    check_whitened(out.withColumnRenamed("vec_id", "id").collect(), rows)


def test_matrices_of_mixed_lengths():
    column = pa.array([[1, 2], [], [3], [4, 5], [6]], pa.list_(pa.int64()))
    got = {dim: (at.tolist(), x.tolist()) for dim, at, x in whitening.matrices(column.slice(1))}
    assert got == {0: ([0], [[]]), 1: ([1, 3], [[3], [6]]), 2: ([2], [[4, 5]])}
