"""Each registered query, with its production parameters, over whole small tables: against SQL or brute force."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lamina.llm import decontaminate, pieces
from lamina.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/documents.parquet"), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def words(text):
    return text.encode().lower().split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, result.fetchall()))


def test_op2_against_all_pairs(spark, texts):
    def fingerprint(text):
        own = words(text)
        grams = [b" ".join(own[k:k + 3]) for k in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints.items():
            low = min(component[b] for b, y in prints.items() if (x ^ y).bit_count() <= 2)
            changed |= low < component[a]
            component[a] = min(low, component[a])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in prints}


def test_op3_holds_out_and_predicts(spark, db, texts):
    rows = QUERIES["op3_language"](spark, FOLDER).collect()
    lang = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id])) for r in rows)


def test_op6_decodes(spark, texts):
    rows = QUERIES["op6_sentencepiece"](spark, FOLDER).collect()
    vocabulary = pieces.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"), 0.5)
    assert {r.doc_id for r in rows} == set(texts) and all(r.exact for r in rows)
    assert all(vocabulary.decode(r.ids) == texts[r.doc_id].replace(pieces.SPACE, " ") for r in rows)
    different = {}
    for r in rows:
        different.setdefault(r.doc_id, set()).add(tuple(r.ids))
    assert sum(map(len, different.values())) == len(rows)  # without replacement


def test_op7_names_licences(spark, texts):
    rows = QUERIES["op7_licenses"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} <= set(texts)
    named = {i for i, t in texts.items() if "Released under the MIT License" in t}
    assert named <= {r.doc_id for r in rows}


@pytest.mark.parametrize("name", ["op8_token_records"])
def test_op8_against_the_library(spark, texts, name):
    plain, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}
    for own in sorted(texts):
        ids = [*plain.encode(texts[own], add_special_tokens=False).ids, 2]
        assert (got[own].start, got[own].n_tokens) == (start, len(ids))
        assert got[own].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def overlaps(doc, item, least=13, share=0.75):
    """Whether some stretch of a text runs like the item: all diagonals, all stretches."""
    a, b = np.array(doc), np.array(item)
    need = min(least, len(b))
    for shift in range(-len(b) + need, len(a) - need + 1):
        first, last = max(0, shift), min(len(a), shift + len(b))
        sums = np.concatenate(([0], np.cumsum(a[first:last] == b[first - shift:last - shift])))
        if sums[-1] < share * need:
            continue
        for size in range(need, last - first + 1):
            if (sums[size:] - sums[:-size] >= share * size).any():
                return True
    return False


def test_op9_against_all_positions(spark, db, texts):
    items = dict(db.execute("SELECT item_id, coalesce(text, '') FROM benchmark").fetchall())
    found = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontaminate"](spark, FOLDER).collect()}
    widest = max(map(len, decontaminate.MASKS))
    # Hashes stand for words; a text and an item with few words in common cannot run alike.
    hashed = {k: [xxhash.xxh64_intdigest(w) for w in decontaminate.WORD.findall(t.lower())] for k, t in texts.items()}
    wanted = {k: [xxhash.xxh64_intdigest(w) for w in decontaminate.WORD.findall(t.lower())] for k, t in items.items()}
    want = set()
    for i, own in hashed.items():
        known = set(own)
        for j, item in wanted.items():
            if len(item) >= widest and sum(w in known for w in item) >= 0.75 * min(13, len(item)) and overlaps(own, item):
                want.add((i, j))
    assert {pair for pair in found if len(wanted[pair[1]]) >= widest} == want and want


def test_op10_keeps_good_documents(spark, db, texts):
    rows = {r.doc_id: r for r in QUERIES["op10_quality"](spark, FOLDER).collect()}
    assert set(rows) == set(texts) and all(r.kept == (r.score >= 0.5) for r in rows.values())
    labels = dict(db.execute("SELECT doc_id, quality FROM labels").fetchall())
    good = [rows[i].kept for i, q in labels.items() if q == 1]
    bad = [rows[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.3
