"""The pipeline, stage by stage and as a whole, on a small corpus with something for every stage."""

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entries
import corpus_pipeline
from lamina.llm import pieces

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, kept int, found string, "
          "blob string, id long")


def prose(seed, words=90):
    rng = np.random.default_rng(seed)
    some = ["".join(rng.choice(list("abcdeilnorst"), int(rng.integers(2, 9)))) for _ in range(words)]
    return ". ".join(" ".join(some[k:k + 9]).capitalize() for k in range(0, words, 9)) + "."


ITEM = prose(900, 40)
KEY = "AKIA" + "Q7" * 8


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    texts = {k: prose(k) for k in range(1, 41)}
    texts |= {50: texts[1], 51: texts[2] + " More", 52: texts[3]}
    texts |= {60: prose(60) + " " + ITEM.upper() + " " + prose(61)}
    texts |= {70: f"{prose(70)} {KEY} {prose(71)}"}
    texts |= {80 + k: f"BUY NOW {k}!! " * 60 for k in range(6)}
    texts |= {90: None, 91: "", 92: " \n"}
    rows = [(k, t, "en", "s", len(t or ""), "x", 7, "y", "z", 1) for k, t in texts.items()]
    rows += [rows[3], (None, prose(200), None, None, None, None, None, None, None, None),
             (None, f"{ITEM} {prose(201)}", None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == given
    ids = {name: sorted(r.doc_id or 0 for r in df.select("doc_id").collect()) for name, df in seen.items()}
    clean = [*range(1, 41)]
    assert ids["quality classifier"] == sorted([0, 0, *clean, 4, 50, 51, 52, 60, 70])
    assert ids["simhash near-dedup"] == [0, 0, *clean, 60, 70]
    assert ids["benchmark decontamination"] == [0, *clean, 70]
    secret = {r.doc_id: r for r in seen["secret scans"].collect()}
    assert KEY not in secret[70].text and "[secret]" in secret[70].text and secret[70].n_chars == len(secret[70].text)
    assert secret[1].text == prose(1) and secret[1].kept == 7 and secret[1].found == "y" and secret[1].blob == "z"
    last = seen["sentencepiece"]
    assert ids["sentencepiece"] == sorted(2 * ids["secret scans"])
    read = pieces.decoded(last, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.text for r in read} == {k: r.text for k, r in secret.items()}


def test_the_registered_query_runs_the_stages(spark, folder):
    rows = entries.queries()["pipeline"](spark, folder).collect()
    assert len(rows) == 2 * 42 and all(r.exact for r in rows)


def test_no_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
