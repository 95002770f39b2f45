"""The registered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamina.llm import (
    decontaminate, infill, language, licenses, packing, pieces, quality, records, revisits, secrets, simhash, topk,
    whitening,
)
from lamina.llm.common import shared_folder, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids, written as record files and read back from them."""
    import public_tokenizers

    folder = shared_folder(spark, "records")
    encoder = records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    manifest = records.write_records(table(spark, sf_dir, "documents"), folder, encoder)
    return records.read_records(manifest, folder).withColumnRenamed("key", "doc_id")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, found through a ledger of blobs that starts empty."""
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.update(versions, shared_folder(spark, "ledger"), first=True)
    found = secrets.findings(versions, ledger)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    spans = secrets.as_text(F.col("found"))
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def spans_sql(kind: str, nr: int, pattern: str, keep: str = "TRUE") -> str:
    """Spans of one kind, as a list: each match is the first place of its text after the end of the one before."""
    start = "(a.e + instr(substr(t, a.e + 1), x.m) - 1)"
    return f"""list_reduce(
        list_transform(regexp_extract_all(t, '{pattern}'), lambda m: {{'m': m, 'e': 0::BIGINT, 'l': {NO_SPANS}}}),
        lambda a, x: {{'m': x.m, 'e': {start} + length(x.m), 'l': CASE WHEN {keep} THEN list_append(
            a.l, {{'s': {start}, 'nr': {nr}, 'e': {start} + length(x.m), 'kind': '{kind}'}}) ELSE a.l END}},
        {{'m': '', 'e': 0::BIGINT, 'l': {NO_SPANS}}}).l"""


NO_SPANS = "[]::STRUCT(s BIGINT, nr INTEGER, e BIGINT, kind VARCHAR)[]"
EITHER_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
                       for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({EITHER_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLES["op1_secret_scan"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, {spans_sql("assign", 1, ASSIGN, f"length(regexp_extract(x.m, '{ASSIGN}', 2)) >= 6")} AS a,
         {spans_sql("access", 2, "AKIA[A-Z0-9]{16,}")} AS k, {spans_sql("hex", 3, "[0-9a-f]{24,}")} AS h
  FROM texts
), shown AS (
  SELECT doc_id, len(a) AS n_assign, len(k) AS n_access, len(h) AS n_hex,
         array_to_string(list_transform(list_sort(list_concat(a, k, h)), lambda s: s.kind || ':' || s.s || ':' || s.e), ',') AS spans
  FROM found
)
SELECT doc_id, n_assign, n_access, n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM shown
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and the components of those that differ in two bits at most."""
    points = written(simhash.fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    groups = simhash.near_groups(points, radius=2)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts run like a benchmark item, words replaced or not."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id", "start": "start_word"})


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality, by a scorer that learnt from the texts alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, quality.fit(docs)).drop("text")


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every text, drawn by the chances of its lattice, and whether they decode to it."""
    import public_tokenizers

    rows = pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("key", "doc_id")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the labels of three quarters of the documents."""
    docs = table(spark, sf_dir, "documents").withColumn("part", language.remainder("doc_id"))
    parser = language.fit(docs.where("part != 2"))
    held_out = F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out")
    return language.identified(docs.select("doc_id", "text", held_out), parser).drop("text")


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLES["op4_exact_top_k"] = """
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM points q JOIN points c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified capture of the pages, with the response that it stands for and its merged headers."""
    found = revisits.resolved(revisits.captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.select("record_id", "url", "at", "verdict", "refers_to", "refers_at", "status",
                        F.array_join(lines, "\n").alias("headers"), "digest")


ORACLES["op5_revisits"] = r"""
WITH pages_ AS (
  SELECT page_id, url, coalesce(html, '') AS html, page_id * 40 AS moment,
         (page_id + 1 + ((page_id * 7919) % 97 + 97) % 97) * 40 AS later,
         regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), split AS (
  SELECT *, regexp_replace(bare, '\?.*$', '') AS place,
         regexp_replace(regexp_replace(bare, '^[^?]*', ''), '^\?', '') AS asked
  FROM pages_
), named AS (
  SELECT *, md5(html) AS digest, '"' || substr(md5(html), 1, 16) || '"' AS tag, 't' || moment AS changed,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(place, '/.*$', '')), '^[^@]*@', ''),
                        '^www[.]', ''), ':(80|443)?$', '') AS host,
         regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(asked, '&'),
                         lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS parts
  FROM split
), keyed AS (
  SELECT *, nullif(host || path || CASE WHEN parts <> '' THEN '?' || parts ELSE '' END, '') AS canonical FROM named
), answers AS (
  SELECT canonical, moment, max(page_id) AS page_id FROM keyed GROUP BY canonical, moment
), found AS (
  SELECT k.*, a.page_id AS other
  FROM keyed k ASOF LEFT JOIN answers a ON k.canonical = a.canonical AND k.later > a.moment
), judged AS (
  SELECT f.*, o.moment AS other_at, o.html AS stored, o.digest AS stored_digest, o.tag AS stored_tag, o.changed AS stored_changed,
         CASE WHEN o.page_id IS NULL THEN 'unmatched'
              WHEN CASE ((f.page_id % 3) + 3) % 3 WHEN 0 THEN f.digest = o.digest WHEN 1 THEN f.tag = o.tag
                   ELSE f.changed = o.changed END THEN 'resolved'
              ELSE 'mismatch' END AS verdict
  FROM found f LEFT JOIN keyed o ON f.other = o.page_id
)
SELECT page_id * 2 + 1 AS record_id, regexp_replace(url, '^http:', 'https:') AS url, later AS "at", verdict,
       other * 2 AS refers_to, other_at AS refers_at,
       CASE WHEN verdict = 'resolved' THEN 200 END AS status,
       CASE WHEN verdict = 'resolved' THEN
         'age: ' || later || chr(10) || 'cache-control: max-age=120' || chr(10) || 'content-length: ' || strlen(stored)
         || chr(10) || 'content-type: text/html' || chr(10) || 'etag: '
         || CASE WHEN ((page_id % 3) + 3) % 3 = 1 THEN 'W/' || tag ELSE stored_tag END
         || chr(10) || 'last-modified: ' || stored_changed END AS headers,
       CASE WHEN verdict = 'resolved' THEN stored_digest END AS digest
FROM judged
"""


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices in every text."""
    return licenses.scanned(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's leading whitened components, by a model fitted on each distinct integer vector once."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = whitening.whitened(vectors, whitening.fitted(vectors))
    # A deviation beyond a long has no place in this column; the operator has it in 38 digits.
    return rows.withColumn("deviation", F.col("deviation").try_cast("long")).withColumnRenamed("id", "vec_id")


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token ids in one row, cut into sequences of 4096; each piece's checksum is read from its sequence."""
    import public_tokenizers

    encoder = records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.sequences(table(spark, sf_dir, "documents"), encoder)
    return packing.pieces(packed).withColumnsRenamed({"key": "doc_id", "tokens": "doc_tokens"})


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its parts in another order, and the text that the output restores."""
    rows = infill.transformed(table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return rows.select(
        F.col("key").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(again, 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts
), formed AS (
  SELECT *, least(a, b) AS x, greatest(a, b) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
