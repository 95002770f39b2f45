"""Benchmark passages in training texts, found by spaced seeds and verified with substitutions allowed.

Words are runs of letters and digits, lower-cased. A seed is a mask over a
window of words: positions with 1 are hashed, positions with 0 are not looked
at, so that a window matches though a word there was replaced. The windows of
all benchmark items and of all texts are hashed under each mask, and equal
hashes are joined.

1. A bit table of fixed size of the benchmark's hashes is built by Spark and
   sent to the tasks. Its size is a parameter, not a matter of the benchmark.
2. Each task hashes all windows of its texts, and cuts from each text the
   regions around windows that the table may know.
3. The windows of the regions are joined to the benchmark's by the whole hash;
   every hit says on which diagonal (text position less item position) a region
   and an item may run alike.
4. On each diagonal the words are compared one by one. A passage is the best
   run around the hits: words alike count 1, words that differ count -2.
   It is an overlap if it has `least` words or the whole item, and at least
   `share` of them alike. In a run that is long enough and has too few alike,
   the runs inside it around each hit are held to the same.

The masks hit every run of at least as many words as the widest mask (10) of
which a quarter at most is replaced, wherever the replaced words stand.

NULL texts count as empty. Items of fewer words than the widest mask are
looked for whole, without substitutions. Items without words are nowhere.
Repeated items and rows count one by one. Items may share an id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lamina.llm.common import bit_table, bounded_batches, known, map_rows, release, written

# Fixed masks, of 5 looked-at words each. In any run of 10 words or more of which a quarter at most is replaced, one of
# them fits somewhere: tests enumerate runs of 10 to 26 words, and a longer run has a part of those lengths that holds.
MASKS = ("1100010011", "11010011", "1101011", "11111")
TABLE_BITS = 26
LEAST = 13
SHARE = 0.75
WORD = re.compile(r"[^\W_]+")

WINDOW = "hash long, place int"


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w.encode()) for w in WORD.findall(text.lower())], np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def windows(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the looked-at words of each window, as wide as the mask."""
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, xxhash.xxh64_intdigest(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = scrambled(out + words[k:k + count])
    return out


def masks_of(lengths: list[int], masks: tuple[str, ...]) -> tuple[str, ...]:
    """The masks, and a full one for each item shorter than the widest of them."""
    full = ("1" * n for n in sorted(set(lengths)) if 0 < n < max(map(len, masks)))
    return (*masks, *(m for m in full if m not in masks))


def item_windows(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(item, hash, place) of all windows; an item shorter than the widest mask has one under the mask of its length."""
    widest = max(map(len, masks))

    def work(piece):
        out: list[list] = [[], [], []]
        for item, words in zip(piece["item"].to_pylist(), piece["words"]):
            words = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in ("1" * len(words),) if len(words) < widest else masks:
                hashes = windows(words, mask)
                out[0] += [item] * len(hashes)
                out[1] += hashes.view(np.int64).tolist()
                out[2] += range(len(hashes))
        return pa.RecordBatch.from_pydict(
            dict(zip(("item", "hash", "place"), out)),
            pa.schema([("item", pa.int64()), ("hash", pa.int64()), ("place", pa.int32())]))

    def run(batches):
        for batch in batches:
            yield work(batch)

    return items.select("item", "words").mapInArrow(run, "item long, hash long, place int")


def regions(docs: DataFrame, table, masks: tuple[str, ...], bits: int, margin: int) -> DataFrame:
    """(doc, start, words, hits: (hash, place in the text)) of the parts of each text around windows the table knows.

    A region takes in `margin` words on both sides. Regions that would touch are
    one, so no passage is cut; its words are the text's, however many they are.
    """
    widest = max(map(len, masks))

    def work(piece):
        out: dict[str, list] = {"doc": [], "start": [], "words": [], "hashes": [], "places": []}
        bitmap = table.value
        for doc, text in zip(piece["doc"].to_pylist(), piece["text"].to_pylist()):
            words = word_hashes(text)
            found, where = [], []
            for mask in masks:
                hashes = windows(words, mask)
                places = np.flatnonzero(known(bitmap, bits, hashes))
                found.append(hashes[places])
                where.append(places)
            places = np.concatenate(where)
            if not len(places):
                continue
            order = np.argsort(places, kind="stable")
            places, hashes = places[order], np.concatenate(found)[order]
            cuts = np.flatnonzero(np.diff(places) > widest + 2 * margin) + 1
            for own, keys in zip(np.split(places, cuts), np.split(hashes, cuts)):
                first = max(0, int(own[0]) - margin)
                out["doc"].append(doc)
                out["start"].append(first)
                out["words"].append(words[first:int(own[-1]) + widest + margin].view(np.int64))
                out["hashes"].append(keys.view(np.int64))
                out["places"].append(own.astype(np.int32))
        return pa.RecordBatch.from_pydict(out, pa.schema([
            ("doc", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())),
            ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]))

    return map_rows(docs.select("doc", "text"), work, "text",
                    "doc long, start int, words array<long>, hashes array<long>, places array<int>")


def best_run(alike: np.ndarray, spots: np.ndarray) -> list[tuple[int, int]]:
    """Runs of the best sum (1 for words alike, -2 for others) through each of the given spots, as (start, end)."""
    total = np.concatenate(([0], np.cumsum(np.where(alike, 1, -2))))
    low, high = np.minimum.accumulate(total), np.maximum.accumulate(total[::-1])[::-1]
    found = set()
    for spot in spots.tolist():
        start = int(np.flatnonzero(total[:spot + 1] == low[spot])[-1])
        end = int(np.flatnonzero(total[spot:] == high[spot])[0]) + spot
        found.add((start, end))
    return sorted(found)


def within(alike: np.ndarray, spots: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Through each of the given spots a run of `least` words or more of which `share` are alike, if there is one.

    The run of the best sum by the share itself (1 - `share` for words alike,
    -`share` for others) is taken, or if that is too short, the longest run
    that starts and ends with words alike.
    """
    total = np.concatenate(([0.0], np.cumsum(alike - share)))
    low, high = np.minimum.accumulate(total), np.maximum.accumulate(total[::-1])[::-1]
    closed = np.maximum.accumulate(np.where(np.concatenate(([False], alike)), total, -np.inf)[::-1])
    found = set()
    for spot in spots.tolist():
        start = int(np.flatnonzero(total[:spot + 1] == low[spot])[-1])
        end = int(np.flatnonzero(total[spot:] == high[spot])[0]) + spot
        if end - start < least:
            starts = np.flatnonzero(alike[:spot + 1])
            ends = len(alike) - np.searchsorted(closed, total[starts] - 1e-9)
            if not len(starts):
                continue
            best = int(np.argmax(np.where(ends > spot, ends - starts, -1)))
            start, end = int(starts[best]), int(ends[best])
        if end > spot and end - start >= least:
            found.add((start, end))
    return sorted(found)


def overlaps(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id",
             masks: tuple[str, ...] = MASKS, least: int = LEAST, share: float = SHARE,
             bits: int = TABLE_BITS) -> DataFrame:
    """(doc, item, start, n_words, n_alike): verified overlaps, positions counted in words of the text."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def hashed(piece):
        words = [word_hashes(t).view(np.int64) for t in piece["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([piece["item"], pa.array(words, pa.list_(pa.int64()))], ["item", "words"])

    texts = items.select(F.col(item_key).cast("long").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    bench = map_rows(texts, hashed, "text", "item long, words array<long>")
    # Items are told apart by a hash of id and words: ids may repeat.
    bench = written(bench.where(F.size("words") > 0).distinct()
                    .withColumn("name", F.col("item")).withColumn("item", F.xxhash64("item", "words")), "bench")
    widest = max(map(len, masks))
    short = [r[0] for r in bench.select(F.size("words")).where(F.size("words") < widest).distinct().collect()]
    everything = masks_of(short, masks)  # at most one more for each length below the widest mask
    seeds = written(item_windows(bench, masks), "seeds")
    table = spark.sparkContext.broadcast(bit_table(seeds, bits))

    chosen = docs.select(F.col(doc_key).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    # No run is longer than its item, so what lies further than the longest item from a seed is in no run with it.
    margin = bench.agg(F.max(F.size("words"))).first()[0] or 0
    cut = regions(chosen, table, everything, bits, margin).withColumn("region", F.xxhash64("doc", "start", "words"))
    cut = written(cut, "regions")
    spots = cut.select("region", F.explode(F.arrays_zip("hashes", "places")).alias("hit")).select(
        "region", F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("spot"))
    # One row for each (region, item, diagonal), with the first and last place where a seed fell.
    diagonals = (
        spots.join(seeds, "hash")
        .groupBy("region", "item", (F.col("spot") - F.col("place")).alias("shift"))
        .agg(F.array_sort(F.collect_set("spot")).alias("spots"))
    )
    pairs = (
        diagonals.join(cut.select("region", "doc", "start", "words"), "region")
        .join(bench.select("item", "name", F.col("words").alias("wanted")), "item")
    )

    def verify(batches):
        release()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            get = {c: batch[c] for c in ("doc", "name", "start", "words", "wanted", "shift", "spots")}
            for row in range(batch.num_rows):
                start, shift = get["start"][row].as_py(), get["shift"][row].as_py()
                words, wanted = (get[c][row].values.to_numpy(zero_copy_only=False) for c in ("words", "wanted"))
                first, last = max(start, shift), min(start + len(words), shift + len(wanted))
                alike = words[first - start:last - start] == wanted[first - shift:last - shift]
                seen = get["spots"][row].values.to_numpy(zero_copy_only=False) - first
                seen, need = seen[(seen >= 0) & (seen <= len(alike))], min(least, len(wanted))
                runs = set()
                for begin, end in best_run(alike, seen):
                    if end - begin >= need and alike[begin:end].sum() >= share * (end - begin):
                        runs.add((begin, end))
                    elif end - begin >= need:
                        inside = seen[(seen >= begin) & (seen < end)] - begin
                        runs.update((begin + a, begin + b) for a, b in within(alike[begin:end], inside, need, share))
                for begin, end in sorted(runs):
                    for column, value in zip(out, (get["doc"][row].as_py(), get["name"][row].as_py(), first + begin,
                                                   end - begin, int(alike[begin:end].sum()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                ["doc", "item", "start", "n_words", "n_alike"])

    return pairs.mapInArrow(verify, "doc long, item long, start int, n_words int, n_alike int").distinct()
