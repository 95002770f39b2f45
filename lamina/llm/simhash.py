"""SimHash fingerprints and exact search for near fingerprints, tile against tile.

`fingerprints` hashes the word shingles of whole texts; bit b of a fingerprint
is 1 if it is set in over half of the shingle hashes. `compare` holds distinct
fingerprints against one another by exclusive-or and bit counts in numpy. Fingerprints are sorted
into cells by the number of set bits in each of four parts; two fingerprints
that differ in r bits have part counts that differ by r in sum at most, so only
cells that near are compared and no link is lost. A cell is cut into tiles of
bounded size, and the unit of work is a pair of tiles.

A tile pair gives a spanning forest of its links, not all of them: components
stay the same, and a group of n copies gives about n links instead of n * n.
`components` then finds the smallest id each row can reach, by rounds of joins.

A NULL text counts as empty; a text without words has fingerprint zero, which
is linked like any other. Repeated rows, and rows that share an id, each have
their own fingerprint; a NULL id names no component unless it is alone there.
"""

from __future__ import annotations

from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lamina.llm.common import (
    all_but, bounded_batches, map_rows, own_id, perhaps, quoted, release, repeated, with_mark, written,
)

TILE = 8192
SLOTS = 16
MOST = 1 << 17
PARTS = 4
SHORT = 64
LOSS = 1e-6
FEW = 16


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of `words` words, lower-cased in A-Z and joined by spaces, repeats included."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits of the same hashes."""
    x = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """`lanes` words of 64 bits; a bit is 1 if it is set in over half of the hashes."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        own = hashes if lane == 0 else mixed(hashes, lane)
        counts = np.zeros(64, np.int64)
        for start in range(0, len(own), 1 << 15):
            bits = np.unpackbits(own[start:start + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.uint16)
        out[lane] = np.packbits(counts * 2 > len(own)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, lanes: int = 1,
                 distinct: bool = False, few: int | None = None) -> DataFrame:
    """(id, fp: array of `lanes` longs, n: number of shingles) of every row.

    With `distinct` a shingle that repeats counts once. With `few` there is also grams: the shingles themselves
    where there are no more than that many, else an empty array.
    """
    bounded_batches(docs.sparkSession)

    def work(piece):
        fps, sizes, grams = [], [], []
        for value in piece["text"].to_pylist():
            hashes = shingle_hashes(value, shingle)
            if distinct:
                hashes = np.unique(hashes)
            fps.append(majority(hashes, lanes).view(np.int64))
            sizes.append(len(hashes))
            grams.append(hashes.view(np.int64) if len(hashes) <= (few or 0) else hashes[:0].view(np.int64))
        columns = [piece["id"], pa.array(fps, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
        if few is None:
            return pa.RecordBatch.from_arrays(columns, ["id", "fp", "n"])
        return pa.RecordBatch.from_arrays([*columns, pa.array(grams, pa.list_(pa.int64()))], ["id", "fp", "n", "grams"])

    chosen = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "id long, fp array<long>, n int" + ("" if few is None else ", grams array<long>")
    return map_rows(chosen, work, "text", schema)


# ------------------------------------------------------------------- tiles

def part_counts() -> list:
    """Set bits in each quarter of a 64-bit fingerprint, as columns."""
    width = 64 // PARTS
    return [F.bit_count(F.shiftrightunsigned(F.col("fp")[0], width * p).bitwiseAND((1 << width) - 1))
            for p in range(PARTS)]


def near_cells(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Offsets between cells whose counts differ by `radius` in sum at most, each pair of cells once."""
    offsets = [o for o in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, o)) <= radius]
    return [o for o in offsets if o >= (0,) * parts]


def tiles(points: DataFrame, cell: list, size: int = TILE, slots: int = SLOTS, most: int = MOST) -> DataFrame:
    """(tile, cell, nr, ids, fps, ns): the rows (id, fp, n) of each cell, dealt to tiles of about `size` rows.

    A cell has no more than `slots` tiles as long as they hold `most` rows at most: what is shipped for pairs of
    tiles then grows with the rows, not with their square. The cells' sizes are broadcast: there are no more cells
    than combinations of bit counts or size classes, whatever the number of rows.
    """
    keyed = points.withColumn("cell", F.array(*[c.cast("int") for c in cell]))
    rows = F.count(F.lit(1))
    many = F.least(F.ceil(rows / F.lit(size)), F.greatest(F.lit(slots), F.ceil(rows / F.lit(most))))
    counts = keyed.groupBy("cell").agg(many.cast("long").alias("slots"))
    dealt = keyed.join(F.broadcast(counts), "cell").withColumn("nr", F.pmod(F.xxhash64("id"), "slots"))
    return (
        dealt.groupBy("cell", "nr")
        .agg(F.collect_list(F.struct("id", "fp", "n")).alias("rows"))
        .select(F.xxhash64("cell", "nr").alias("tile"), "cell", "nr", F.col("rows.id").alias("ids"),
                F.flatten("rows.fp").alias("fps"), F.col("rows.n").alias("ns"))
    )


def tile_pairs(packed: DataFrame, offsets: list[tuple[int, ...]]) -> DataFrame:
    """(a, b) of the tiles to compare, from the tiles' names alone."""
    names = packed.select("cell", "nr", "tile")
    shifts = F.array(*[F.array(*map(F.lit, o)) for o in offsets])
    reach = names.withColumn("shift", F.explode(shifts)).select(
        F.col("tile").alias("a"), F.col("nr").alias("nr_a"),
        F.transform("cell", lambda x, i: (x + F.get("shift", i)).cast("int")).alias("cell"),
        F.forall("shift", lambda x: x == 0).alias("same"))
    return (
        reach.join(names.select("cell", F.col("tile").alias("b"), F.col("nr").alias("nr_b")), "cell")
        .where(~F.col("same") | (F.col("nr_a") <= F.col("nr_b"))).select("a", "b")
    )


def forest(lefts: np.ndarray, rights: np.ndarray, total: int) -> np.ndarray:
    """Which of the links (row numbers below `total`) make a spanning forest."""
    parent = list(range(total))
    keep = np.zeros(len(lefts), bool)
    for k, (x, y) in enumerate(zip(lefts.tolist(), rights.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def chance_to_differ(n: int, m: int, common: int) -> float:
    """How likely a bit of the majorities of `n` and `m` hashes differs, of which `common` are the same."""
    def chances(k: int) -> np.ndarray:
        return np.array([comb(k, i) for i in range(k + 1)], float) / 2.0 ** k

    def above(size: int) -> np.ndarray:
        rest = np.append(np.cumsum(chances(size - common)[::-1])[::-1], 0.0)  # chance of i or more in the rest
        need = np.clip(size // 2 + 1 - np.arange(common + 1), 0, size - common + 1)
        return rest[need]

    a, b = above(n), above(m)
    return float(chances(common) @ (a * (1 - b) + b * (1 - a)))


def lost(bits: int, chance: float, radius: int) -> float:
    """How likely more than `radius` of `bits` differ."""
    return sum(comb(bits, k) * chance ** k * (1 - chance) ** (bits - k) for k in range(radius + 1, bits + 1))


def radii(radius: int, bits: int, similarity: float, short: int = SHORT, loss: float = LOSS) -> np.ndarray:
    """The radius for each number of shingles up to `short`, wide enough to lose a pair by chance `loss` at most.

    Over few shingles a strict majority hangs on each of them, so that similar
    sets differ in more bits than long ones do. The last value is for all longer texts.
    """
    out = np.full(short + 2, radius)
    for n in range(1, short + 1):
        for m in range(n, int(n / similarity + 1e-9) + 1):
            common = int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
            if common <= n and (n < m or common < n):
                chance = chance_to_differ(n, m, common)
                while lost(bits, chance, int(out[n])) > loss:
                    out[n] += 1
    return out


class Comparison:
    """A spanning forest of the links between two tiles: pairs of at most `radius` differing bits.

    With `ratio`, pairs whose numbers of shingles differ by more are no links.
    `wide` has the radius by number of shingles, its last value for all that
    are longer; of two rows the wider radius holds.
    """

    def __init__(self, radius: int, ratio: float = 0.0, block: int = 1 << 17, wide: np.ndarray | None = None):
        self.radius, self.ratio, self.block, self.wide = radius, ratio, block, wide

    def reach(self, ns: np.ndarray) -> np.ndarray:
        return self.wide[np.minimum(ns, len(self.wide) - 1)].astype(np.uint16)

    def __call__(self, a: tuple, b: tuple, same: bool):
        """a, b: (ids, fps of shape lanes x rows, ns). Yields arrays (id, id)."""
        (ids_a, fps_a, ns_a), (ids_b, fps_b, ns_b) = a, b
        label = np.arange(len(ids_a) + len(ids_b))
        names = np.concatenate((ids_a, ids_b))
        limit = self.radius
        rows = max(1, self.block // max(1, len(ids_b)))
        for start in range(0, len(ids_a), rows):
            stop = min(len(ids_a), start + rows)
            differ = np.zeros((stop - start, len(ids_b)), np.uint16)
            for lane in range(len(fps_a)):
                differ += np.bitwise_count(fps_a[lane, start:stop, None] ^ fps_b[lane, None, :])
            if self.wide is not None:
                limit = np.maximum(self.reach(ns_a[start:stop])[:, None], self.reach(ns_b)[None, :])
            near = differ <= limit
            if same:
                near &= np.arange(len(ids_b))[None, :] > np.arange(start, stop)[:, None]
            if self.ratio and near.any():
                own, other = ns_a[start:stop, None], ns_b[None, :]
                near &= np.minimum(own, other) >= self.ratio * np.maximum(own, other)
            x, y = np.nonzero(near)
            if len(x):
                left, right = joined(label, x + start, y if same else y + len(ids_a))
                yield names[left], names[right]


def joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that join what `label` holds apart, which is brought up to date."""
    total = len(label)
    fresh = np.flatnonzero(label[left] != label[right])
    between = label[left[fresh]] * total + label[right[fresh]]
    fresh = fresh[np.unique(between, return_index=True)[1]]
    used = fresh[forest(label[left[fresh]], label[right[fresh]], total)]
    for x, y in zip(left[used].tolist(), right[used].tolist()):
        low, high = sorted((label[x], label[y]))
        label[label == high] = low
    return left[used], right[used]


def compare(packed: DataFrame, pairs: DataFrame, lanes: int, comparison: Comparison) -> DataFrame:
    """(left, right) for the links of all tile pairs; a tile pair is a task's unit of work and memory."""
    columns = ["ids", "fps", "ns"]
    first = packed.select(F.col("tile").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    second = packed.select(F.col("tile").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    # The smaller table of names meets the tiles; a tile is at most a few hundred kilobytes.
    both = pairs.join(first, "a").join(second, "b")

    def values(column, row):
        array = column[row].values
        return array.to_numpy(zero_copy_only=False)

    def run(batches):
        release()
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for side in "ab":
                    ids, fps, ns = (values(batch[f"{c}_{side}"], row) for c in columns)
                    sides.append((ids, np.ascontiguousarray(fps.view(np.uint64).reshape(-1, lanes).T), ns))
                same = batch["a"][row].as_py() == batch["b"][row].as_py()
                for left, right in comparison(*sides, same):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["left", "right"])

    return both.mapInArrow(run, "left long, right long")


# -------------------------------------------------------------- components

def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(id, component: smallest id reachable) of all ends of the edges (left, right).

    Rounds of large and small stars: each node's neighbours are linked to the
    smallest of them. A node with many neighbours is a key of a join and of a
    minimum, never one group in one task. Each round is a written table.
    """
    pairs = edges.select(F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v"))
    pairs = written(pairs.where("u != v").distinct(), f"{label}-0")
    state = fingerprint_of(pairs)
    for turn in range(1, 200):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(),
                        f"{label}-{turn}")
        now = fingerprint_of(pairs)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def fingerprint_of(pairs: DataFrame) -> tuple:
    """One row that tells whether a table of pairs has changed."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_groups(points: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(id, fp, component) for each row of (id, fp, n), 64-bit fingerprints linked at `radius` or fewer differing bits."""
    folded = written(
        points.groupBy("fp").agg(F.min("id").alias("low"))
        .select(F.col("fp")[0].alias("id"), "fp", F.lit(0).alias("n"), "low"), "distinct-fingerprints")
    packed = written(tiles(folded, part_counts(), tile), "tiles")
    links = compare(packed, tile_pairs(packed, near_cells(PARTS, radius)), 1, Comparison(radius))
    group = components(written(links, "links"))
    rooted = folded.join(group, "id", "left").select("fp", "low", F.coalesce("component", "id").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("fp", "component")
    return points.join(named, "fp").select("id", "fp", "component")


# ---------------------------------------------- groups by similarity of shingles

def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, grams: sorted distinct shingle hashes) of rows (id, text)."""
    def work(piece):
        grams = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in piece["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([piece["id"], pa.array(grams, pa.list_(pa.int64()))], ["id", "grams"])

    return map_rows(docs.select("id", "text"), work, "text", "id long, grams array<long>")


def tile_sets(packed: DataFrame, shingle: int) -> DataFrame:
    """Rows with an array `texts`, with sets in its place: the sorted distinct shingle hashes of each text."""
    others = [c for c in packed.columns if c != "texts"]

    def run(batches):
        release()
        for batch in batches:
            texts = batch["texts"]
            grams = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts.flatten().to_pylist()]
            cuts = np.concatenate(([0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))))
            sets = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(grams, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), sets], [*others, "sets"])

    schema = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in others)
    return packed.select(*others, "texts").mapInArrow(run, f"{schema}, sets array<array<bigint>>")


def rare_sharing(sets: DataFrame, similarity: float) -> DataFrame:
    """(left, right) that link any two of the rows (id, grams) whose sets have that similarity, and some more.

    Of n shingles, two sets of similarity s have so many in common that the n - ceil(s * n) + 1 rarest of each
    hold one that is in both. Rows are linked through the smallest id that has the shingle among its rarest, so
    a frequent one gives a star, not pairs. Sets that share no rare shingle are never linked, however many, nor
    are sets so small that only an equal one is similar.
    """
    sets = sets.where(F.size("grams") * F.lit(1 - similarity) >= F.lit(similarity - 1e-9))
    each = written(sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "few-shingles")
    spread = each.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    ranked = each.join(spread, "gram").groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct("rows", "gram"))).alias("order"))
    # 1e-9: a product such as 0.8 * 5 may come out above the whole number it is.
    taken = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    prefix = written(
        ranked.select("id", F.explode(F.slice("order", F.lit(1), taken)).alias("rare"))
        .where("rare.rows > 1").select("id", F.col("rare.gram").alias("gram")), "rare-shingles")
    first = prefix.groupBy("gram").agg(F.min("id").alias("left"))
    return prefix.join(first, "gram").where("id != left").select("left", F.col("id").alias("right"))


def similar(own: list[np.ndarray], other: list[np.ndarray], similarity: float, step: int = 4096) -> np.ndarray:
    """Which pairs of sets have at least that Jaccard similarity, as a matrix; counted by products of incidence matrices."""
    both = np.intersect1d(np.concatenate(own), np.concatenate(other))
    common = np.zeros((len(own), len(other)), np.float32)

    def places(sets):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets)
        column = np.searchsorted(both, flat)
        known = (column < len(both)) & (both[np.minimum(column, len(both) - 1)] == flat)
        return row[known], column[known]

    if len(both):
        (rows_a, columns_a), (rows_b, columns_b) = places(own), places(other)
        for start in range(0, len(both), step):
            sides = []
            for rows, columns, count in ((rows_a, columns_a, len(own)), (rows_b, columns_b, len(other))):
                inside = (columns >= start) & (columns < start + step)
                matrix = np.zeros((count, min(step, len(both) - start)), np.float32)
                matrix[rows[inside], columns[inside] - start] = 1
                sides.append(matrix)
            common += sides[0] @ sides[1].T
    sizes = np.array([len(x) for x in own])[:, None] + np.array([len(x) for x in other])[None, :]
    return (common >= similarity * (sizes - common) - 1e-6) & (common > 0)


def verified(groups: DataFrame, docs: DataFrame, shingle: int, similarity: float, tile: int = 128) -> DataFrame:
    """(left, right): a spanning forest of the pairs in each group (id, component) whose shingle sets are similar.

    A group is cut into tiles, and tile is held against tile: no task meets a
    whole group, and a pair of tiles gives fewer links than it has rows. Texts are
    shuffled rather than their shingles, which are more bytes, and only those that
    may be in a group; a tile is held against itself where it lies.
    """
    counts = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("slots"))
    placed = groups.join(counts, "component").withColumn("nr", F.pmod(F.xxhash64("id"), "slots").cast("int"))
    grouped = perhaps(groups.select("id"))
    together = (
        docs.select("id", "text").where(grouped(F.col("id"))).join(placed, "id").groupBy("component", "nr", "slots")
        .agg(F.collect_list(F.struct("id", "text")).alias("rows"))
        .select(F.xxhash64("component", "nr").alias("tile"), "component", "nr", "slots", F.col("rows.id").alias("ids"),
                F.col("rows.text").alias("texts")))
    packed = written(tile_sets(together, shingle), "group-tiles")
    large = packed.where("slots > 1")
    pairs = large.where("nr < slots - 1").select(
        F.col("tile").alias("a"), F.explode(F.sequence(F.col("nr") + 1, F.col("slots") - 1)).alias("nr_b"), "component",
    ).select("a", F.xxhash64("component", "nr_b").alias("b"))
    first = large.select(F.col("tile").alias("a"), F.col("ids").alias("ids_a"), F.col("sets").alias("sets_a"))
    second = large.select(F.col("tile").alias("b"), F.col("ids").alias("ids_b"), F.col("sets").alias("sets_b"))

    def run(batches, sides):
        release()
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sets = [], []
                for side in sides:
                    ids.append(batch[f"ids{side}"][row].values.to_numpy(zero_copy_only=False))
                    sets.append([x.values.to_numpy(zero_copy_only=False) for x in batch[f"sets{side}"][row]])
                same = len(sides) == 1
                near = similar(sets[0], sets[-1], similarity)
                x, y = np.nonzero(np.triu(near, 1) if same else near)
                names = np.concatenate(ids)
                left, right = joined(np.arange(len(names)), x, y if same else y + len(ids[0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[left], pa.int64()), pa.array(names[right], pa.int64())], ["left", "right"])

    inside = packed.select("ids", "sets").mapInArrow(lambda batches: run(batches, [""]), "left long, right long")
    across = pairs.join(first, "a").join(second, "b").mapInArrow(
        lambda batches: run(batches, ["_a", "_b"]), "left long, right long")
    return inside.union(across)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4, radius: int = 70,
                   tile: int = TILE) -> DataFrame:
    """(id, component) of rows (id, text): groups of texts whose shingle sets have a similarity of 0.8 or more.

    The fingerprint has 64 * `lanes` bits of the distinct shingles. Two texts of
    similarity 0.8 differ in 39 of 256 bits, give or take 6: `radius` loses one of
    them in a million at most. Texts of up to 64 shingles differ in more and have
    radii wide enough for the same. Sizes prune too: sets of
    similarity 0.8 differ in size by a quarter at most, so only neighbouring
    size classes meet, as well as only neighbouring classes of bit counts. A
    text of `FEW` distinct shingles or fewer is found by a rare shingle that a
    similar text must share, which loses nothing: radii for so few would hold
    unrelated texts near. The groups of candidates are then split by exact
    similarity.
    """
    points = written(fingerprints(docs, "id", "text", shingle, lanes, distinct=True, few=int(FEW / similarity + 1e-9)),
                     "fingerprints")
    # Equal fingerprints are one row. Of texts of few shingles equal fingerprints do not tell equal sets.
    folded = written(points.groupBy("fp", "grams").agg(F.min("id").alias("id"), F.max("n").alias("n")),
                     "distinct-fingerprints")
    sparse = rare_sharing(folded.where(F.size("grams") > 0).select("id", "grams"), similarity)
    size_class = F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / float(-np.log(similarity))))
    bits = sum((F.bit_count(F.col("fp")[i]) for i in range(1, lanes)), F.bit_count(F.col("fp")[0]))
    wide = radii(radius, 64 * lanes, similarity)
    cell = [F.coalesce(size_class, F.lit(-9)), F.floor(bits / F.lit(int(wide.max()) + 1))]
    packed = written(tiles(folded.where(F.col("n") > FEW).select("id", "fp", "n"), cell, tile), "tiles")
    offsets = [o for o in product((-1, 0, 1), repeat=2) if o >= (0, 0)]
    near = written(
        compare(packed, tile_pairs(packed, offsets), lanes, Comparison(radius, ratio=similarity, wide=wide)).union(sparse),
        "links")
    candidates = written(components(near, "candidates"), "candidate-groups")
    links = written(verified(candidates, docs, shingle, similarity), "verified")
    named = folded.join(components(links), "id", "left").select(
        "fp", "grams", F.coalesce("component", "id").alias("component"))
    return points.join(named, ["fp", "grams"]).select("id", "component")


def different_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(own id, content: address of the text, row), one row of each id and text: of copies the first as JSON.

    Only rows whose id and text come again are shuffled, and they collapse in each task before.
    """
    rows = docs.select(
        own_id(key, text).alias("own"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content"),
        F.struct(*map(quoted, docs.columns)).alias("row"), F.to_json(F.struct(*all_but(docs, text))).alias("others"))
    told = with_mark(rows, ["own", "content"], repeated(rows, ["own", "content"]), "again")
    copies = told.where("again").groupBy("own", "content").agg(F.min_by("row", "others").alias("row"))
    return told.where("again IS NULL").select("own", "content", "row").unionByName(copies)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows that remain when one row of each group of similar texts stays: the one of the smallest id.

    Rows of one id and one text are copies: the one whose other columns come first, as JSON, stays. Different
    texts under one id are rows of their own, the first by hash under the id itself, others under high numbers
    that their texts give. Rows without an id are told apart by their texts. Other columns may have any name.
    """
    bounded_batches(docs.sparkSession)
    single = written(different_rows(docs, key, text), "different-rows")  # the text compared must be the text kept
    # Written, so that Spark sees its size: ids of several texts are few as a rule, and then no text is shuffled.
    shared = written(
        single.groupBy("own").agg(F.min("content").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("own", "first"), "shared-ids")
    number = F.when(F.col("first").isNull() | (F.col("first") == F.col("content")), F.col("own")).otherwise(
        (1 << 62) + F.xxhash64("own", "content").bitwiseAND((1 << 61) - 1))
    named = single.join(shared, "own", "left").withColumn("id", number)
    groups = similar_groups(
        named.select("id", F.coalesce(F.col("row").getField(text), F.lit("")).alias("text")), **settings)
    groups = written(groups.select("id", (F.col("id") == F.col("component")).alias("stays")), "kept")
    # No text is shuffled to be kept, nor to be dropped while the spared ids are few enough to be sent to all tasks.
    gone = perhaps(groups.where("NOT stays").select("id"))
    spared = written(groups.where("stays").where(gone(F.col("id"))).select("id"), "spared")
    clear = named.where(~gone(F.col("id")))
    return clear.unionAll(named.where(gone(F.col("id"))).join(spared, "id", "left_semi").select(*clear.columns)).select("row.*")
