"""Whitening of embeddings, with exact covariances from bit-sliced scatter matrices.

Entries become integers floor(scale * c) + offset. The model is fitted on each
distinct vector once. Its cross-products are counted, not multiplied:

1. A task takes some thousand vectors and shifts each dimension by its least
   value among them, so that all entries are small and not negative.
2. Each bit of each dimension is a plane: one bit for each vector, packed into
   64-bit words. A plane of ones stands for the count.
3. The number of ones in the AND of two planes, weighted by the two powers of
   two, adds up to the cross-products; those with the plane of ones are sums.

Sums leave a task in limbs of 32 bits and are added up limb by limb, so they are
exact whatever the entries are. One matrix of a row and a column for each
dimension reaches the driver. It is centred as integers (n * cross-product -
sum * sum), divided once, and decomposed by `eigh`.

Defined results: rows with a NULL vector, or an entry that is NULL or not
finite, take no part. An entry whose integer would not fit a long is held at the
end of the longs. Vectors of different lengths have models of their own.
Repeated rows, and rows without an id, are whitened each. A component whose
eigenvalue cannot be told from zero has no direction and is left out, so a model
of one distinct vector has none. Components of equal eigenvalue are any basis
of their space. A deviation beyond 38 digits is NULL. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lamina.llm.common import bounded_batches, written

SCALE, OFFSET, MOST = 64, 1_000_000, 16
CHUNK_BYTES, CHUNK_ROWS = 32 << 20, 16384
LIMB = 32
SAFE = 1 << 62
DIGITS = 10**38


def whole(rows: DataFrame, key: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x: array<long>): the integer vectors of the rows that take part."""
    value = F.col(vector)
    usable = rows.where(value.isNotNull() & F.forall(
        value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))
    least, most = (float(end) for end in room(offset))

    def entry(c):
        return F.floor(F.least(F.greatest(F.floor(c.cast("double") * scale).cast("double"), F.lit(least)), F.lit(most))) + offset

    return usable.select(F.col(key).cast("long").alias("id"), F.transform(value, entry).alias("x"))


def room(offset: int) -> tuple[int, int]:
    """The least and the greatest double that, with the offset added, is a long."""
    low, high = -(1 << 63) + max(0, -offset), (1 << 63) - 1 - max(0, offset)
    least, most = np.float64(low), np.float64(high)
    while int(least) < low:
        least = np.nextafter(least, np.inf)
    while int(most) > high:
        most = np.nextafter(most, -np.inf)
    return int(least), int(most)


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a batch by their length: the length, the places of its rows, and its rows as a matrix."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, flat[starts[at][:, None] + np.arange(dim)].reshape(len(at), dim)


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bit planes as (plane x word), the bits of each dimension, and each dimension's least value.

    The first dimension is the constant one. Words at the end are filled with zeros.
    """
    low = x.min(axis=0)
    shifted = np.vstack([np.ones(len(x), np.uint64), (x.view(np.uint64) - low.view(np.uint64)).T])
    widths = np.array([int(top).bit_length() for top in shifted.max(axis=1)])
    bits = np.zeros((int(widths.sum()), -(-len(x) // 64) * 64), np.uint8)
    at = 0
    for row, width in zip(shifted, widths.tolist()):
        for bit in range(width):
            bits[at, : len(x)] = (row >> np.uint64(bit)) & np.uint64(1)
            at += 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), widths, [0, *low.tolist()]


def products(words: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Sums over rows of the products of any two dimensions, from AND and bit counts; upper half only."""
    dims, rows = len(widths), words.shape[1] * 64
    wide = rows << 2 * int(widths.max()) >= SAFE
    kind = object if wide else np.int64
    starts = np.cumsum(widths) - widths
    weights = np.array([1 << b for width in widths.tolist() for b in range(width)], kind)
    out = np.zeros((dims, dims), kind)
    filled = np.flatnonzero(widths)  # a dimension of one value has no plane
    for nth, dim in enumerate(filled.tolist()):
        first = int(starts[dim])
        total = 0
        for plane in range(first, first + int(widths[dim])):
            ones = np.bitwise_count(words[plane] & words[first:]).sum(axis=1, dtype=np.int64).astype(kind)
            total = total + ones * weights[plane]
        out[dim, filled[nth:]] = np.add.reduceat(total * weights[first:], starts[filled[nth:]] - first)
    return out


def scatter(x: np.ndarray, origin: int) -> np.ndarray:
    """Exact sums of products of (1, x - origin), as Python integers; upper half only."""
    words, widths, low = planes(x)
    got = products(words, widths).astype(object)
    shift = np.array([0, *(value - origin for value in low[1:])], object)
    n, sums = got[0, 0], got[0].copy()
    sums[0] = 0
    cross = got + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)
    cross[0] = sums + n * shift
    cross[0, 0] = n
    return np.triu(cross)


def split(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Integers as limbs of 32 bits, the lowest first, the highest signed: sums over 2**30 tasks still fit a long."""
    nth = 0
    while any(not -(1 << LIMB) <= v < 1 << LIMB for v in values):
        yield nth, np.array([v & ((1 << LIMB) - 1) for v in values], np.int64)
        values, nth = np.array([v >> LIMB for v in values], object), nth + 1
    yield nth, values.astype(np.int64)


def scattered(fit: DataFrame, origin: int) -> dict[int, np.ndarray]:
    """For each vector length the sums of products of (1, x - origin) over the fit list, as Python integers."""
    shape = ["dim", "row", "limb", "sums"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            shape)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        sums: dict[int, np.ndarray] = {}

        def close(dim: int) -> None:
            got = scatter(np.concatenate(held.pop(dim)), origin)
            sums[dim] = sums[dim] + got if dim in sums else got

        for piece in batches:
            for dim, _, x in matrices(piece["x"]):
                held.setdefault(dim, []).append(x)
                if sum(map(len, held[dim])) >= max(64, min(CHUNK_ROWS, CHUNK_BYTES // (8 * dim + 1))):
                    close(dim)
        for dim in list(held):
            close(dim)
        for dim, matrix in sums.items():
            for row in range(dim + 1):
                yield batch([(dim, row, nth, part[row:]) for nth, part in split_row(matrix[row], row)])

    def split_row(values: np.ndarray, row: int) -> Iterator[tuple[int, np.ndarray]]:
        for nth, part in split(values[row:]):
            yield nth, np.concatenate((np.zeros(row, np.int64), part))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for piece in batches:
            for dim, row, nth, part in zip(*(piece[name].to_pylist() for name in shape)):
                own = (dim, row, nth)
                part = np.array(part, np.int64)
                total[own] = total[own] + part if own in total else part
        for own, part in total.items():
            yield batch([(*own, part)])

    schema = "dim long, row long, limb long, sums array<long>"
    partial = fit.select("x").mapInArrow(count, schema)
    # A row of one limb for each dimension: bounded by the square of the vector length.
    rows = partial.repartition("dim", "row").mapInArrow(add, schema).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        matrix = out.setdefault(r["dim"], np.zeros((r["dim"] + 1, r["dim"] + 1), object))
        values = np.array(r["sums"], object) * (1 << LIMB * r["limb"])
        matrix[r["row"], r["row"]:] += values
    return {dim: m + np.triu(m, 1).T for dim, m in out.items()}


@dataclass
class Whitener:
    """What whitens vectors of one length: sums of x - origin, and components as columns."""

    n: int
    origin: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as longs where all they lead to fit, else as Python integers."""
        sums = np.array(self.sums, object)
        reach = max((abs(int(v) - self.origin) for v in (x.min(initial=self.origin), x.max(initial=self.origin))), default=0)
        most = self.n * reach + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < SAFE:
            return self.n * (x - self.origin) - sums.astype(np.int64)
        return self.n * (x.astype(object) - self.origin) - sums

    def whiten(self, exact: np.ndarray) -> np.ndarray:
        return (exact / self.n).astype(np.float64) @ self.projection


def components(sums: np.ndarray, origin: int, most: int) -> Whitener:
    """The leading components of the covariance that the sums of products give."""
    n, own = int(sums[0, 0]), sums[0, 1:]
    centred = n * sums[1:, 1:] - np.outer(own, own)
    covariance = (centred / (n * n)).astype(np.float64)
    trace = float(np.trace(covariance))
    if not trace > 0:
        return Whitener(n, origin, own.tolist(), np.zeros((len(own), 0)), np.zeros(0))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > values[0] * len(own) * np.finfo(np.float64).eps).sum()))
    values, vectors = values[:kept], vectors[:, :kept]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(kept)])
    return Whitener(n, origin, own.tolist(), vectors / np.sqrt(values), values / trace)


def measured(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """How far the covariance of the whitened fit list is from the identity, for each vector length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for piece in batches:
            for dim, _, x in matrices(piece["x"]):
                if models[dim].projection.shape[1]:
                    w = models[dim].whiten(models[dim].centred(x))
                    got = np.vstack((w.sum(axis=0), w.T @ w))
                    held[dim] = held[dim] + got if dim in held else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))],
            ["dim", "sums"])

    parts = fit.select("x").mapInArrow(work, "dim long, sums array<double>").select("dim", F.posexplode("sums"))
    found: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("dim", "pos").agg(F.sum("col").alias("total")).collect():  # 17 x 16 numbers for each length
        found.setdefault(r["dim"], {})[r["pos"]] = r["total"]
    out = dict.fromkeys(models, 0.0)
    for dim, cells in found.items():
        kept = models[dim].projection.shape[1]
        table = np.array([cells[k] for k in range(len(cells))]).reshape(kept + 1, kept) / models[dim].n
        out[dim] = float(np.abs(table[1:] - np.outer(table[0], table[0]) - np.eye(kept)).max())
    return out


def fitted(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET,
           most: int = MOST) -> dict[int, Whitener]:
    """A model for each vector length, fitted on the distinct integer vectors."""
    bounded_batches(rows.sparkSession)
    fit = written(whole(rows, key, vector, scale, offset).select("x").distinct(), "fit-list")
    models = {dim: components(sums, offset, most) for dim, sums in scattered(fit, offset).items()}
    for dim, error in measured(fit, models).items():
        models[dim].identity_error = error
    return models


def whitened(rows: DataFrame, models: dict[int, Whitener], key: str = "vec_id", vector: str = "embedding",
             scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each row's components, numbered from 1."""
    number = pa.decimal128(38, 0)

    def deviation(exact: np.ndarray) -> pa.Array:
        if exact.dtype != object:
            return pa.array((exact * exact).sum(axis=1)).cast(number)
        return pa.array([d if d < DIGITS else None for d in (exact * exact).sum(axis=1).tolist()], number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            for dim, at, x in matrices(piece["x"]):
                model = models.get(dim)
                kept = model.projection.shape[1] if model else 0
                if not kept:
                    continue
                exact = model.centred(x)
                each = pa.array(np.repeat(np.arange(len(at)), kept))
                yield pa.RecordBatch.from_arrays(
                    [piece["id"].take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, kept + 1), len(at)), pa.int32()),
                     pa.array(np.full(len(each), model.n)), deviation(exact).take(each),
                     pa.array(model.whiten(exact).ravel()), pa.array(np.tile(model.explained, len(at))),
                     pa.array(np.full(len(each), model.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole(rows, key, vector, scale, offset).mapInArrow(
        work, "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
