"""Fill-in-the-middle rows: a text cut at two drawn boundaries, its parts put in another order.

Where a text may be cut is a set of byte offsets of its UTF-8 form, held in the
Roaring way: 2**16 neighbouring offsets share a container, which is kept in the
smallest of three forms:

    array    the offsets themselves, two bytes each
    bitmap   one bit an offset, 8 KB
    run      first offset and length of each stretch, four bytes each

Beside the containers stand their cumulative cardinalities. The boundary of a
rank is found by a search among those, then by a select inside one container,
so a cut point counted in units becomes a byte offset without decoding text.

Defined results: a NULL text counts as empty. An empty text, and one that holds
a sentinel, are left plain, as is the drawn share of all others. A row without
a key is drawn by the empty key. Repeated rows give a row each; equal draws give
an empty middle. Only key and text are read, so other columns may have any
name. A text is one row however long it is; batches are bounded in bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamina.llm.common import bounded_batches, map_rows

BITS = 16
SPAN = 1 << BITS
BITMAP_BYTES = SPAN // 8
ARRAY, BITMAP, RUN = "array", "bitmap", "run"
UNITS = ("point", "word", "line")


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        names = (self.prefix, self.suffix, self.middle)
        for name in names:
            if not name or any(name.startswith(name[-k:]) for k in range(1, len(name))):
                raise ValueError(f"a sentinel must not begin as it ends: {name!r}")
            if any(name in other for other in names if other is not name):
                raise ValueError(f"a sentinel must not stand inside another: {name!r}")


class Container:
    """The members of one block of 2**16 offsets, in the smallest form."""

    def __init__(self, mask: np.ndarray):
        edges = np.diff(mask.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.size = int((ends - starts).sum())
        costs = {RUN: 4 * len(starts), ARRAY: 2 * self.size, BITMAP: BITMAP_BYTES}
        self.form = min(costs, key=costs.get)
        self.bytes = costs[self.form]
        if self.form == RUN:
            self.starts, self.before = starts.astype(np.uint16), np.cumsum(ends - starts) - (ends - starts)
        elif self.form == ARRAY:
            self.members = np.flatnonzero(mask).astype(np.uint16)
        else:
            whole = np.zeros(SPAN, bool)
            whole[: len(mask)] = mask
            self.words = np.packbits(whole, bitorder="little").view(np.uint64)

    def select(self, rank: int) -> int:
        """The member of that rank, counted from 0."""
        if self.form == RUN:
            run = int(np.searchsorted(self.before, rank, side="right")) - 1
            return int(self.starts[run]) + rank - int(self.before[run])
        if self.form == ARRAY:
            return int(self.members[rank])
        until = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        word = int(np.searchsorted(until, rank, side="right"))
        inside = rank - (int(until[word - 1]) if word else 0)
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[inside])


class Boundaries:
    """A set of offsets: containers by their block, and how many members stand before each."""

    def __init__(self, mask: np.ndarray):
        self.blocks, self.containers = [], []
        for block in range(0, len(mask), SPAN):
            part = mask[block : block + SPAN]
            if part.any():
                self.blocks.append(block)
                self.containers.append(Container(part))
        sizes = [c.size for c in self.containers]
        self.before = np.cumsum([0, *sizes])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The offset of that rank, counted from 0."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        return self.blocks[at] + self.containers[at].select(rank - int(self.before[at]))


def boundaries(data: bytes, unit: str = "point") -> Boundaries:
    """Where a text may be cut: before each of its units and at its end.

    Units are code points, words with the blanks after them, or lines with
    their break; what stands before the first word belongs to the first unit.
    """
    raw = np.frombuffer(data, np.uint8)
    mask = np.ones(len(raw) + 1, bool)
    if unit == "point":
        mask[:-1] = (raw & 0xC0) != 0x80
    elif unit == "line":
        mask[1:-1] = raw[:-1] == 10
    else:
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        mask[1:-1] = blank[:-1] & ~blank[1:]
    return Boundaries(mask)


def draws(key: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits, from the key and the seed alone."""
    name = f"{seed}:{'' if key is None else key}"
    digest = hashlib.sha256(name.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transformed(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "point", seed: int = 1,
                plain_percent: int = 10, spm_percent: int = 20, marks: Sentinels = Sentinels()) -> DataFrame:
    """(key, n, form, prefix_units, middle_units, output): each text in one of the forms

        plain   the text itself
        psm     <P> prefix <S> suffix <M> middle
        spm     <S> suffix <P> prefix <M> middle

    `n` counts units; the prefix ends after the smaller of two drawn ranks, the middle after the larger.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    bounded_batches(df.sparkSession)
    p, s, m = (name.encode() for name in (marks.prefix, marks.suffix, marks.middle))

    def one(own: int | None, data: bytes):
        places = boundaries(data, unit)
        n = len(places) - 1
        first, second, third, fourth = draws(own, seed)
        if not data or any(mark in data for mark in (p, s, m)) or third % 100 >= 100 - plain_percent:
            return n, "plain", None, None, data
        low, high = sorted((first % (n + 1), second % (n + 1)))
        x, y = places.select(low), places.select(high)
        prefix, middle, suffix = data[:x], data[x:y], data[y:]
        if fourth % 100 < spm_percent:
            return n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = batch["key"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()
        n, form, prefix, middle, output = zip(*map(one, keys, texts)) if keys else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [batch["key"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
             pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string(), safe=False)],
            ["key", "n", "form", "prefix_units", "middle_units", "output"])

    chosen = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_rows(chosen, work, "text",
                    "key long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output of `transformed` was made of."""
    def between(first: str, second: str) -> Column:
        start = F.locate(first, output) + len(first)
        return F.substr(output, start, F.locate(second, output) - start)

    def after(mark: str) -> Column:
        return F.substr(output, F.locate(mark, output) + len(mark))

    p, s, m = marks.prefix, marks.suffix, marks.middle
    return (
        F.when(form == "psm", F.concat(between(p, s), after(m), between(s, m)))
        .when(form == "spm", F.concat(between(p, m), after(m), between(s, p)))
        .otherwise(output)
    )
