"""Concatenate and cut: token ids of all documents in one row, cut into windows of a fixed length.

Two passes of prefix sums give every document its place in that row:

1. A pass encodes each partition of the documents once and writes, for each
   document, its ids and its place inside the partition. The totals of the
   partitions, one row each, are summed up to the base of each partition.
2. A pass adds the base to the place and cuts at the borders of the windows. A
   window that lies inside what one task reads is written whole; the two at the
   ends of a stretch are written as boundary records, and the boundary records
   of a window, which has `size` ids at most, are put together by its number.

The order of documents is that of the partitions and of the rows in them; no
text is shuffled. Windows have `size` ids. What is left over at the end, less
than one window, is cut into windows of falling powers of two: no window needs
padding, whether it is padded to `size` or to the next power of two.

Defined results: a NULL text counts as empty, an empty text is its end id alone
(with `end_id=None` it has no ids and no piece). Rows without a key and repeated
rows are packed like all others. Only key and text are read, so other columns
may have any name. A document longer than a window has a piece in each window
that it reaches; an empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lamina.llm.common import bounded_batches, shared_folder, slices, written

SIZE = 4096
BATCH_IDS = 1 << 20
SEGMENT = pa.struct([(name, pa.int64()) for name in ("key", "start", "length", "tokens", "offset")])
PIECES = "array<struct<key: long, start: long, length: long, tokens: long, offset: long>>"


def encoded(df: DataFrame, encoder, key: str = "doc_id", text: str = "text", end_id: int | None = 2) -> DataFrame:
    """(part, at, key, tokens, ids): the ids of each document and their place in what its task has read."""
    bounded_batches(df.sparkSession)
    end = b"" if end_id is None else np.array([end_id], f"<u{encoder.width}").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for piece in slices(batches, "text"):
            ids = [own + end for own in encoder(piece["text"])]
            tokens = np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.width
            ends = at + np.cumsum(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part)), pa.array(ends - tokens), piece["key"], pa.array(tokens),
                 pa.array(ids, pa.binary())], ["part", "at", "key", "tokens", "ids"])
            at = int(ends[-1]) if len(ids) else at

    chosen = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return chosen.mapInArrow(work, "part long, at long, key long, tokens long, ids binary")


def placed(stream: DataFrame) -> tuple[DataFrame, int]:
    """The written stream with the place of each document among all ids, and the number of all ids."""
    totals = stream.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    # One row for each task of the first pass.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "bases")
    total = bases.agg(F.sum("tokens")).first()[0] or 0
    return stream.join(bases.select("part", "base"), "part").withColumn("place", F.col("base") + F.col("at")), total


class Windows:
    """The borders: windows of `size`, then the rest as falling powers of two."""

    def __init__(self, total: int, size: int):
        self.size, self.full = size, total // size
        rest = total % size
        lengths = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        self.starts = [self.full * size + sum(lengths[:k]) for k in range(len(lengths))]
        self.lengths = lengths

    def at(self, place: int) -> tuple[int, int, int]:
        """Number, first place and length of the window that holds a place."""
        number = place // self.size
        if number < self.full:
            return number, number * self.size, self.size
        nth = max(k for k, start in enumerate(self.starts) if start <= place)
        return self.full + nth, self.starts[nth], self.lengths[nth]


class Cutter:
    """Cuts one stretch of documents after the other; holds the ids of one unfinished window."""

    def __init__(self, windows: Windows):
        self.windows, self.next = windows, None
        self.done: list[tuple] = []
        self.clear()

    def clear(self) -> None:
        self.ids, self.segments, self.window = [], [], None

    def flush(self) -> None:
        """The window so far: whole, or a boundary record."""
        if self.window is not None:
            number, start, length = self.window
            ids = np.concatenate(self.ids)
            offset = self.segments[0][4]
            self.done.append((number, offset, len(ids) == length, ids, self.segments))
        self.clear()

    def add(self, place: int, key: int | None, ids: np.ndarray) -> None:
        if place != self.next:
            self.flush()
        start, tokens = 0, len(ids)
        while start < tokens:
            if self.window is None:
                self.window = self.windows.at(place + start)
            number, first, length = self.window
            offset = place + start - first
            take = min(tokens - start, length - offset)
            self.ids.append(ids[start : start + take])
            self.segments.append((key, start, take, tokens, offset))
            start += take
            if offset + take == length:
                self.flush()
        self.next = place + tokens

    def batch(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        segments = [s for d in done for s in d[4]]
        fields = [pa.array(column, pa.int64()) for column in zip(*segments)]
        sizes = np.cumsum([0, *(len(d[4]) for d in done)])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(SEGMENT)))
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.bool_()), pa.array([d[3].astype("<u4").tobytes() for d in done], pa.binary()),
             lists], ["sequence_id", "offset", "whole", "ids", "pieces"])


def sequences(df: DataFrame, encoder, size: int = SIZE, key: str = "doc_id", text: str = "text",
              end_id: int | None = 2) -> DataFrame:
    """(sequence_id, length, ids, pieces): the packed sequences.

    `ids` are little-endian unsigned 32-bit integers. `pieces` tells, in order,
    which document (`key`, its number of ids `tokens`) stands at `offset`: its
    ids from `start` on, `length` of them.
    """
    spark = df.sparkSession
    stream = written(encoded(df, encoder, key, text, end_id), "token-stream")
    rows, total = placed(stream)
    windows, kind = Windows(total, size), f"<u{encoder.width}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = Cutter(windows), 0
        for batch in batches:
            for place, own, ids in zip(batch["place"].to_pylist(), batch["key"].to_pylist(), batch["ids"]):
                own_ids = np.frombuffer(ids.as_buffer(), kind)
                cutter.add(place, own, own_ids)
                held += len(own_ids)
                if held >= BATCH_IDS and cutter.done:
                    yield cutter.batch()
                    held = 0
        cutter.flush()
        if cutter.done:
            yield cutter.batch()

    folder = shared_folder(spark, "windows")
    cuts = rows.where("tokens > 0").select("place", "key", "ids").mapInArrow(
        cut, f"sequence_id long, offset long, whole boolean, ids binary, pieces {PIECES}")
    cuts.write.partitionBy("whole").parquet(folder)
    found = spark.read.schema(cuts.schema).option("basePath", folder).parquet(folder)

    # A window has `size` boundary records at most, as each holds an id.
    borders = found.where("NOT whole").groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("records"))
    joined = borders.select(
        "sequence_id",
        F.aggregate("records", F.lit(b""), lambda all_, r: F.concat(all_, r["ids"])).alias("ids"),
        F.flatten("records.pieces").alias("pieces"))
    every = found.where("whole").select("sequence_id", "ids", "pieces").unionByName(joined)
    return every.select("sequence_id", (F.length("ids") / 4).cast("long").alias("length"), "ids", "pieces")


def pieces(packed: DataFrame) -> DataFrame:
    """(key, start, length, ids_crc32, tokens, sequence_id, offset): each piece, its checksum read from its sequence."""
    rows = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return rows.select("p.key", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.tokens", "sequence_id", "p.offset")
