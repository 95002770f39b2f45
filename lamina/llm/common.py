"""What the operators share: reading, writing between steps, and batches bounded in bytes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Rows of text are large: hand them to Python in small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Python workers on this machine find the package where the driver has it; a cluster gets it with --py-files.
    own = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in own.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (own, ROOT)))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder all executors see: under `spark.checkpoint.dir`, else under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and lost with no executor."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def quoted(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """A name like `stem` that no column has, in whatever case Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def all_but(df: DataFrame, *names: str) -> list[Column]:
    """The columns of other names, as Spark compares names."""
    left_out = {name.lower() for name in names}
    return [quoted(c) for c in df.columns if c.lower() not in left_out]


def own_id(key: str, text: str) -> Column:
    """The id of a row; for one without, a negative number of its text, so that copies have the same."""
    return F.coalesce(F.col(key).cast("long"), -1 - F.xxhash64(text).bitwiseAND((1 << 62) - 1))


def repeated(rows: DataFrame, names: list[str]) -> DataFrame:
    """(mark): 64 bits of the values of these columns that more than one row has, as a table whose size is known.

    Different values may share a mark: it tells which rows need not be compared, never which are alike.
    """
    marks = rows.groupBy(F.xxhash64(*map(quoted, names)).alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    return written(marks.where("n > 1").select("mark"), "repeated")


def with_mark(rows: DataFrame, names: list[str], marks: DataFrame, into: str) -> DataFrame:
    """The rows, with true in `into` where the mark of these columns is among the marks, else NULL.

    A small table of marks is sent to all tasks, and then no row is shuffled.
    """
    told = marks.select(F.col("mark").alias(f"{into}_mark"), F.lit(True).alias(into))
    return rows.join(told, F.xxhash64(*map(quoted, names)) == F.col(f"{into}_mark"), "left").drop(f"{into}_mark")


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits with the bit of each hash set. What reaches the driver are its words that are not 0."""
    spot = F.shiftrightunsigned("hash", 64 - bits)
    words = hashes.groupBy(F.shiftright(spot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - bits}) & 63 AS INT))")).alias("bits"))
    got = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint64)


def known(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    spot = hashes >> np.uint64(64 - bits)
    return (table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def perhaps(ids: DataFrame, bits: int = 26) -> Callable[[Column], Column]:
    """A test of a column: false only for values that are not among the longs `id`, true for all that are.

    The bits are sent to all tasks, 8 MB however many ids there are. Of n ids a share of n / 2**bits of all other
    values passes as well, so what passes is to be compared exactly.
    """
    table = ids.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64("id").alias("hash")), bits))

    @F.pandas_udf("boolean")
    def seen(values: pd.Series) -> pd.Series:
        return pd.Series(known(table.value, bits, values.to_numpy().view(np.uint64)))

    return lambda column: seen(F.xxhash64(column))


def open_folder(uri: str):
    """The Arrow file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of one text column; a longer row is a piece of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


_held: dict = {}


def held(owner: tuple, make: Callable):
    """What a worker process keeps from task to task: one thing at a time, so that stages do not add up in memory."""
    if owner not in _held:
        release()
        _held[owner] = make()
    return _held[owner]


def release() -> None:
    """Forget what another operator has left in this worker process."""
    _held.clear()


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, schema: str) -> DataFrame:
    """`mapInArrow` over slices bounded in the bytes of one column."""
    def run(batches):
        release()
        for piece in slices(batches, column):
            yield work(piece)

    return df.mapInArrow(run, schema)
