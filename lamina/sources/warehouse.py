"""Tables of the warehouse, each a row of versions.

    <root>/<layer>/<table>/data/_version=<id>/[<column>=<value>/]*.parquet
    <root>/<layer>/<table>/log/v=<number>/part-*.txt

A write puts its files under an id of its own, then adds one line to the log:
the schema, the folders that make up the table from now on, and the versions of
the tables it was made from. That line is one file, which Spark's commit moves
into place as its last step. Readers open what the newest line names. So whoever
reads finds the old or the new table whole, whenever a writer ends; folders
that no line names are never looked at, and `sweep` removes them.

A table that is divided by a column can be renewed value by value: a new line
names new folders for some values and the old ones for all others. Two versions
therefore tell by their folders where they differ, and only those are compared.

One writer at a time is assumed for each table; of two at once, the one whose
line sorts last wins whole. Logs of the runs (layer `ops`) are plain folders
that only grow.
"""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from lamina.contract import DISCARDED, KEPT, LEDGER
from lamina.session import new_folder, prepare
from lamina.sources.folders import get_text, hadoop, names, put_text

LOG = logging.getLogger(__name__)

OPS = "ops"
LOT = "_lot"
VERSION = "_version"


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    number: int
    schema: StructType
    parts: tuple[str, ...] = ()            # folders below `data`
    whole: tuple[str, ...] = ()            # folders of versions of which every part is in use
    column: str | None = None              # what the table is divided by
    sources: dict = field(default_factory=dict)  # "layer/table" -> version it was made from

    def line(self) -> str:
        return json.dumps({
            "schema": self.schema.jsonValue(), "parts": self.parts, "whole": self.whole, "column": self.column,
            "sources": self.sources})

    @staticmethod
    def of(number: int, line: str) -> Snapshot:
        told = json.loads(line)
        return Snapshot(
            number, StructType.fromJson(told["schema"]), tuple(told["parts"]), tuple(told["whole"]), told["column"],
            told["sources"])

    def value(self, part: str) -> str:
        """The value of the dividing column that a folder holds."""
        return part.rpartition(f"{self.column}=")[2]


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    root: str
    # Log lines already read, by their file: a line never changes.
    lines: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        prepare(self.spark)

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    # ---- versions

    def log(self, layer: str, table: str) -> str:
        return f"{self.path(layer, table)}/log"

    def line_file(self, layer: str, table: str, number: int) -> str | None:
        """The file of a version's line; of two lines of one number the last counts."""
        folder = f"{self.log(layer, table)}/v={number:010d}"
        found = names(self.spark, folder)
        return f"{folder}/{found[-1]}" if found else None

    def newest(self, layer: str, table: str) -> tuple[int, str | None]:
        """Number and line file of the newest version. A number whose line never came is passed over."""
        numbers = (re.fullmatch(r"v=(\d+)", name) for name in reversed(names(self.spark, self.log(layer, table))))
        for number in (int(found[1]) for found in numbers if found):
            file = self.line_file(layer, table, number)
            if file:
                return number, file
        return 0, None

    def snapshot(self, layer: str, table: str, number: int | None = None) -> Snapshot | None:
        """A version of a table, the newest by default; None where there is none."""
        number, file = self.newest(layer, table) if number is None else (number, self.line_file(layer, table, number))
        if file is None:
            return None
        if file not in self.lines:
            self.lines[file] = Snapshot.of(number, get_text(self.spark, file))
        return self.lines[file]

    def version(self, layer: str, table: str) -> int:
        """The number of the newest version, 0 where there is none."""
        return self.newest(layer, table)[0]

    def versions(self, *names: str) -> dict[str, int]:
        """The newest version of each "layer/table"."""
        return {name: self.version(*name.split("/")) for name in names}

    def commit(self, layer: str, table: str, snapshot: Snapshot) -> None:
        """The last step of a write: the line that makes its files the table."""
        folder = f"{self.log(layer, table)}/v={snapshot.number:010d}"
        name = put_text(self.spark, folder, snapshot.line())
        if name:
            self.lines[f"{folder}/{name}"] = snapshot

    # ---- reading

    def frame(self, layer: str, table: str, snapshot: Snapshot, parts: tuple[str, ...] | None = None) -> DataFrame:
        """What the folders of a version hold, or some of them."""
        data, wanted = f"{self.path(layer, table)}/data", snapshot.parts if parts is None else parts
        if not wanted:
            return self.spark.createDataFrame([], snapshot.schema)
        reader = self.spark.read.schema(snapshot.schema)
        if parts is None and len(snapshot.whole) == 1 and all(p.startswith(snapshot.whole[0]) for p in wanted):
            return reader.parquet(f"{data}/{snapshot.whole[0]}").select(*snapshot.schema.names)
        if parts is None:
            complete = tuple(f"{folder}/" for folder in snapshot.whole)
            wanted = [*snapshot.whole, *(p for p in wanted if not p.startswith(complete))] if complete else wanted
        found = reader.option("basePath", data).parquet(*[f"{data}/{p}" for p in wanted])
        return found.select(*snapshot.schema.names)

    def read(self, layer: str, table: str, lots: bool = False) -> DataFrame:
        """The newest version. The column that only divides the files is left out unless asked for."""
        if layer == OPS:
            return self.spark.read.parquet(self.path(layer, table))
        snapshot = self.snapshot(layer, table)
        if snapshot is None:
            # The error that any missing folder gives.
            return self.spark.read.parquet(self.path(layer, table) + "/data")
        found = self.frame(layer, table, snapshot)
        return found if lots or snapshot.column != LOT else found.drop(LOT)

    def has(self, layer: str, table: str) -> bool:
        if layer != OPS:
            return self.newest(layer, table)[1] is not None
        try:
            self.read(layer, table)
        except AnalysisException:
            return False
        return True

    def read_or_empty(self, layer: str, table: str, schema: str) -> DataFrame:
        """A table nothing was ever loaded into reads as empty."""
        return self.read(layer, table) if self.has(layer, table) else self.spark.createDataFrame([], schema)

    def changes(self, layer: str, table: str, since: int) -> tuple[DataFrame, DataFrame] | None:
        """Rows of the folders that are no longer in use, and of those that came, since a version.

        Rows of a folder that was written anew are in both; `changed_rows` tells which really differ. None if
        the old version is not known any more.
        """
        old, new = self.snapshot(layer, table, since), self.snapshot(layer, table)
        if old is None or new is None:
            return None
        gone, come = (tuple(sorted(set(a.parts) - set(b.parts))) for a, b in ((old, new), (new, old)))
        return self.frame(layer, table, old, gone), self.frame(layer, table, new, come)

    def changed_values(self, layer: str, table: str, since: int) -> list[str]:
        """Values of the dividing column whose folders are not the ones of that version: names only, no data."""
        old, new = self.snapshot(layer, table, since), self.snapshot(layer, table)
        return sorted({new.value(p) for p in set(old.parts) ^ set(new.parts)})

    # ---- writing

    def put(self, layer: str, table: str, df: DataFrame, column: str | None, sources: dict | None,
            values: list[str] | None = None) -> tuple[Snapshot, str]:
        """Write files and their line. With `values`, only those values of the column are renewed."""
        ident = f"{VERSION}={uuid.uuid4().hex[:12]}"
        folder = f"{self.path(layer, table)}/data/{ident}"
        old = self.snapshot(layer, table)
        writer = df.write.option("compression", "zstd")
        if column is None:
            writer.parquet(folder)
            parts = [ident]
        else:
            writer.partitionBy(column).parquet(folder)
            parts = [f"{ident}/{name}" for name in names(self.spark, folder) if "=" in name]
        whole, number = [ident] if parts else [], old.number + 1 if old else 1
        if values is not None and old:
            renewed = set(values)
            kept = [p for p in old.parts if old.value(p) not in renewed]
            lost = {p.split("/")[0] for p in set(old.parts) - set(kept)}
            whole += [folder for folder in old.whole if folder not in lost]
            parts += kept
        made = Snapshot(number, df.schema, tuple(sorted(parts)), tuple(whole), column, sources or {})
        self.commit(layer, table, made)
        return made, folder

    def replace(self, layer: str, table: str, df: DataFrame, partition: str | None = None,
                sources: dict | None = None) -> int:
        """Rewrite a whole table and return its number of rows, counted while writing."""
        seen = Observation()
        self.put(layer, table, df.observe(seen, F.count(F.lit(1)).alias("n")), partition, sources)
        return seen.get["n"]

    def renew(self, layer: str, table: str, df: DataFrame, column: str, values: list[str],
              sources: dict | None = None) -> int:
        """Replace the rows of the given values of the dividing column; all other folders stay as they are."""
        if not values:
            self.restate(layer, table, sources)
            return 0
        seen = Observation()
        self.put(layer, table, df.observe(seen, F.count(F.lit(1)).alias("n")), column, sources, values)
        return seen.get["n"]

    def restate(self, layer: str, table: str, sources: dict | None) -> None:
        """The same folders, now known to follow from other versions of their sources."""
        now = self.snapshot(layer, table)
        if now.sources != (sources or {}):
            self.commit(layer, table, Snapshot(now.number + 1, now.schema, now.parts, now.whole, now.column, sources or {}))

    def append(self, layer: str, table: str, df: DataFrame) -> int:
        """Add rows to a log of the runs, counted while writing."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.path(layer, table))
        return seen.get["n"]

    def scratch(self, df: DataFrame, label: str) -> DataFrame:
        """A frame used more than once in a run, as files in the shared work folder."""
        folder = new_folder(self.spark, label)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    # ---- judged feeds

    def replace_judged(self, table: str, judged: DataFrame, sources: dict | None = None) -> int:
        """Write a judged feed once, kept and rejected rows side by side, divided by lot.

        Within a file the motifs stand together, so a reader of either side skips the pages of the other.
        """
        seen = Observation()
        counted = judged.observe(seen, F.count_if(F.col("_motif") == KEPT).alias("n"))
        self.put("silver", table, in_lots(counted), LOT, sources)
        return seen.get["n"]

    def judged(self, table: str, lots: bool = False) -> DataFrame:
        return self.read("silver", table, lots)

    def silver(self, table: str, lots: bool = False) -> DataFrame:
        """Kept rows of a judged feed."""
        return self.judged(table, lots).where(F.col("_motif") == KEPT).drop("_motif", "_detail")

    # ---- days

    def replay(self, layer: str, table: str, df: DataFrame, days: list) -> dict:
        """Replace the given days and no other, all at once; return rows per day.

        A day that was dropped again without any row is emptied; a day not given is not touched.
        """
        divided = df.hint("rebalance", "_jour_depot")
        made, folder = self.put(layer, table, divided, "_jour_depot", None, [str(day) for day in days])
        if not any(p.startswith(folder.rpartition("/")[2]) for p in made.parts):
            return dict.fromkeys(days, 0)
        # One row for each day, counted from footers.
        counted = partition_volumes(self.spark.read.schema(df.schema).parquet(folder), "_jour_depot").collect()
        return dict.fromkeys(days, 0) | {row["_jour_depot"]: row["lignes"] for row in counted}

    def loaded_days(self, feeds) -> DataFrame:
        """(feed, jour) that hold rows, from the names of the folders in use."""
        found = []
        for feed in feeds:
            snapshot = self.snapshot("bronze", feed)
            if snapshot and snapshot.column == "_jour_depot":
                found += [(feed, value) for value in {snapshot.value(p) for p in snapshot.parts}]
        names = self.spark.createDataFrame(sorted(found), "feed string, jour string")
        return names.select("feed", F.try_to_date("jour").alias("jour")).where("jour IS NOT NULL")

    # ---- the run ledger

    def record(self, **entry) -> None:
        """Append one line to the run ledger. A ledger that fails never fails the run."""
        try:
            line = self.spark.createDataFrame([entry], LEDGER)
            line.coalesce(1).write.mode("append").parquet(self.path(OPS, "executions"))
        except Exception:
            LOG.warning("run ledger not written", exc_info=True)

    def discarded(self, source: str) -> DataFrame:
        rejects = self.read("quarantaine", "rejets")
        return rejects.where((F.col("source") == source) & (F.col("action") == DISCARDED))

    # ---- what is no longer in use

    def sweep(self, older_than_s: float = 3600.0) -> list[str]:
        """Remove folders that neither the newest version of a table names nor a version another table was made from.

        Younger folders stay: a write that has not come to its line yet may own them. Returns what was removed.
        Needs Hadoop's file system, which only a classic session gives access to; reading and writing do not.
        """
        system = hadoop(self.spark, self.root)[1]
        limit = (time.time() - older_than_s) * 1000

        def inside(folder: str) -> list:
            path = hadoop(self.spark, folder)[0]
            return list(system.listStatus(path)) if system.exists(path) else []

        tables = [(layer.getPath().getName(), table.getPath().getName())
                  for layer in inside(self.root) if layer.isDirectory() and layer.getPath().getName() != OPS
                  for table in inside(f"{self.root}/{layer.getPath().getName()}") if table.isDirectory()]
        newest = {name: self.snapshot(*name) for name in tables}
        alive = {name: {snapshot.number} for name, snapshot in newest.items() if snapshot}
        for snapshot in filter(None, newest.values()):
            for source, number in snapshot.sources.items():
                alive.get(tuple(source.split("/")), set()).add(number)
        removed = []

        def remove(status, name: str) -> None:
            if status.getModificationTime() <= limit:
                system.delete(status.getPath(), True)
                removed.append(name)

        for layer, table in tables:
            own, at = f"{layer}/{table}", self.path(layer, table)
            numbers = alive.get((layer, table), set())
            snapshots = [self.snapshot(layer, table, n) for n in numbers]
            used = {p for snapshot in snapshots if snapshot for p in snapshot.parts}
            for status in inside(f"{at}/data"):
                folder = status.getPath().getName()
                if not any(p.split("/")[0] == folder for p in used):
                    remove(status, f"{own}/{folder}")
                elif folder not in used:
                    for part in inside(f"{at}/data/{folder}"):
                        name = f"{folder}/{part.getPath().getName()}"
                        if part.isDirectory() and name not in used:
                            remove(part, f"{own}/{name}")
            for status in inside(f"{at}/log"):
                number = re.fullmatch(r"v=(\d+)", status.getPath().getName())
                if number and int(number[1]) not in numbers and int(number[1]) < max(numbers, default=0):
                    remove(status, f"{own}/{number[0]}")
        return removed


def in_lots(df: DataFrame) -> DataFrame:
    """By lot within each task, motifs together: a whole feed is not shuffled for its files.

    Each task writes a file for each lot it has, so files grow in number with the tasks, as the rows do.
    """
    return df.sortWithinPartitions(LOT, "_motif")


def changed_rows(gone: DataFrame, come: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side holds more often than the other, with the difference `_n`."""
    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*columns, F.lit(sign).cast("bigint").alias("_n"))

    sums = signed(gone, -1).unionAll(signed(come, 1)).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return sums.where(F.col("_n") != 0)


def partition_volumes(df: DataFrame, partition: str) -> DataFrame:
    return df.groupBy(partition).agg(F.count(F.lit(1)).alias("lignes"))


def latest_lines(ledger: DataFrame, n: int = 5) -> DataFrame:
    return ledger.orderBy(F.col("demarre_a").desc(), "run_id", "etape").limit(n)
