"""Secret scan over a ledger of blobs: every text is scanned once for each version of each rule.

A version of a file is a row (path, ..., text). Its blob is the SHA-256 of the
text, so a text that stands under many paths or in many historical versions is
one blob. The ledger holds a row for each (blob, rule, rule version) that was
scanned, with the spans found, also when there were none. A scan

1. gives each version its blob;
2. leaves out the pairs of blob and rule version that the ledger has;
3. scans one copy of each blob that is left, for the rules it is new to;
4. appends the outcome to the ledger;
5. joins the ledger's spans to all versions.

NULL texts count as empty. Rows may repeat: each is a version of its own and
gets the spans of its blob. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamina.llm.common import (
    all_but, bounded_batches, free_name, quoted, release, repeated, slices, with_mark, written,
)

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans of `pattern` whose `group` has at least `least` characters.

    `near` holds pieces of which a text with a match has at least one; it only
    saves time. A changed rule needs a new `version`.
    """

    name: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    any_case: bool = False
    near: tuple[str, ...] = ()

    def spans(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.near and not any(piece in (lower if self.any_case else text) for piece in self.near):
            return []
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        return [m.span() for m in re.finditer(self.pattern, text, flags)
                if m.end(self.group) - m.start(self.group) >= self.least]


# Fixed patterns and lengths. A run of hexadecimal digits is as long as it can
# be, so asking for 24 in the pattern finds what a later check would keep; the
# same holds for an access key, but not for an assignment.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         6, group=2, any_case=True, near=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20, near=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)


def address(text: str = "text") -> Column:
    """The content address of a version; a NULL text is an empty one."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def pending(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """One row for each blob that some rule has not seen: blob, text, and the numbers of those rules.

    Where there is a ledger, addresses are compared first: of blobs that are known no text is shuffled.
    """
    everything = list(range(len(rules)))
    addressed = versions.select(address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def one_each(rows):
        # Only texts whose address comes again are shuffled; they collapse in each task before, so a blob with a
        # third of all rows is no hot key.
        told = with_mark(rows, ["blob"], repeated(rows, ["blob"]), "again")
        copies = told.where("again").groupBy("blob").agg(F.first("text").alias("text"))
        return told.where("again IS NULL").select("blob", "text").unionByName(copies)

    if ledger is None:
        return one_each(addressed).withColumn("todo", F.array(*map(F.lit, everything)))
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    done = (
        ledger.where(F.array_contains(wanted, F.struct("rule", "version")))
        .groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))  # at most one for each rule
    )
    open_rules = F.filter(
        F.array(*map(F.lit, everything)), lambda i: ~F.array_contains(F.col("done"), F.get(wanted, i)))
    unseen = (
        addressed.select("blob").distinct().join(done, "blob", "left")
        .withColumn("todo", F.when(F.col("done").isNull(), F.array(*map(F.lit, everything))).otherwise(open_rules))
        .where(F.size("todo") > 0).select("blob", "todo")
    )
    unseen = written(unseen, "unseen")  # its size is known from then on: a small one is sent to all tasks
    return one_each(addressed.join(unseen.select("blob"), "blob", "left_semi")).join(unseen, "blob")


def scan(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for pending blobs."""
    def run(batches):
        release()
        for piece in slices(batches, "text"):
            out: dict[str, list] = {"blob": [], "rule": [], "version": [], "spans": []}
            rows = zip(piece["blob"].to_pylist(), piece["text"].to_pylist(), piece["todo"].to_pylist())
            for blob, text, numbers in rows:
                lower = text.lower()
                for rule in (rules[n] for n in numbers):
                    out["blob"].append(blob)
                    out["rule"].append(rule.name)
                    out["version"].append(rule.version)
                    out["spans"].append([{"start": s, "end": e} for s, e in rule.spans(text, lower)])
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("blob", pa.string()), ("rule", pa.string()), ("version", pa.int32()),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return todo.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text",
           first: bool = False) -> DataFrame:
    """Scan what the ledger at the path `ledger` has not seen, append it there, and return the whole ledger.

    `first` says that there is no ledger yet. A scan whose job fails before it
    is committed leaves nothing, and the next one does its work again.
    """
    spark = versions.sparkSession
    bounded_batches(spark)
    read = spark.read.schema(LEDGER)
    known = None if first else read.parquet(ledger)
    scan(pending(versions, known, rules, text), rules).write.mode("append").parquet(ledger)
    return read.parquet(ledger)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
             into: str = "found") -> DataFrame:
    """The versions with `found`: (start, order of the rule, end, kind) of all spans, by start and then rule.

    Only rows of blobs with spans are joined, and only they are shuffled where there are many; a hot one is joined
    by its address, which Spark splits over tasks.
    """
    blob, spans = free_name(versions, "blob"), free_name(versions, "spans")
    order = F.array_position(F.array(*[F.lit(f"{r.name}\n{r.version}") for r in rules]),
                             F.concat_ws("\n", "rule", "version")).cast("int")
    hits = (
        ledger.where(F.size("spans") > 0).withColumn("nr", order).where("nr > 0")
        .dropDuplicates(["blob", "rule", "version"])  # two updates at once may both have scanned a blob
        .groupBy("blob")  # a row for each rule
        .agg(F.array_sort(F.flatten(F.collect_list(F.transform(
            "spans", lambda s: F.struct(s["start"].alias("start"), F.col("nr").alias("nr"), s["end"].alias("end"),
                                        F.col("rule").alias("kind")))))).alias("found"))
    )
    hits = written(hits.select(F.col("blob").alias(blob), F.col("found").alias(spans)), "hits")
    marks = written(hits.select(F.xxhash64(quoted(blob)).alias("mark")).distinct(), "marks")
    told = free_name(versions, "told")
    marked = with_mark(versions.withColumn(blob, address(text)), [blob], marks, told)
    none = F.array().cast(hits.schema[spans].dataType)
    kept = all_but(versions, into)
    joined = marked.where(quoted(told)).join(hits, blob, "left").select(*kept, F.coalesce(F.col(spans), none).alias(into))
    return marked.where(quoted(told).isNull()).select(*kept, none.alias(into)).unionAll(joined)


def as_text(found) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text, found, mark: str = "[secret]") -> Column:
    """The text with each span replaced; spans that overlap or touch are replaced together."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, span):
        fresh, further = span["start"] > state["at"], span["end"] > state["at"]
        opens = fresh | (state["at"] == 0)
        kept = F.when(fresh, F.substring(text, state["at"] + 1, span["start"] - state["at"])).otherwise(F.lit(""))
        return F.struct(
            F.concat(state["out"], kept, F.when(opens, F.lit(mark)).otherwise(F.lit(""))).alias("out"),
            F.when(further, span["end"]).otherwise(state["at"]).alias("at"),
        )

    def finish(state):
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, finish))
