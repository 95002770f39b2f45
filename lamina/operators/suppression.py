"""Small cells that a reader could work out from what is published, and what to hold back besides.

A table of counts is published with margins: totals over some of its
dimensions. Cells below k are held back. Of a line of cells that add up to a
published total, what is held back is the total less the cells shown. So a
single cell held back is no secret, nor is a group of them that holds fewer
than k persons together. `hold_back` adds the smallest cells of such a line, round by
round, until no line tells; a line that has none left holds back its total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamina.contract import SMALL_CELL
from lamina.session import new_folder

HELD = "_retenue"


def line_name(margin: list[str], dims: list[str]) -> Column:
    """A line by its place in each dimension of the margin, the others summed over."""
    parts = [
        F.concat(F.lit(f"{dim}="), F.coalesce(F.col(dim).cast("string"), F.lit("")))
        if dim in margin else F.lit(f"{dim}=*")
        for dim in dims
    ]
    return F.concat_ws("|", *parts)


def lines(cells: DataFrame, dims: list[str], margins: list[list[str]]) -> DataFrame:
    """Each cell once for each line it lies in."""
    names = F.array(*[line_name(margin, dims) for margin in margins])
    return cells.withColumn("ligne", F.explode(names))


def telling_lines(cells: DataFrame, dims: list[str], margins: list[list[str]], size: str, k: int = SMALL_CELL) -> DataFrame:
    """(ligne, retenues, effectif): lines whose held-back cells follow from the total: one cell, or fewer than k persons."""
    held = F.col(HELD) == 1
    sums = lines(cells, dims, margins).groupBy("ligne").agg(
        F.count_if(held).alias("retenues"), F.sum(F.when(held, F.col(size))).alias("effectif"))
    return sums.where((F.col("retenues") > 0) & ((F.col("retenues") == 1) | (F.col("effectif") < k)))


def small_cells(cells: DataFrame, size: str, k: int = SMALL_CELL) -> DataFrame:
    """The cells with a mark at those that are too small to be shown."""
    return cells.withColumn(HELD, (F.col(size) < k).cast("int"))


def recoverable(marked: DataFrame, dims: list[str], margins: list[list[str]], size: str, k: int = SMALL_CELL) -> DataFrame:
    """The held-back cells that lie in a line that tells, with the number of such lines."""
    telling = telling_lines(marked, dims, margins, size, k).select("ligne")
    found = lines(marked.where(F.col(HELD) == 1), dims, margins).join(telling, "ligne", "left_semi")
    return found.groupBy(*dims, size).agg(F.count(F.lit(1)).alias("nb_lignes"))


def hold_back(cells: DataFrame, dims: list[str], margins: list[list[str]], size: str,
              k: int = SMALL_CELL) -> tuple[DataFrame, DataFrame]:
    """The cells with all marks that are needed, and the lines whose total must be held back as well.

    Each round marks the smallest shown cell of every line that tells. There are as many
    rounds as a line has cells at most; each is written, so that plans do not grow.
    """
    spark = cells.sparkSession

    def written(df: DataFrame) -> DataFrame:
        folder = new_folder(spark, "cells")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    marked = written(small_cells(cells, size, k))
    own = [F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}")) for d in dims]
    same = reduce(lambda a, b: a & b, own)
    while True:
        telling = telling_lines(marked, dims, margins, size, k).select("ligne")
        shown = lines(marked.where(F.col(HELD) == 0), dims, margins).join(telling, "ligne", "left_semi")
        first = F.row_number().over(Window.partitionBy("ligne").orderBy(size, *dims))
        more = written(shown.withColumn("_rang", first).where("_rang = 1").select(*dims).distinct())
        if more.isEmpty():
            return marked, telling
        added = marked.alias("a").join(more.withColumn("_plus", F.lit(1)).alias("b"), same, "left")
        mark = F.when(F.col("b._plus") == 1, 1).otherwise(F.col(f"a.{HELD}")).cast("int")
        marked = written(added.select(*[F.col(f"a.{c}") for c in marked.columns if c != HELD], mark.alias(HELD)))
