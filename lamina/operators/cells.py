"""Shares, small cells and group sizes over already reduced tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamina.contract import SMALL_CELL
from lamina.functions.measures import percentage


def share_within(df: DataFrame, group: str, value: str, into: str) -> DataFrame:
    """Percentage of `value` in its group. Meant for aggregates: one row per code."""
    total = F.sum(value).over(Window.partitionBy(group))
    return df.withColumn(into, percentage(F.col(value), total))


def distinct_members(df: DataFrame, groups: list[str], member: str, **measures: Column) -> DataFrame:
    """Reduce to one row per (groups, member) before counting members.

    The count of distinct members is then a plain count, and a large group is
    spread over its members instead of landing in one task.
    """
    return df.groupBy(*groups, member).agg(
        F.count(F.lit(1)).alias("nb_lignes"), *[column.alias(name) for name, column in measures.items()]
    )


def large_cells(df: DataFrame, size: str, k: int = SMALL_CELL) -> DataFrame:
    """Keep the cells that at least k persons share."""
    return df.where(F.col(size) >= k)


def hiding(df: DataFrame, quasi_identifiers: list[Column], k: int = SMALL_CELL) -> DataFrame:
    """How well persons hide among those who share these attributes, as one row.

    Persons who are alone with theirs, persons in groups of fewer than k, the
    smallest group, and the share of persons who are in groups of k or more.
    """
    names = [f"_q{i}" for i in range(len(quasi_identifiers))]
    groups = (
        df.select(*[c.alias(n) for c, n in zip(quasi_identifiers, names)])
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("personnes"))
    )
    alone, few = F.col("personnes") == 1, F.col("personnes") < k
    nobody = F.lit(0).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("personnes"), nobody).alias("personnes"),
        F.count(F.lit(1)).alias("groupes"),
        F.min("personnes").alias("plus_petit_groupe"),
        F.count_if(alone).alias("isolees"),
        F.coalesce(F.sum(F.when(few, F.col("personnes"))), nobody).alias("exposees"),
    ).withColumn("part_a_l_abri", percentage(F.col("personnes") - F.col("exposees"), F.col("personnes")))
