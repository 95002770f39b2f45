"""Keeping the latest version of a re-delivered row, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def version_order(df: DataFrame, keys: list[str], first: list[str]) -> list[str]:
    """The ordering columns: the named ones, then every other as a tie-break."""
    return first + [c for c in df.columns if c not in first and c not in keys]


def latest_version(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by `order`, NULLs lowest, columns kept as they are.

    The row wins as a whole, so a NULL in the latest delivery stays NULL. The
    filter on the rank lets Spark keep one row per key on the map side, so a
    key with many deliveries reaches the shuffle as one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")


def superseded_versions(df: DataFrame, keys: list[str], order: list[str], repeated: DataFrame | None = None) -> DataFrame:
    """The rows `latest_version` leaves out, exact copies counted in `nb_lignes`.

    Keys delivered once, nearly all of them, stop at a count of the key column.
    No window sees a whole key, and a key with most of the rows is split in both joins.
    `repeated` holds the keys of several rows where they are at hand: a small table of
    them is sent to all tasks, and rows of other keys are not shuffled.
    """
    repeated = repeated_keys(df, keys) if repeated is None else repeated
    versions = (
        df.join(repeated, keys, "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("nb_lignes"))
    )
    stamp = F.struct(*[F.col(c) for c in order])
    best = versions.groupBy(*keys).agg(F.max(stamp).alias("_best"))
    left_over = F.col("nb_lignes") - stamp.eqNullSafe(F.col("_best")).cast("int")
    return (
        versions.join(best, keys).withColumn("nb_lignes", left_over).where(F.col("nb_lignes") > 0).drop("_best")
    )
