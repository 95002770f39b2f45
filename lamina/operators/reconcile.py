"""Two tables that should be the same: are they, and if not, which rows differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 16
_LOW = (1 << 32) - 1


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def digests(df: DataFrame, keys: list[str], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(_bucket, _rows, _low, _high): what the rows of each bucket of keys add up to, in any order.

    Hashes of whole rows are summed, in two halves that cannot overflow, so a row that is there twice counts
    twice. Two different buckets agree by chance once in 2**64. A task sends one line for each bucket.
    """
    whole = F.xxhash64(*keys, *columns, *[F.col(c).isNull() for c in (*keys, *columns)])
    return df.select(bucket_of(keys, buckets).alias("_bucket"), whole.alias("_hash")).groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col("_hash").bitwiseAND(_LOW)).alias("_low"),
        F.sum(F.shiftrightunsigned("_hash", 32)).alias("_high"),
    )


def differing_buckets(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str],
                      buckets: int = BUCKETS) -> list[int]:
    """The buckets in which two tables do not add up to the same: one scan of each side."""
    def side(df: DataFrame, sign: int) -> DataFrame:
        sums = digests(df, keys, columns, buckets)
        return sums.select("_bucket", *[(F.col(c) * sign).alias(c) for c in ("_rows", "_low", "_high")])

    added = side(left, -1).unionByName(side(right, 1)).groupBy("_bucket").agg(
        *[F.sum(c).alias(c) for c in ("_rows", "_low", "_high")])
    apart = added.where((F.col("_rows") != 0) | (F.col("_low") != 0) | (F.col("_high") != 0))
    return sorted(row[0] for row in apart.select("_bucket").collect())  # as many as there are buckets, at most


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str],
                buckets: int = BUCKETS) -> DataFrame:
    """Rows that one side holds more often than the other: `_n` below 0 for the left side, above for the right.

    Digests are compared first. Equal tables end there, with no row shuffled; of others only the rows of
    buckets that differ are opened and met with one another.
    """
    open_ = differing_buckets(left, right, keys, columns, buckets)
    bucket = bucket_of(keys, buckets)

    def rows(df: DataFrame, sign: int) -> DataFrame:
        return df.where(bucket.isin(open_)).select(*keys, *columns, F.lit(sign).cast("bigint").alias("_n"))

    both = rows(left, -1).unionAll(rows(right, 1))
    return both.groupBy(*keys, *columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
