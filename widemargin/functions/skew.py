"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key above this many rows is cut into slices of about this size.
ROWS_PER_SLICE = 1_000_000
# The list of hot keys is broadcast, so its length is bounded: 16 MB.  A key beyond
# the bound holds less than a millionth of all rows, which is one slice of 10^12 rows.
MAX_HOT_KEYS = 1_000_000


def hot_from_counts(counts: DataFrame, key: str, count_col: str,
                    rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(key, slices) for keys above ``rows_per_slice`` rows, from known counts."""
    return (counts.where(F.col(count_col) > rows_per_slice)
            .select(key, F.ceil(F.col(count_col) / rows_per_slice).cast("int").alias("slices"))
            .orderBy(F.col("slices").desc(), key)
            .limit(MAX_HOT_KEYS))


def hot_keys(df: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(key, slices) measured on ``df`` with a map-side-combined count."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return hot_from_counts(counts, key, "n_rows", rows_per_slice)


def with_slice(df: DataFrame, key: str, spread_by: str, hot: DataFrame) -> DataFrame:
    """Adds _slice: the part of a hot key a row belongs to, 0 for other keys."""
    return (df.join(F.broadcast(hot), key, "left")
            .withColumn("_slice", F.when(F.col("slices").isNull(), F.lit(0))
                        .otherwise(F.pmod(F.xxhash64(spread_by), F.col("slices")).cast("int")))
            .drop("slices"))


def salted_join(big: DataFrame, other: DataFrame, key: str, spread_by: str,
                hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where rows of hot keys are spread over slices.

    ``spread_by`` is a column of ``big`` with many values inside one key.  The
    rows of ``other`` are repeated once per slice, for hot keys only, so every
    pair still meets exactly once.  A ``big`` that already has its _slice, for the
    same ``hot``, keeps its partitioning.  ``how`` is "inner" or "left".
    """
    if hot is None:
        hot = hot_keys(big, key)
    left = big if "_slice" in big.columns else with_slice(big, key, spread_by, hot)
    hot = F.broadcast(hot)
    right = (other.join(hot, key, "left")
             .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)))
             .drop("slices"))
    return left.join(right, [key, "_slice"], how).drop("_slice")
