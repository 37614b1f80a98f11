"""Parquet storage of matrices, vocabularies and the state of a run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from widemargin.functions import skew

STATE_TABLES = ("pool", "pool_w", "theta_history", "run_iterations")
# what a run needs besides, to go on where it stopped; facts is written last and marks the state as whole
RESUME_TABLES = ("coefficients", "weights", "duals", "gradient", "facts")


def write_artifact(df: DataFrame, path: str, feature_buckets: int | None = None, count_keys: tuple[str, ...] = ()) -> str:
    """Store a table.  With ``feature_buckets`` the files are laid out by feature
    range hash, so that a reader of a few features opens a few folders only.

    For each of ``count_keys`` the rows per key are counted once, from that column of the stored files, and
    kept beside the table; joins by the key read them (``hot_of``) in place of a count of their own.
    """
    if feature_buckets:
        bucketed = df.withColumn("feature_bucket", F.pmod("feature_id", F.lit(feature_buckets)).cast("int"))
        # rows of one bucket stay spread over many tasks: no shuffle before the write
        bucketed.write.mode("overwrite").partitionBy("feature_bucket").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    for key in count_keys:
        stored = df.sparkSession.read.parquet(path)
        stored.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(_counts_path(path, key))
    return path


def _counts_path(path: str, key: str) -> str:
    return f"{path.rstrip('/')}_counts/{key}"


def key_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, n_rows) of an artefact that was written with ``key`` among its ``count_keys``."""
    return spark.read.parquet(_counts_path(path, key))


def hot_of(spark: SparkSession, path: str, key: str, rows_per_slice: int | None = None) -> DataFrame:
    """(key, slices) of the keys that ``salted_join`` has to spread, from the stored counts."""
    return skew.hot_from_counts(key_counts(spark, path, key), key, "n_rows", rows_per_slice or skew.ROWS_PER_SLICE)


def read_artifact(spark: SparkSession, path: str, features: list[int] | None = None,
                  feature_buckets: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if features is not None:
        if feature_buckets:
            df = df.where(F.col("feature_bucket").isin(sorted({f % feature_buckets for f in features})))
        df = df.where(F.col("feature_id").isin(features))
    return df.drop("feature_bucket")


def pool_checkpoint(state: dict[str, DataFrame], folder: str, run_id: str, iteration: int) -> str:
    """Write the tables of a run under ``folder/run/iteration``; written state is never changed."""
    base = f"{folder}/run_id={run_id}/iter={iteration}"
    for name in STATE_TABLES + RESUME_TABLES:
        if name in state:
            state[name].write.mode("overwrite").parquet(f"{base}/{name}")
    return base


def pool_restore(spark: SparkSession, base: str, names=STATE_TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{base}/{name}") for name in names}


def last_checkpoint(spark: SparkSession, folder: str, run_id: str) -> str | None:
    """The folder of the latest whole state of a run, None when it has none."""
    base = f"{folder}/run_id={run_id}"
    try:
        latest = spark.read.parquet(f"{base}/iter=*/facts").agg(F.max("iter")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return f"{base}/iter={latest}"
