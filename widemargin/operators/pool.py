"""The pool of candidate weight vectors, held as two tables.

pool(col_id, kind, origin, born_iter, b) has one row per candidate column;
pool_w(col_id, feature_id, weight) holds its non-zero weights.  A zero column has
a pool row and no weights, so reports start from pool.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from widemargin.functions.hashing import hash32
from widemargin.functions.ranking import distributed_rank
from widemargin.functions.skew import hot_from_counts, salted_join
from widemargin.session import cut_lineage

POOL_SCHEMA = T.StructType([
    T.StructField("col_id", T.StringType(), False),
    T.StructField("kind", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("born_iter", T.IntegerType()),
    T.StructField("b", T.DoubleType()),
])
POOL_W_SCHEMA = T.StructType([
    T.StructField("col_id", T.StringType(), False),
    T.StructField("feature_id", T.LongType(), False),
    T.StructField("weight", T.DoubleType()),
])

# Upper limit of a pool whose Gram matrix is held by one process, as Newton steps on its coefficients need it.
MAX_GRAM_COLUMNS = 2_000
# columns in one block of a Gram matrix, and features multiplied at a time: 2 x 8 MB
_GRAM_BLOCK = 1_000
_GRAM_ROWS = 1_000


def empty_pool(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], POOL_SCHEMA), spark.createDataFrame([], POOL_W_SCHEMA)


def compact_pool(pool: DataFrame, pool_w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop stored zeros and null weights; a missing bias is 0."""
    return (pool.withColumn("b", F.coalesce("b", F.lit(0.0))),
            pool_w.where(F.col("weight").isNotNull() & (F.col("weight") != 0)))


def column_signatures(pool: DataFrame, pool_w: DataFrame) -> DataFrame:
    """(col_id, n_weights, h1, h2, h3): equal for equal columns, whatever the row order.

    Built from sums and xors, so a column of any width is combined map-side and
    never gathered in one task.
    """
    h = F.xxhash64("feature_id", "weight")
    g = F.xxhash64("weight", "feature_id", F.lit("second"))
    low = F.lit((1 << 32) - 1)
    sums = pool_w.groupBy("col_id").agg(
        F.count(F.lit(1)).alias("n_weights"),
        F.bit_xor(h).alias("h1"),
        F.sum(g.bitwiseAND(low)).alias("h2"),
        F.sum(F.shiftrightunsigned(g, 32)).alias("h3"))
    return pool.select("col_id").join(sums, "col_id", "left").fillna(0, ["n_weights", "h1", "h2", "h3"])


def key_pool(pool: DataFrame, pool_w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give content-derived ids, so a retried step makes the same ids again."""
    signed = pool.join(column_signatures(pool, pool_w), "col_id")
    digest = F.md5(F.concat_ws("|", "kind", "origin", F.col("born_iter").cast("string"),
                               *[F.col(c).cast("string") for c in ("n_weights", "h1", "h2", "h3", "b")]))
    prefix = F.when(F.col("kind") == "ray", F.lit("r_")).otherwise(F.lit("p_"))
    ids = signed.select("col_id", F.concat(prefix, F.substring(digest, 1, 16)).alias("_new"))

    def rename(df):
        return df.join(ids, "col_id").withColumn("col_id", F.col("_new")).drop("_new")

    return (rename(pool).select(*POOL_SCHEMA.names).dropDuplicates(["col_id"]),
            rename(pool_w).select(*POOL_W_SCHEMA.names).dropDuplicates(["col_id", "feature_id"]))


def stack_pool(parts: list[DataFrame], spark: SparkSession, schema: T.StructType = POOL_W_SCHEMA) -> DataFrame:
    """All columns of several pools; an empty list gives an empty pool."""
    stacked = spark.createDataFrame([], schema)
    for part in parts:
        stacked = stacked.unionByName(part.select(*schema.names))
    return stacked


def unit_columns(pairs: DataFrame, kind: str = "point", origin: str = "unit",
                 born_iter: int = 0) -> tuple[DataFrame, DataFrame]:
    """Signed unit columns for (feature_id, sign); sign defaults to +1."""
    if "sign" not in pairs.columns:
        pairs = pairs.withColumn("sign", F.lit(1))
    sign = F.signum(F.col("sign").cast("double"))
    mark = F.when(sign < 0, F.lit("m")).otherwise(F.lit("e"))
    prefix = "r_" if kind == "ray" else "p_"
    named = pairs.select(F.concat(F.lit(prefix), mark, F.col("feature_id").cast("string")).alias("col_id"),
                         F.col("feature_id").cast("long").alias("feature_id"), sign.alias("weight"))
    pool = named.select("col_id", F.lit(kind).alias("kind"), F.lit(origin).alias("origin"),
                        F.lit(born_iter).cast("int").alias("born_iter"), F.lit(0.0).alias("b"))
    return pool, named


def zero_column(spark: SparkSession) -> DataFrame:
    """The pool row of the zero vector."""
    return spark.createDataFrame([("p_zero", "point", "zero", 0, 0.0)], POOL_SCHEMA)


def zero_and_unit_columns(pairs: DataFrame, kind: str = "point") -> tuple[DataFrame, DataFrame]:
    pool, pool_w = unit_columns(pairs, kind)
    return zero_column(pairs.sparkSession).unionByName(pool), pool_w


def sample_features(features: DataFrame, share: float, seed) -> DataFrame:
    """floor(n*share) features, the first in the order of a seeded hash."""
    hashed = features.select("feature_id", hash32(seed, "feature_id").alias("_h"))
    wanted = int(hashed.count() * share)
    return (distributed_rank(hashed, ["_h", "feature_id"], "_rank")
            .where(F.col("_rank") < wanted).select("feature_id"))


def sample_unit_columns(features: DataFrame, share: float, seed=420) -> tuple[DataFrame, DataFrame]:
    """Zero column plus unit columns of a seeded share of the features."""
    return zero_and_unit_columns(sample_features(features, share, seed))


def existing_pairs(pool_w: DataFrame) -> DataFrame:
    """(feature_id, sign) of the columns that have exactly one weight."""
    return (pool_w.groupBy("col_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.first("feature_id").alias("feature_id"),
                 F.first("weight").alias("_w"))
            .where(F.col("_n") == 1)
            .select("feature_id", F.when(F.col("_w") < 0, -1).otherwise(1).alias("sign"))
            .distinct())


def dedupe_columns(pool: DataFrame, pool_w: DataFrame) -> DataFrame:
    """(col_id, kept): the first id stands for every group of equal columns."""
    keys = column_signatures(pool, pool_w)
    firsts = keys.groupBy("n_weights", "h1", "h2", "h3").agg(F.min("col_id").alias("kept"))
    return keys.join(firsts, ["n_weights", "h1", "h2", "h3"]).select("col_id", "kept")


def merge_pool(pool: DataFrame, pool_w: DataFrame, new_pool: DataFrame,
               new_w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append new columns; those equal to a column already present or repeated in the batch are skipped."""
    content = ["n_weights", "h1", "h2", "h3"]
    known = column_signatures(pool, pool_w).select(*content)
    fresh = (column_signatures(new_pool, new_w).groupBy(*content).agg(F.min("col_id").alias("col_id"))
             .join(known, content, "left_anti").select("col_id"))
    return (pool.unionByName(new_pool.join(fresh, "col_id", "left_semi")),
            pool_w.unionByName(new_w.join(fresh, "col_id", "left_semi")))


def active_columns(pool: DataFrame, pool_w: DataFrame, theta: DataFrame,
                   tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Columns with |coef| above ``tol``; ``theta`` is (col_id, coef)."""
    used = theta.where(F.abs("coef") > tol).select("col_id")
    return pool.join(used, "col_id", "left_semi"), pool_w.join(used, "col_id", "left_semi")


def column_norms(pool_w: DataFrame) -> DataFrame:
    return pool_w.groupBy("col_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def normalize_columns(pool_w: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Columns scaled to unit length; a column shorter than ``tol`` is left as it is."""
    # one row per column, with its length: the same aggregate tells which columns are wide
    norms = cut_lineage(pool_w.groupBy("col_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.count(F.lit(1)).alias("n_weights")))
    # a wide column may hold most of the rows, so its rows are spread by feature
    joined = salted_join(pool_w, norms.select("col_id", "norm"), "col_id", "feature_id", hot_from_counts(norms, "col_id", "n_weights"))
    scaled = F.when(F.col("norm") > tol, F.col("weight") / F.col("norm")).otherwise(F.col("weight"))
    return joined.select("col_id", "feature_id", scaled.alias("weight"))


def prune_weights(pool: DataFrame, pool_w: DataFrame, tol: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Drop weights below ``tol`` and columns that become empty."""
    kept = pool_w.where(F.abs("weight") >= tol)
    return pool.join(kept.select("col_id").distinct(), "col_id", "left_semi"), kept


def combine_columns(pool_w: DataFrame, theta: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """w = W theta as (feature_id, weight)."""
    joined = salted_join(pool_w, theta.select("col_id", "coef"), "col_id", "feature_id", hot)
    return joined.groupBy("feature_id").agg(F.sum(F.col("weight") * F.col("coef")).alias("weight"))


def project_rows(matrix: DataFrame, pool_w: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Z = X W as (row_id, col_id, z); partial sums are combined map-side."""
    joined = salted_join(matrix, pool_w, "feature_id", "row_id", hot)
    return (joined.groupBy("row_id", "col_id")
            .agg(F.sum(F.col("value") * F.col("weight")).alias("z")))


def gram_matrix(pool_w: DataFrame, col_ids: list[str] | None = None) -> DataFrame:
    """W'W as (k1, k2, dot) with k1 <= k2, zero products left out; any number of columns.

    Columns are numbered and cut into blocks.  Each feature brings its weights of one block to one row; rows of two
    blocks meet by feature, and a task adds the products of a pair of blocks in one matrix of the block's size, so no
    pair of columns is produced per feature.
    """
    spark = pool_w.sparkSession
    if col_ids is None:
        index = distributed_rank(pool_w.select("col_id").distinct(), ["col_id"], "k")
    else:
        # as long as the caller's list
        index = spark.createDataFrame(list(zip(sorted(set(col_ids)), range(len(col_ids)))), "col_id string, k long")
    place = (F.col("k") % _GRAM_BLOCK).cast("int")
    packed = (pool_w.join(index, "col_id")
              .groupBy("feature_id", F.floor(F.col("k") / _GRAM_BLOCK).cast("int").alias("block"))
              .agg(F.collect_list(F.struct(place.alias("k"), "weight")).alias("cells"))
              .select("feature_id", "block", F.col("cells.k").alias("ks"), F.col("cells.weight").alias("ws")))
    left = packed.withColumnsRenamed({"block": "left", "ks": "lk", "ws": "lw"})
    right = packed.withColumnsRenamed({"block": "right", "ks": "rk", "ws": "rw"})
    pairs = left.join(right, "feature_id").where(F.col("left") <= F.col("right"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a pair of blocks may take several tasks, each with its share of the features
    pairs = (pairs.withColumn("share", F.pmod(F.xxhash64("feature_id"), F.lit(parts)).cast("int")).drop("feature_id")
             .repartition(parts, "left", "right", "share").sortWithinPartitions("left", "right"))

    def dense(ks, ws):
        out = np.zeros((len(ks), _GRAM_BLOCK))
        rows = np.repeat(np.arange(len(ks)), [len(k) for k in ks])
        np.add.at(out, (rows, np.concatenate(list(ks)).astype(int)), np.concatenate(list(ws)))
        return out

    def cells(key, total):
        i, j = np.nonzero(np.triu(total) if key[0] == key[1] else total)
        return pd.DataFrame({"i": i + np.int64(key[0]) * _GRAM_BLOCK, "j": j + np.int64(key[1]) * _GRAM_BLOCK, "dot": total[i, j]})

    def partial(batches):
        key, total = None, None
        for batch in batches:
            for pair, part in batch.groupby(["left", "right"], sort=True):
                if pair != key:
                    if key is not None:
                        yield cells(key, total)
                    key, total = pair, np.zeros((_GRAM_BLOCK, _GRAM_BLOCK))
                for start in range(0, len(part), _GRAM_ROWS):
                    some = part.iloc[start:start + _GRAM_ROWS]
                    total += dense(some["lk"], some["lw"]).T @ dense(some["rk"], some["rw"])
        if key is not None:
            yield cells(key, total)

    dots = pairs.mapInPandas(partial, "i long, j long, dot double").groupBy("i", "j").agg(F.sum("dot").alias("dot")).where("dot != 0")
    return (dots.join(index.select(F.col("k").alias("i"), F.col("col_id").alias("k1")), "i")
            .join(index.select(F.col("k").alias("j"), F.col("col_id").alias("k2")), "j").select("k1", "k2", "dot"))
