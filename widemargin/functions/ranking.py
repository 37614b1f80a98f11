"""Exact global ranks and exact per-group quotas without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from widemargin.functions.hashing import HASH_RANGE
from widemargin.session import cut_lineage

# monotonically_increasing_id keeps the partition number above this bit
_PARTITION_SHIFT = 33


def distributed_rank(df: DataFrame, order_by: list[str], rank_col: str,
                     partitions: int | None = None) -> DataFrame:
    """Add the 0-based rank of each row in the order of ``order_by``.

    Rows are range-partitioned and sorted inside their partition.  The sorted
    rows are checkpointed, since a second evaluation could cut other ranges; one
    offset per partition is then joined back.  ``order_by`` must be unique.
    """
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(
        df.repartitionByRange(partitions, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_place", _PARTITION_SHIFT))
    # one row per partition: bounded by ``partitions``
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), _PARTITION_SHIFT)
    return (ordered.join(F.broadcast(offsets), "_part")
            .withColumn(rank_col, (F.col("_offset") + inside).cast("long"))
            .drop("_part", "_place", "_offset"))


def take_per_group(df: DataFrame, groups: list[str], hash_col: str, id_col: str,
                   quotas: DataFrame, bits: int = 12) -> DataFrame:
    """Keep, per group, the first ``quota`` rows in the order (hash, id).

    ``quotas`` holds one row per group (``groups`` + ``quota``); groups are class
    or sample labels.  A histogram of the hash finds the bucket where the quota
    is reached; only rows of that bucket are ranked, over all tasks by
    ``distributed_rank``, so neither a group with most of the rows nor a bucket
    with most of a group is ever sorted in one task.
    """
    width = HASH_RANGE >> bits
    bucketed = df.withColumn("_bucket", F.floor(F.col(hash_col) / F.lit(width)).cast("long"))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2**bits rows per group reach this window
    upto = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumn("_upto", F.sum("_n").over(upto)).join(quotas, groups)
    wanted = (cumulated
              .where(F.col("_upto") - F.col("_n") < F.col("quota"))
              .select(*groups, "_bucket",
                      F.when(F.col("_upto") > F.col("quota"),
                             F.col("quota") - (F.col("_upto") - F.col("_n"))).alias("_rest")))
    hit = bucketed.join(wanted, [*groups, "_bucket"])
    whole = hit.where(F.col("_rest").isNull())
    edge = distributed_rank(hit.where(F.col("_rest").isNotNull()), [*groups, hash_col, id_col], "_rank")
    # one boundary bucket per group, so its ranks are consecutive from the group's first
    starts = edge.groupBy(*groups).agg(F.min("_rank").alias("_start"))
    same = [F.col(f"e.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    partial = (edge.alias("e").join(F.broadcast(starts.alias("s")), same)
               .where(F.col("_rank") - F.col("_start") < F.col("_rest")).select("e.*").drop("_rank"))
    return whole.unionByName(partial).drop("_bucket", "_rest")
