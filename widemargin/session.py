"""Session-level helpers: where checkpoints go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="widemargin-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and continue from the written rows.

    A written table survives lost executors and, unlike a checkpointed plan,
    has a known size, so the optimizer may broadcast it when it is small.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder, bucketed by ``keys``, and read it back.

    Joins and groupings on ``keys`` then need no shuffle of this side, and a lost
    executor costs nothing but a new read.  One file per bucket.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"widemargin_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
     .option("path", f"{ensure_checkpoint_dir(spark)}/tables/{name}").saveAsTable(name))
    stored = spark.table(name)
    # the plan above already knows the files; dropping the external table only clears the catalog entry
    spark.sql(f"DROP TABLE {name}")
    return stored
