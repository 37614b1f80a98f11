"""Scanning and shaping text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TEXT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("clean_data", T.StringType()),
    T.StructField("clase", T.IntegerType()),
    T.StructField("n_words", T.IntegerType()),
])

# Longer id lists go through a join instead of a literal list in the plan.
MAX_LITERAL_IDS = 1_000


def read_text_table(spark: SparkSession, path: str, schema: T.StructType = TEXT_SCHEMA) -> DataFrame:
    """CSV scan where only the empty string is null, so a word like NA survives."""
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .option("nullValue", "").option("emptyValue", "")
            .option("mode", "FAILFAST")
            .csv(path))


def fill_missing_text(texts: DataFrame, text_col: str = "clean_data") -> DataFrame:
    return texts.fillna({text_col: ""})


def project_text_label(texts: DataFrame, id_col: str = "row_id", text_col: str = "clean_data",
                       label_col: str = "clase") -> DataFrame:
    return texts.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("clean_data"),
                        F.col(label_col).alias("clase"))


def filter_ids(df: DataFrame, id_col: str, ids) -> DataFrame:
    """Rows whose ``id_col`` is in ``ids``: a list, or a one-column DataFrame."""
    if not isinstance(ids, DataFrame):
        ids = sorted(set(ids))
        if len(ids) <= MAX_LITERAL_IDS:
            return df.where(F.col(id_col).isin(ids))
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([df.schema[id_col]]))
    return df.join(ids.toDF(id_col), id_col, "left_semi")
