"""Registration, table access and the shared inputs of the registered queries.

Each input exists twice: as a DataFrame function and as SQL text with the same
column names, so that a query and its reference SQL start from the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from widemargin.functions.hashing import hash32
from widemargin.operators import features as B, pool as C
from widemargin.session import cut_lineage, ensure_checkpoint_dir
from widemargin.sources import artifacts

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round, and turn -0.0 into 0.0."""
    for c in columns:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints of the session."""
    return f"{ensure_checkpoint_dir(spark)}/artifacts/{name}-{uuid.uuid4().hex}"


def counted(df: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` as an artefact with its key counts: (stored rows, hot keys of ``key``)."""
    spark = df.sparkSession
    path = artifacts.write_artifact(df, scratch_path(spark, name), count_keys=(key,))
    return artifacts.read_artifact(spark, path), artifacts.hot_of(spark, path, key)


def h32(seed: str, *columns: str) -> str:
    """SQL text of the seeded hash."""
    joined = ", ".join([seed, *columns])
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT"


# ---------------------------------------------------------------- texts
def texts(spark, sf_dir) -> DataFrame:
    """documents as (row_id, clean_data)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("clean_data"))


def labelled_texts(spark, sf_dir) -> DataFrame:
    """(row_id, clean_data, clase) of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("clase"))
    return texts(spark, sf_dir).join(labels, "row_id").fillna({"clean_data": ""})


def text_labels(spark, sf_dir) -> DataFrame:
    """(row_id, y) of the labelled documents."""
    return labelled_texts(spark, sf_dir).select("row_id", B.binarize_label(F.col("clase")).alias("y"))


def text_terms(spark, sf_dir, n_max: int = 2) -> DataFrame:
    """(row_id, term, tf) of the labelled documents."""
    return B.term_counts(B.tokenize(labelled_texts(spark, sf_dir)), 1, n_max)


def text_split(spark, sf_dir) -> DataFrame:
    """(row_id, y, part) of the labelled documents."""
    return B.stratified_split(text_labels(spark, sf_dir), seed=2)


def fitted_texts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, vocab, split): terms of all labelled documents, written once; the vocabulary sees training rows only."""
    split = cut_lineage(text_split(spark, sf_dir))
    train = split.where("part = 'train'").select("row_id")
    terms = cut_lineage(text_terms(spark, sf_dir))
    return terms, B.fit_vocabulary(terms.join(train, "row_id"), train.count(), 3, 0.95), split


def text_vocab(spark, sf_dir) -> DataFrame:
    """The vocabulary of ``fitted_texts`` alone: the terms are read once, so they are not written."""
    train = cut_lineage(text_split(spark, sf_dir).where("part = 'train'").select("row_id"))
    terms = B.term_counts(B.tokenize(labelled_texts(spark, sf_dir).join(train, "row_id")), 1, 2)
    return B.fit_vocabulary(terms, train.count(), 3, 0.95)


DOCS_Y = """docs_y AS (
  SELECT d.doc_id AS row_id, coalesce(d.text, '') AS clean_data, l.quality AS clase
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
TEXT_Y = "text_y AS (SELECT row_id, CASE WHEN clase <= 0 THEN -1 ELSE 1 END AS y FROM docs_y)"
TOK = r"""tok AS (
  SELECT row_id, regexp_extract_all(lower(clean_data), '[\p{L}\p{N}_]{2,}') AS t FROM docs_y)"""
GRAMS = """grams AS (
  SELECT row_id, unnest(t) AS term FROM tok
  UNION ALL
  SELECT row_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) AS term FROM tok)"""
TERMS = "terms AS (SELECT row_id, term, count(*) AS tf FROM grams GROUP BY row_id, term)"


def split_cte(source: str, name: str) -> str:
    """SQL text of the stratified split with seed 2 of ``source`` (row_id, y)."""
    return f"""{name} AS (
  SELECT row_id, y, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part
  FROM (SELECT row_id, y, count(*) OVER (PARTITION BY y) AS n,
               row_number() OVER (PARTITION BY y ORDER BY {h32("'2'", "row_id")}, row_id) AS rn FROM {source}))"""


VOCAB = """nrows AS (SELECT count(*)::DOUBLE AS n FROM split WHERE part = 'train'),
vocab AS (
  SELECT row_number() OVER (ORDER BY term) - 1 AS feature_id, term, df,
         ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df FROM terms JOIN split USING (row_id) WHERE part = 'train' GROUP BY term), nrows
  WHERE df >= 3 AND df <= 0.95::DOUBLE * n)"""
TEXT_CTES = ",\n".join([DOCS_Y, TEXT_Y, split_cte("text_y", "split"), TOK, GRAMS, TERMS, VOCAB])


# ------------------------------------------------- supplier counts per order
def order_matrix(spark, sf_dir) -> DataFrame:
    """Sparse matrix: row = order, feature = supplier, value = quantity."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("feature_id"))
            .agg(F.sum("l_quantity").alias("value")))


def order_labels(spark, sf_dir) -> DataFrame:
    """(row_id, y): every order; +1 for status F."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("y"))


def supplier_features(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature_id"))


ORDER_CTES = """om AS (
  SELECT l_orderkey AS row_id, l_suppkey AS feature_id, sum(l_quantity) AS value
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
oy AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS y FROM orders),
feats AS (SELECT s_suppkey AS feature_id FROM supplier)"""


# ---------------------------------------------------------------- embeddings
def vector_matrix(spark, sf_dir) -> DataFrame:
    """Dense matrix: row = vector, feature = position."""
    return (table(spark, sf_dir, "embeddings")
            .select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("feature_id", "value"))
            .select("row_id", F.col("feature_id").cast("long").alias("feature_id"),
                    F.col("value").cast("double").alias("value")))


def vector_labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.when(F.col("label") <= 4, -1).otherwise(1).alias("y"))


def vector_features(spark, sf_dir) -> DataFrame:
    return vector_matrix(spark, sf_dir).select("feature_id").distinct()


# Centroid weights are kept to this many digits, so that both engines hold equal columns.
CENTROID_DIGITS = 6


def vector_pool(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Raw pool: one centroid column per label with some zero and null weights, plus the zero column."""
    emb = table(spark, sf_dir, "embeddings")
    labels = emb.select(F.col("vec_id").alias("row_id"), "label")
    mean = F.round(F.avg("value"), CENTROID_DIGITS)
    weights = (vector_matrix(spark, sf_dir).join(labels, "row_id")
               .groupBy("label", "feature_id").agg(mean.alias("m"))
               .select(F.concat(F.lit("p_c"), F.col("label").cast("string")).alias("col_id"), "feature_id",
                       F.when(F.pmod(F.col("feature_id") + F.col("label"), F.lit(9)) == 0, F.lit(None).cast("double"))
                       .when(F.abs("m") < 0.005, F.lit(0.0)).otherwise(F.col("m")).alias("weight")))
    pool = emb.select("label").distinct().select(
        F.concat(F.lit("p_c"), F.col("label").cast("string")).alias("col_id"), F.lit("point").alias("kind"),
        F.lit("centroid").alias("origin"), F.lit(0).alias("born_iter"),
        F.when(F.col("label") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("label") * 0.01).alias("b"))
    return C.zero_column(spark).unionByName(pool), weights


def clean_vector_pool(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return C.compact_pool(*vector_pool(spark, sf_dir))


def pool_theta(pool: DataFrame) -> DataFrame:
    """(col_id, kind, coef): hashed coefficients around [0, 1], a fifth of them zero."""
    h = hash32(7, "col_id")
    return pool.select("col_id", "kind", F.when(F.pmod(h, F.lit(5)) == 0, F.lit(0.0))
                       .otherwise(F.pmod(h, F.lit(1000)) / F.lit(997.0)).alias("coef"))


VECTOR_CTES = f"""em AS (
  SELECT row_id, (feature_id - 1)::BIGINT AS feature_id, value FROM (
    SELECT vec_id AS row_id, generate_subscripts(embedding, 1) AS feature_id, unnest(embedding)::DOUBLE AS value
    FROM embeddings)),
ey AS (SELECT vec_id AS row_id, CASE WHEN label <= 4 THEN -1 ELSE 1 END AS y FROM embeddings),
raw_w AS (
  SELECT 'p_c' || label AS col_id, feature_id,
         CASE WHEN (feature_id + label) % 9 = 0 THEN NULL WHEN abs(m) < 0.005 THEN 0.0 ELSE m END AS weight
  FROM (SELECT label, feature_id, round(avg(value), {CENTROID_DIGITS}) AS m
        FROM em JOIN embeddings ON vec_id = row_id GROUP BY label, feature_id)),
raw_pool AS (
  SELECT 'p_zero' AS col_id, 'point' AS kind, 'zero' AS origin, 0 AS born_iter, 0.0::DOUBLE AS b
  UNION ALL
  SELECT DISTINCT 'p_c' || label, 'point', 'centroid', 0,
         CASE WHEN label % 3 = 0 THEN NULL ELSE label * 0.01::DOUBLE END FROM embeddings),
pool AS (SELECT col_id, kind, origin, born_iter, coalesce(b, 0.0) AS b FROM raw_pool),
pool_w AS (SELECT * FROM raw_w WHERE weight IS NOT NULL AND weight <> 0),
theta AS (
  SELECT col_id, kind, CASE WHEN h % 5 = 0 THEN 0.0::DOUBLE ELSE (h % 1000) / 997.0::DOUBLE END AS coef
  FROM (SELECT col_id, kind, {h32("'7'", "col_id")} AS h FROM pool)),
w AS (SELECT feature_id, sum(weight * coef) AS weight FROM pool_w JOIN theta USING (col_id) GROUP BY feature_id)"""


def combined_weights(spark, sf_dir) -> DataFrame:
    """w = W theta of the centroid pool."""
    pool, pool_w = clean_vector_pool(spark, sf_dir)
    pool_w, wide = counted(pool_w, "pool_w", "col_id")
    return C.combine_columns(pool_w, pool_theta(pool), wide)


# ------------------------------------------------- histories made from the tables
def event_history(spark, sf_dir) -> DataFrame:
    """theta_history: 12 events in a row are one column's iterations, 100 columns are one run."""
    events = table(spark, sf_dir, "events")
    place = F.col("event_id")
    return events.select(
        F.concat(F.lit("r"), F.floor(place / 1200).cast("string")).alias("run_id"),
        (place % 12).cast("int").alias("iter"),
        F.concat(F.lit("k_"), F.floor(place / 12).cast("string")).alias("col_id"), F.lit("point").alias("kind"),
        F.when(place % 11 == 0, F.lit(None).cast("double"))
        .when(place % 7 == 0, F.lit(0.0)).otherwise((F.col("value") - 15) / 1000).alias("coef"),
        F.when(place % 97 == 0, F.lit("removed")).alias("event"))


HISTORY_CTE = """hist AS (
  SELECT 'r' || (event_id // 1200) AS run_id, (event_id % 12)::INT AS iter,
         'k_' || (event_id // 12) AS col_id, 'point' AS kind,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE (value - 15) / 1000 END AS coef,
         CASE WHEN event_id % 97 = 0 THEN 'removed' END AS event
  FROM events)"""


def order_iterations(spark, sf_dir) -> DataFrame:
    """run_iterations: 16 orders in a row are one run, ub = running minimum of the price."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.floor(F.col("o_orderkey") / 16).cast("long").alias("run_id"),
        (F.col("o_orderkey") % 16).cast("int").alias("iter"))
    # 16 rows per window
    so_far = Window.partitionBy("run_id").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    lowest = F.col("lowest")
    return orders.withColumn("lowest", F.min("o_totalprice").over(so_far)).select(
        "run_id", "iter",
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("double")).otherwise(lowest).alias("ub"),
        F.when(F.col("o_orderkey") % 30 == 0, lowest)
        .when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("double")).otherwise(lowest * 0.5).alias("lb"))


ITERATIONS_CTE = """iters AS (
  SELECT run_id, iter, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE lowest END AS ub,
         CASE WHEN o_orderkey % 30 = 0 THEN lowest WHEN o_orderkey % 4 = 0 THEN NULL ELSE lowest * 0.5 END AS lb
  FROM (SELECT o_orderkey, o_orderkey // 16 AS run_id, (o_orderkey % 16)::INT AS iter,
               min(o_totalprice) OVER (PARTITION BY o_orderkey // 16 ORDER BY o_orderkey
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lowest
        FROM orders))"""
