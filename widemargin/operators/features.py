"""From text and tables to a long sparse matrix (row_id, feature_id, value)."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from widemargin.functions.hashing import hash32, seeded_number
from widemargin.functions.ranking import distributed_rank, take_per_group
from widemargin.functions.skew import hot_from_counts, salted_join
from widemargin.functions.text import run_lengths, word_ngrams, word_tokens


def matrix_shape(matrix: DataFrame) -> DataFrame:
    """n_samples, n_features and stored cells, as one row."""
    return matrix.agg(F.countDistinct("row_id").alias("n_samples"),
                      F.countDistinct("feature_id").alias("n_features"),
                      F.count(F.lit(1)).alias("nnz"))


def binarize_label(label: Column) -> Column:
    return F.when(label <= 0, F.lit(-1)).otherwise(F.lit(1))


def stratified_split(labels: DataFrame, seed: int, test_share: float = 0.2) -> DataFrame:
    """(row_id, y, part): class shares kept, ceil(n_class * share) test rows per class."""
    hashed = labels.withColumn("_h", hash32(seed, "row_id"))
    quotas = (labels.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
              .select("y", F.ceil(F.col("_n") * F.lit(test_share)).cast("long").alias("quota")))
    test = take_per_group(hashed, ["y"], "_h", "row_id", quotas)
    flags = test.select("row_id", F.lit("test").alias("part"))
    return (labels.join(flags, "row_id", "left")
            .select("row_id", "y", F.coalesce("part", F.lit("train")).alias("part")))


def stratified_row_bags(labels: DataFrame, seeds: list[int], size: int) -> DataFrame:
    """(bag, row_id, y): for each seed about ``size`` rows with the class shares kept.

    Class quotas are rounded half up.  The copies per seed exist only inside the map side of the histogram.
    """
    n_rows = labels.count()
    seeded = (labels.withColumn("bag", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
              .withColumn("_h", hash32(F.col("bag"), "row_id")))
    quotas = (labels.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
              .select("y", F.floor(F.col("_n") * F.lit(size) / F.lit(n_rows) + F.lit(0.5)).cast("long").alias("quota"))
              .withColumn("bag", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))))
    return take_per_group(seeded, ["bag", "y"], "_h", "row_id", quotas).select("bag", "row_id", "y")


def tokenize(texts: DataFrame, text_col: str = "clean_data") -> DataFrame:
    """(row_id, tokens): words of the whole text, in the partitions of ``texts``."""
    return texts.select("row_id", word_tokens(F.col(text_col)).alias("tokens"))


def ngrams(tokenized: DataFrame, n_min: int = 1, n_max: int = 2) -> DataFrame:
    """(row_id, term): one row per n-gram occurrence."""
    return tokenized.select("row_id", F.explode(word_ngrams(F.col("tokens"), n_min, n_max)).alias("term"))


def count_terms(terms: DataFrame) -> DataFrame:
    """(row_id, term, tf) of any n-gram rows."""
    return terms.groupBy("row_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(tokenized: DataFrame, n_min: int = 1, n_max: int = 2) -> DataFrame:
    """(row_id, term, tf) with one input row per text: counted inside the row, without a shuffle."""
    grams = tokenized.select("row_id", F.sort_array(word_ngrams(F.col("tokens"), n_min, n_max)).alias("g"))
    return (grams.select("row_id", F.explode(run_lengths(F.col("g"))).alias("r"))
            .select("row_id", "r.term", "r.tf"))


def vocabulary_counts(term_counts: DataFrame, n_rows: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(term, df, idf) of the terms inside the document-frequency limits."""
    return (term_counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df * n_rows))))
            .withColumn("idf", F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)))


def fit_vocabulary(term_counts: DataFrame, n_rows: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """vocab(feature_id, term, df, idf); ids follow the lexicographic order of terms."""
    kept = vocabulary_counts(term_counts, n_rows, min_df, max_df)
    return distributed_rank(kept, ["term"], "feature_id").select("feature_id", "term", "df", "idf")


def count_matrix(term_counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts under a fitted vocabulary; unknown terms are dropped."""
    joined = salted_join(term_counts, vocab.select("term", "feature_id"), "term", "row_id",
                         hot=hot_from_counts(vocab, "term", "df"))
    return joined.select("row_id", "feature_id", F.col("tf").cast("double").alias("value"))


def tfidf_matrix(term_counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """tf * idf with rows scaled to unit length."""
    joined = salted_join(term_counts, vocab.select("term", "feature_id", "idf"), "term", "row_id",
                         hot=hot_from_counts(vocab, "term", "df"))
    raw = joined.select("row_id", "feature_id", (F.col("tf") * F.col("idf")).alias("value"))
    # one text per window: its size is bounded by the text itself
    row_norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("row_id")))
    return raw.withColumn("value", F.col("value") / row_norm)


def feature_moments(matrix: DataFrame, n_rows: int) -> DataFrame:
    """(feature_id, n_cells, mean, std): population moments where absent cells count as zero."""
    mean = F.col("_s") / n_rows
    variance = F.greatest(F.col("_ss") / n_rows - mean * mean, F.lit(0.0))
    return (matrix.groupBy("feature_id")
            .agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("_s"),
                 F.sum(F.col("value") * F.col("value")).alias("_ss"))
            .select("feature_id", "n_cells", mean.alias("mean"),
                    # below this a variance is rounding noise of a constant feature
                    F.when(variance <= F.lit(1e-12) * F.col("_ss") / n_rows, F.lit(0.0))
                    .otherwise(F.sqrt(variance)).alias("std")))


def standard_scale(matrix: DataFrame, moments: DataFrame, centred: bool = False) -> DataFrame:
    """Divide by the population deviation (1 where it is zero).

    ``centred`` also subtracts the mean and is meant for dense tables: absent
    cells stay absent.  A feature without moments keeps its values.
    """
    joined = salted_join(matrix, moments.select("feature_id", "mean", "std"), "feature_id", "row_id",
                         hot=hot_from_counts(moments, "feature_id", "n_cells"), how="left")
    divisor = F.when(F.col("std") != 0, F.col("std")).otherwise(F.lit(1.0))
    shifted = F.col("value") - F.coalesce("mean", F.lit(0.0)) if centred else F.col("value")
    return joined.select("row_id", "feature_id", (shifted / divisor).alias("value"))


def feature_maxabs(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_cells"),
                                            F.max(F.abs("value")).alias("max_abs"))


def maxabs_scale(matrix: DataFrame, maxima: DataFrame) -> DataFrame:
    """Divide by the largest absolute training value (1 where it is zero or the feature is new)."""
    joined = salted_join(matrix, maxima.select("feature_id", "max_abs"), "feature_id", "row_id",
                         hot=hot_from_counts(maxima, "feature_id", "n_cells"), how="left")
    divisor = F.when(F.col("max_abs") != 0, F.col("max_abs")).otherwise(F.lit(1.0))
    return joined.select("row_id", "feature_id", (F.col("value") / divisor).alias("value"))


def validate_matrix(pool_w: DataFrame, features: DataFrame) -> DataFrame:
    """Problems of a pool against the known features: one row per (problem, col_id, feature_id)."""
    unknown = (pool_w.join(features.select("feature_id"), "feature_id", "left_anti")
               .select(F.lit("unknown_feature").alias("problem"), "col_id", "feature_id"))
    repeated = (pool_w.groupBy("col_id", "feature_id").agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1)
                .select(F.lit("repeated_feature").alias("problem"), "col_id", "feature_id"))
    return unknown.unionByName(repeated)


def require_valid(pool_w: DataFrame, features: DataFrame) -> DataFrame:
    """Return ``pool_w`` or raise on the first problem found."""
    found = validate_matrix(pool_w, features).limit(1).collect()
    if found:
        raise ValueError(f"pool does not fit the matrix: {found[0].asDict()}")
    return pool_w


def slice_features_range(matrix: DataFrame, start: int, end: int) -> DataFrame:
    """Features start..end-1."""
    return matrix.where((F.col("feature_id") >= start) & (F.col("feature_id") < end))


def contiguous_block(n_features: int, parts: int) -> Column:
    """Number 1..parts of the block with bounds floor(n*(i-1)/parts)..floor(n*i/parts)-1."""
    reach = (F.col("feature_id") + 1) * F.lit(parts) - 1
    return (F.floor(reach / F.lit(n_features)) + 1).cast("int")


def contiguous_blocks(features: DataFrame, n_features: int, parts: int) -> DataFrame:
    """(model_id, feature_id): every feature in one block, found by arithmetic instead of a range join."""
    return features.select(F.format_string("block_%d", contiguous_block(n_features, parts)).alias("model_id"),
                           "feature_id")


def slice_features_set(matrix: DataFrame, groups: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(model_id, row_id, feature_id, value) for feature groups (model_id, feature_id)."""
    return (salted_join(matrix, groups, "feature_id", "row_id", hot)
            .select("model_id", "row_id", "feature_id", "value"))


def permuted_features(features: DataFrame, seed) -> DataFrame:
    """(feature_id, place): place of each feature in a seeded shuffle."""
    hashed = features.select("feature_id", hash32(seed, "feature_id").alias("_h"))
    return distributed_rank(hashed, ["_h", "feature_id"], "place").select("feature_id", "place")


def disjoint_feature_groups(features: DataFrame, n_features: int, parts: int, seed) -> DataFrame:
    """Equal shares of a seeded shuffle: every feature in exactly one of ``parts`` groups."""
    block = F.floor(((F.col("place") + 1) * F.lit(parts) - 1) / F.lit(n_features)) + 1
    return permuted_features(features, seed).select(
        F.format_string(f"s{seed}_p%d", block.cast("int")).alias("model_id"), "feature_id")


def draw_steps(n_features: int, parts: int, seed) -> list[tuple[int, int, int]]:
    """(part, step, start) per group, both drawn by the seed; a step prime to n visits no place twice."""
    steps = []
    for part in range(1, parts + 1):
        step = 1 + seeded_number(seed, "step", part) % max(1, n_features - 1)
        while gcd(step, n_features) != 1:
            step += 1
        steps.append((part, step, seeded_number(seed, "start", part) % n_features))
    return steps


def overlapping_feature_groups(features: DataFrame, n_features: int, parts: int, chunk: int, seed) -> DataFrame:
    """``parts`` groups of ``chunk`` features, drawn without replacement inside a group.

    Group p takes the places start_p + k*step_p (mod n) of a seeded shuffle, so
    only parts*chunk rows are made and nothing has to be drawn again.
    """
    spark: SparkSession = features.sparkSession
    chunk = min(chunk, n_features)
    steps = spark.createDataFrame(draw_steps(n_features, parts, seed), "part long, step long, start long")
    # place numbers come from a distributed range; the step table has one row per group
    draws = (spark.range(parts * chunk)
             .select((F.floor(F.col("id") / F.lit(chunk)) + 1).cast("long").alias("part"),
                     F.pmod("id", F.lit(chunk)).alias("k"))
             .join(steps, "part")
             .select("part", F.pmod(F.col("start") + F.col("k") * F.col("step"), F.lit(n_features)).alias("place")))
    return (draws.join(permuted_features(features, seed), "place")
            .select(F.format_string(f"s{seed}_p%d", F.col("part")).alias("model_id"), "feature_id"))
