"""Queries: sources, feature building, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from registry.base import (DOCS_Y, ORDER_CTES, TEXT_CTES, VECTOR_CTES, counted, fitted_texts, h32, labelled_texts, order_labels,
                           order_matrix, query, rounded, scratch_path, split_cte, supplier_features, table, text_vocab,
                           texts, vector_matrix, vector_labels)
from widemargin.operators import features as B
from widemargin.session import cut_lineage
from widemargin.sources import artifacts, tables as A

MATRIX_OUT = "round(value, 6) + 0.0 AS value"


# ---------------------------------------------------------------- A: sources
@query("read_text_table", """
SELECT doc_id AS id, CASE WHEN text = '' THEN NULL ELSE text END AS clean_data, n_chars::INT AS n_words FROM documents""")
def _(spark, sf_dir):
    path = scratch_path(spark, "texts-csv")
    (table(spark, sf_dir, "documents")
     .select(F.col("doc_id").alias("id"), F.lit("NA").alias("gender"), F.col("text").alias("clean_data"),
             F.lit(0).alias("clase"), F.col("n_chars").cast("int").alias("n_words"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    back = A.read_text_table(spark, path)
    # the word NA must not have become null
    return back.where(F.col("gender") == "NA").select("id", "clean_data", "n_words")


@query("fill_missing_text", """
SELECT doc_id AS row_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END, '') AS clean_data FROM documents""")
def _(spark, sf_dir):
    gaps = texts(spark, sf_dir).withColumn(
        "clean_data", F.when(F.col("row_id") % 3 != 0, F.col("clean_data")))
    return A.fill_missing_text(gaps)


@query("project_text_label", f"WITH {DOCS_Y} SELECT row_id, clean_data, clase FROM docs_y")
def _(spark, sf_dir):
    return A.project_text_label(labelled_texts(spark, sf_dir))


@query("filter_ids", """
SELECT c_custkey AS id, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return A.filter_ids(customers, "id", ids)


@query("write_artifact", f"WITH {ORDER_CTES} SELECT row_id, feature_id, {MATRIX_OUT} FROM om")
def _(spark, sf_dir):
    path = artifacts.write_artifact(order_matrix(spark, sf_dir), scratch_path(spark, "matrix"), feature_buckets=8)
    return rounded(artifacts.read_artifact(spark, path), "value")


@query("read_artifact", f"""WITH {ORDER_CTES}
SELECT row_id, feature_id, {MATRIX_OUT} FROM om WHERE feature_id IN (3, 11, 42)""")
def _(spark, sf_dir):
    path = artifacts.write_artifact(order_matrix(spark, sf_dir), scratch_path(spark, "matrix"), feature_buckets=8)
    return rounded(artifacts.read_artifact(spark, path, features=[3, 11, 42], feature_buckets=8), "value")


@query("matrix_shape", f"""WITH {ORDER_CTES}
SELECT count(DISTINCT row_id) AS n_samples, count(DISTINCT feature_id) AS n_features, count(*) AS nnz FROM om""")
def _(spark, sf_dir):
    return B.matrix_shape(order_matrix(spark, sf_dir))


# ---------------------------------------------------------------- B: features
ORDER_SPLIT = f"{ORDER_CTES}, {split_cte('oy', 'split')}"


@query("stratified_split", f"""WITH {ORDER_SPLIT}
SELECT row_id, y, part FROM split""")
def _(spark, sf_dir):
    return B.stratified_split(order_labels(spark, sf_dir), seed=2)


@query("binarize_label", "SELECT doc_id, CASE WHEN toxic <= 0 THEN -1 ELSE 1 END AS y FROM labels")
def _(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", B.binarize_label(F.col("toxic")).alias("y"))


@query("validate_matrix", f"""WITH {VECTOR_CTES}
SELECT 'unknown_feature' AS problem, col_id, feature_id FROM raw_w WHERE feature_id % 10 = 3
UNION ALL
SELECT 'repeated_feature', 'p_all', feature_id FROM raw_w GROUP BY feature_id HAVING count(*) > 1""")
def _(spark, sf_dir):
    from registry.base import vector_pool
    _, raw = vector_pool(spark, sf_dir)
    known = vector_matrix(spark, sf_dir).select("feature_id").distinct().where(F.col("feature_id") % 10 != 3)
    found = B.validate_matrix(raw, known)
    flat = B.validate_matrix(raw.withColumn("col_id", F.lit("p_all")), raw.select("feature_id").distinct())
    return found.unionByName(flat)


@query("tokenize", r"""
SELECT row_id, pos, t[pos] AS token FROM (
  SELECT doc_id AS row_id, t, unnest(range(1, len(t) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents))""")
def _(spark, sf_dir):
    return (B.tokenize(texts(spark, sf_dir))
            .select("row_id", F.posexplode("tokens").alias("pos", "token"))
            .withColumn("pos", (F.col("pos") + 1).cast("long")))


@query("ngrams", r"""
WITH tok AS (SELECT conv_id * 1000 + turn AS row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t
             FROM conversations),
grams AS (SELECT row_id, unnest(t) AS term FROM tok
  UNION ALL
  SELECT row_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) FROM tok
  UNION ALL
  SELECT row_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])) FROM tok)
SELECT row_id, term, count(*) AS tf FROM grams GROUP BY row_id, term""")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("clean_data"))
    return B.count_terms(B.ngrams(B.tokenize(turns), 1, 3))


@query("fit_vocabulary", f"WITH {TEXT_CTES} SELECT feature_id, term, df, round(idf, 6) AS idf FROM vocab")
def _(spark, sf_dir):
    return rounded(text_vocab(spark, sf_dir), "idf")


@query("count_matrix", f"""WITH {TEXT_CTES}
SELECT row_id, feature_id, tf::DOUBLE AS value FROM terms JOIN vocab USING (term)""")
def _(spark, sf_dir):
    terms, vocab, _ = fitted_texts(spark, sf_dir)
    return B.count_matrix(terms, vocab)


TFIDF = """raw AS (SELECT row_id, feature_id, tf * idf AS v FROM terms JOIN vocab USING (term)),
tfidf AS (SELECT row_id, feature_id, v / sqrt(sum(v * v) OVER (PARTITION BY row_id)) AS value FROM raw)"""


@query("tfidf_matrix", f"WITH {TEXT_CTES}, {TFIDF} SELECT row_id, feature_id, {MATRIX_OUT} FROM tfidf")
def _(spark, sf_dir):
    terms, vocab, _ = fitted_texts(spark, sf_dir)
    return rounded(B.tfidf_matrix(terms, vocab), "value")


@query("tfidf_transform_pages", f"""WITH {TEXT_CTES},
ptok AS (SELECT item_id AS row_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM benchmark
  UNION ALL SELECT 1000000 + page_id, regexp_extract_all(lower(html), '[\\p{{L}}\\p{{N}}_]{{2,}}') FROM pages),
pterms AS (SELECT row_id, term, count(*) AS tf FROM (
  SELECT row_id, unnest(t) AS term FROM ptok UNION ALL
  SELECT row_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) FROM ptok) GROUP BY 1, 2),
praw AS (SELECT row_id, feature_id, tf * idf AS v FROM pterms JOIN vocab USING (term))
SELECT row_id, feature_id, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 6) + 0.0 AS value FROM praw""")
def _(spark, sf_dir):
    unlabelled = (table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("clean_data"))
                  .unionByName(table(spark, sf_dir, "pages").select(
                      (F.col("page_id") + 1000000).alias("row_id"), F.col("html").alias("clean_data"))))
    terms = B.term_counts(B.tokenize(unlabelled), 1, 2)
    return rounded(B.tfidf_matrix(terms, text_vocab(spark, sf_dir)), "value")


MOMENTS = """nr AS (SELECT count(*)::DOUBLE AS n FROM split WHERE part = 'train'),
mom AS (SELECT feature_id, sum(value) / n AS mean,
               sqrt(greatest(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 0)) AS sd
        FROM om JOIN split USING (row_id), nr WHERE part = 'train' GROUP BY feature_id, n)"""


@query("standard_scale", f"""WITH {ORDER_SPLIT}, {MOMENTS}
SELECT row_id, feature_id, round(value / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 6) + 0.0 AS value
FROM om LEFT JOIN mom USING (feature_id)""")
def _(spark, sf_dir):
    matrix = order_matrix(spark, sf_dir)
    train = cut_lineage(B.stratified_split(order_labels(spark, sf_dir), seed=2).where("part = 'train'").select("row_id"))
    moments = B.feature_moments(matrix.join(train, "row_id"), train.count())
    return rounded(B.standard_scale(matrix, moments), "value")


@query("standard_scale_centred", f"""WITH {VECTOR_CTES}, nr AS (SELECT count(*)::DOUBLE AS n FROM ey),
mom AS (SELECT feature_id, sum(value) / n AS mean,
               sqrt(greatest(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 0)) AS sd
        FROM em, nr GROUP BY feature_id, n)
SELECT row_id, feature_id, round((value - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS value
FROM em JOIN mom USING (feature_id)""")
def _(spark, sf_dir):
    matrix = vector_matrix(spark, sf_dir)
    moments = B.feature_moments(matrix, vector_labels(spark, sf_dir).count())
    return rounded(B.standard_scale(matrix, moments, centred=True), "value")


@query("maxabs_scale", f"""WITH {VECTOR_CTES}
SELECT row_id, feature_id, round(value / CASE WHEN m = 0 THEN 1 ELSE m END, 6) + 0.0 AS value
FROM em JOIN (SELECT feature_id, max(abs(value)) AS m FROM em GROUP BY feature_id) USING (feature_id)""")
def _(spark, sf_dir):
    matrix = vector_matrix(spark, sf_dir)
    return rounded(B.maxabs_scale(matrix, B.feature_maxabs(matrix)), "value")


@query("slice_features_range", f"""WITH {ORDER_CTES}, nf AS (SELECT count(*) AS n FROM feats),
b AS (SELECT 'block_' || i AS model_id, n * (i - 1) // 7 AS s, n * i // 7 AS e FROM nf, range(1, 8) r(i))
SELECT model_id, row_id, feature_id, {MATRIX_OUT} FROM om JOIN b ON feature_id >= s AND feature_id < e""")
def _(spark, sf_dir):
    matrix, n = cut_lineage(order_matrix(spark, sf_dir)), supplier_features(spark, sf_dir).count()
    slices = [B.slice_features_range(matrix, n * (i - 1) // 7, n * i // 7).withColumn("model_id", F.lit(f"block_{i}"))
              for i in range(1, 8)]
    return rounded(reduce(DataFrame.unionByName, slices), "value")


PLACES = f"""places AS (
  SELECT feature_id, row_number() OVER (ORDER BY {h32("'5'", "feature_id")}, feature_id) - 1 AS place FROM feats),
nf AS (SELECT count(*) AS n FROM feats)"""
DISJOINT = "grp AS (SELECT 's5_p' || (((place + 1) * 6 - 1) // n + 1) AS model_id, feature_id FROM places, nf)"


@query("slice_features_set", f"""WITH {ORDER_CTES}, {PLACES}, {DISJOINT}
SELECT model_id, row_id, feature_id, {MATRIX_OUT} FROM om JOIN grp USING (feature_id)""")
def _(spark, sf_dir):
    features = supplier_features(spark, sf_dir)
    groups = B.disjoint_feature_groups(features, features.count(), 6, seed=5)
    matrix, hot = counted(order_matrix(spark, sf_dir), "matrix", "feature_id")
    return rounded(B.slice_features_set(matrix, groups, hot), "value")


@query("random_feature_groups", f"WITH {ORDER_CTES}, {PLACES}, {DISJOINT} SELECT model_id, feature_id FROM grp")
def _(spark, sf_dir):
    features = supplier_features(spark, sf_dir)
    return B.disjoint_feature_groups(features, features.count(), 6, seed=5)


@query("random_feature_groups_overlapping", f"""WITH {ORDER_CTES}, {PLACES},
part AS (SELECT p, {h32("'5'", "'start'", "p")} % n AS start, 1 + {h32("'5'", "'step'", "p")} % greatest(1, n - 1) AS first, n
         FROM nf, range(1, 7) r(p)),
steps AS (SELECT p, start, n, min(s) AS step FROM (SELECT p, start, n, unnest(range(first, first + n)) AS s FROM part)
          WHERE gcd(s, n) = 1 GROUP BY p, start, n),
draws AS (SELECT p, (start + k * step) % n AS place FROM (SELECT p, start, step, n, unnest(range(0, n // 6)) AS k FROM steps))
SELECT 's5_p' || p AS model_id, feature_id FROM draws JOIN places USING (place)""")
def _(spark, sf_dir):
    features = supplier_features(spark, sf_dir)
    n = features.count()
    return B.overlapping_feature_groups(features, n, 6, n // 6, seed=5)


@query("stratified_row_bag", f"""WITH {ORDER_CTES}, seeds AS (SELECT unnest([1, 2, 3]) AS bag),
c AS (SELECT y, floor(count(*) * 400 / (SELECT count(*) FROM oy)::DOUBLE + 0.5) AS quota FROM oy GROUP BY y),
r AS (SELECT bag, row_id, y,
             row_number() OVER (PARTITION BY bag, y ORDER BY {h32("bag", "row_id")}, row_id) AS rn FROM oy, seeds)
SELECT bag, row_id, y FROM r JOIN c USING (y) WHERE rn <= quota""")
def _(spark, sf_dir):
    return B.stratified_row_bags(order_labels(spark, sf_dir), [1, 2, 3], 400)


# the flagship: labelled texts to the words that separate the classes
@query("text_screening", f"""WITH {TEXT_CTES}, {TFIDF},
s AS (SELECT feature_id, sum(value * y) AS s FROM tfidf JOIN split USING (row_id) WHERE part = 'train' GROUP BY feature_id)
SELECT term, CASE WHEN s > 0 THEN -1 ELSE 1 END AS sign, CASE WHEN s > 0 THEN 1 ELSE -1 END AS sign_descent,
       round(abs(s), 6) AS severity
FROM s JOIN vocab USING (feature_id) WHERE abs(s) > 1e-8 ORDER BY abs(s) DESC, feature_id LIMIT 50""")
def text_screening(spark, sf_dir):
    from widemargin.operators.screening import screen_features
    terms, vocab, split = fitted_texts(spark, sf_dir)
    train = split.where("part = 'train'").select("row_id", F.col("y").alias("v"))
    hits = screen_features(B.tfidf_matrix(terms, vocab), train, k_max=50)
    return rounded(hits.join(vocab.select("feature_id", "term"), "feature_id")
                   .select("term", "sign", "sign_descent", "severity"), "severity")
