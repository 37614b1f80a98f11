"""One registered query per operator, with DuckDB SQL where SQL expresses the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from widemargin.llm import language, quality
from widemargin.llm.common import table
from widemargin.llm.decontamination import contaminated
from widemargin.llm.hard_negatives import hard_negatives, labelled
from widemargin.llm.licences import scan_licences
from widemargin.llm.mixing import mix
from widemargin.llm.neighbours import nearest_neighbours
from widemargin.llm.ngram_jaccard import jaccard_classes
from widemargin.llm.pii import pii_report
from widemargin.llm.secrets import secret_report
from widemargin.llm.substring_dedup import remove_repeats
from widemargin.llm.topk import top_k
from widemargin.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace('text', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS t
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id"""


@query("op5_ngram_jaccard_join", OP5_SQL)
def op5(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("set_id")


OP7_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS t FROM documents),
win AS (SELECT r, unnest(range(1, len(t) - 33)) AS i, unnest(list_transform(range(1, len(t) - 33), lambda i: md5(array_to_string(t[i:i+34], ' ')))) AS h
        FROM w WHERE len(t) >= 35),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS k FROM win) WHERE k > 1),
gone AS (SELECT r, list_distinct(list(p)) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM rep) GROUP BY r),
kept AS (SELECT doc_id, t, CASE WHEN ps IS NULL THEN t ELSE list_filter(t, lambda x, i: NOT list_contains(ps, i)) END AS k
         FROM w LEFT JOIN gone USING (r))
SELECT doc_id, len(t) AS n_words, len(t) - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


OP3_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 9))::BIGINT AS h FROM documents),
s AS MATERIALIZED (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
  FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)),
c AS (
  SELECT *, coalesce(sum(3 * n) OVER p, 0) AS spent, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS w_left, sum(n) OVER () AS total
  FROM s WINDOW p AS (ORDER BY n::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT spent, w_left, total FROM c WHERE NOT (3 * n * w_left < w * (total - spent)) ORDER BY spent LIMIT 1),
t AS (
  SELECT source, n, CASE WHEN 3 * n * w_left < w * (total - z.spent) THEN (3 * n)::DOUBLE
    ELSE w::DOUBLE * ((total - z.spent)::DOUBLE / w_left::DOUBLE) END AS target
  FROM s, z),
p AS (SELECT *, CASE WHEN n > 0 THEN least(floor(target / n)::BIGINT, 3) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before
      FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, p.n AS source_size, p.target,
  (d.size * (p.whole + CASE WHEN p.n > 0 AND g.before + g.size / 2 <= p.target - p.whole * p.n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h"""


@query("op3_mixing", OP3_SQL)
def op3(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_pii")
def op4(spark, sf_dir):
    return pii_report(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


@query("op8_language_id")
def op8(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


@query("op1_decontamination")
def op1(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op6_exact_top_k", OP6_SQL)
def op6(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op9_secret_scan")
def op9(spark, sf_dir):
    """The source owns the text; its texts of one language are a repository."""
    return secret_report(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


@query("op10_licence_scan")
def op10(spark, sf_dir):
    """Texts lie in a directory per source and language."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan_licences(table(spark, sf_dir, "documents"), path)


@query("op11_nearest_neighbours")
def op11(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark, sf_dir):
    """The label of every seventh id is off by one."""
    label = F.col("label").cast("long")
    rows = labelled(table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


@query("op13_whitening")
def op13(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
