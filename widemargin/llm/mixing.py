"""Mixing sources to target weights with hash-threshold histograms.

Sizes are words.  Sources take weights in turn and share the sum of all sizes by
them; a target stops at ``most`` times its source's size and the excess goes to
the others.  A source is taken as often as its target holds it whole; the rest of
the target is a hash threshold: the documents below it are taken once more.

Thresholds come from histograms: sizes are summed by source and the first bits of
a document's hash, the bucket in which the budget ends is found, and only that
bucket is split by the next bits.  Nothing is sorted but a fixed number of buckets
per source.  Documents of equal hash (rows that repeat id and text, mainly) are
taken or left together.

Null texts have size 0 and are returned like all rows.  Rows without a source
form a source of their own, the last one.  Columns of ``documents`` that are named like
a result (size, source_size, target, copies, taken) give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from widemargin.functions.ranking import distributed_rank
from widemargin.llm.common import staged

WEIGHTS = (5, 2, 1)
_LEVELS, _BITS = 3, 12


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size), one row per source."""
    keyed = sizes.withColumn("_last", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    ranked = distributed_rank(keyed, ["_last", "_name"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    open_ = staged(ranked.select("source", "source_size", weight.cast("long").alias("w"), F.lit(False).alias("capped")))
    total = open_.agg(F.sum("source_size")).first()[0] or 0
    while True:  # each turn stops at least one more source
        left = open_.agg(F.sum(F.when(F.col("capped"), most * F.col("source_size")).otherwise(0)).alias("spent"),
                         F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).alias("w"),
                         F.sum(F.when(F.col("capped"), 1).otherwise(0)).alias("n")).first()
        rest, weight_left = total - (left["spent"] or 0), left["w"] or 1
        over = (F.lit(most).cast("decimal(38,0)") * F.col("source_size").cast("decimal(20,0)") * F.lit(weight_left).cast("decimal(12,0)")
                < F.col("w").cast("decimal(12,0)") * F.lit(rest).cast("decimal(20,0)"))
        after = staged(open_.withColumn("capped", F.col("capped") | over))
        if after.agg(F.sum(F.when(F.col("capped"), 1).otherwise(0))).first()[0] == left["n"]:
            break
        open_ = after
    share = F.col("w").cast("double") * F.lit(float(rest) / float(weight_left))
    return open_.select("source", "source_size",
                        F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _boundary(docs: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """(source, prefix, rest): the bucket of this level in which a source's budget ends, and what is left for it."""
    shift = _BITS * (_LEVELS - 1 - level)
    inside = docs.join(budgets, docs["source"].eqNullSafe(budgets["_source"]))
    if level:
        inside = inside.where(F.shiftright("hash", shift + _BITS) == F.col("prefix"))
    buckets = (inside.groupBy("_source", "rest", F.shiftright("hash", shift).alias("bucket"))
               .agg(F.sum("size").alias("size")))
    # at most 2**_BITS buckets per source
    upto = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = buckets.withColumn("before", F.sum("size").over(upto) - F.col("size"))
    hit = before.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
    found = hit.select("_source", F.col("bucket").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), "size")
    return staged(found)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``documents`` (doc_id, text, source, ...) with size, source_size, target, copies and taken.

    copies is how often the mix takes the row, ``most`` at most; taken its words,
    repeats counted.
    """
    cut = _LEVELS * _BITS // 4
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))).cast("binary"))
    sized = documents.withColumn("size", size_in_words(F.col("text"))).withColumn(
        "_mix_hash", F.conv(F.substring(digest, 1, cut), 16, 10).cast("long"))
    docs = staged(sized.select("source", "size", F.col("_mix_hash").alias("hash")))
    targets = staged(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", F.least(whole, F.lit(most).cast("long")))
    # a source that its whole copies fill needs no threshold
    budgets = plan.where("source_size > 0 AND target > whole * source_size").select(
        F.col("source").alias("_source"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(_LEVELS):
        found = _boundary(docs, budgets, level)
        budgets = found.select("_source", "prefix", "rest")
    # documents of one hash go in if that comes nearer to the budget
    below = found.select("_source", (F.col("prefix") + F.when(F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).alias("below"))
    plan = staged(plan.join(below, plan["source"].eqNullSafe(below["_source"]), "left")
                  .select(F.col("source").alias("_source"), "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")))
    mine = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in documents.columns if c not in mine]
    names = {c: f"_in_{i}" for i, c in enumerate(kept)}
    given = sized.select(*[F.col(c).alias(names[c]) for c in kept], "size", "_mix_hash", F.col("source").alias("_of"))
    joined = given.join(plan, given["_of"].eqNullSafe(plan["_source"]))
    copies = (F.col("whole") + F.when(F.col("_mix_hash") < F.col("below"), 1).otherwise(0)).cast("long")
    return joined.select(*[F.col(names[c]).alias(c) for c in kept], "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))
