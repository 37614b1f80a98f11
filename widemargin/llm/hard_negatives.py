"""Hard-negative mining by a secondary sort of packed keys.

Every pair that can matter becomes a key of 25 bytes, packed so that the order of bytes is (anchor, falling score, positives
before negatives, id).  ``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts them; an iterator then reads
a partition once.  A positive opens a window of scores, a negative goes to the open windows it lies in, and a window
closes with its last negative or at its lower end, so that nothing of an anchor is held but its few open windows.

Before that shuffle the pairs are combined in the tasks that make them.  Anchors are worked off in panels of a bounded
size, each panel a job that goes over all rows and writes what it keeps: first each task's best positives of an anchor,
which give the windows, then each task's first negatives of a window.  What a task leaves out comes after rows of the same
window that it keeps, so nothing is lost.  The driver holds one panel at a time.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.  A vector that ends earlier counts
as 0 behind its end.  Ties go to the smaller id.  Rows that share the anchor's id are not "other rows"; repeated rows of
another id count each, and a repeated anchor gets its results each time.  A window of a negative score is empty.
Scores are exact below 2**53.  Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from widemargin.llm.common import small_batches, staged
from widemargin.llm.vectors import first_per_group, matrix, panels, usable
from widemargin.session import ensure_checkpoint_dir

#: Anchors in one panel.
PANEL = 2048
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_PAIRS = "anchor long, anchor_id long, negative int, score long, vec_id long"
_FLIP = 1 << 63


def pack(anchor: int, score: int, negative: int, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, falling score, positives first, id."""
    return struct.pack(">QQBQ", anchor, _FLIP - 1 - score, negative, vec_id + _FLIP)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, negative, vec_id = struct.unpack(">QQBQ", key)
    return anchor, _FLIP - 1 - score, negative, vec_id - _FLIP


def stream(pairs: Iterator[tuple[bytes, int]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of the result from (key, anchor id) in the order of the keys."""
    current, opened, windows = None, 0, []
    for key, anchor_id in pairs:
        anchor, score, negative, vec_id = unpack(key)
        if anchor != current:
            current, opened, windows = anchor, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([vec_id, score, 0])
            continue
        left = []
        for window in windows:
            positive_id, positive_score, found = window
            if 100 * score < low * positive_score:
                continue
            if 100 * score <= high * positive_score:
                window[2] = found = found + 1
                yield anchor_id, positive_id, found, vec_id, positive_score, score
            if found < negatives:
                left.append(window)
        windows = left


class Positives:
    """The best same-label rows of each anchor of a panel, batch by batch."""

    def __init__(self, panel, k: int):
        self.panel, self.k = panel, k
        self.floor = np.full(len(panel["anchor"]), -np.inf)
        self.kept = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64))

    def add(self, score, labels, ids):
        fit = (labels[None] == self.panel["label"][:, None]) & (ids[None] != self.panel["vec_id"][:, None]) & (score >= self.floor[:, None])
        q, j = np.nonzero(fit)
        q, s, i = (np.concatenate(x) for x in zip(self.kept, (q, score[q, j], ids[j])))
        at = first_per_group(q, -s, i, k=self.k)
        self.kept = q, s, i = q[at], s[at], i[at]
        full = np.flatnonzero(np.bincount(q, minlength=len(self.floor)) == self.k)
        worst = np.full(len(self.floor), np.inf)
        np.minimum.at(worst, q, s)
        self.floor[full] = worst[full]

    def rows(self):
        return self.kept


class Negatives:
    """The first other-label rows of each window of a panel, batch by batch."""

    def __init__(self, panel, k: int, low: int, high: int):
        self.panel, self.k, self.low, self.high = panel, k, low, high
        # windows by slot: (anchors of the panel that have one, lower and upper end, what is kept)
        self.slots = [{"q": q, "low": np.ceil(low * s / 100), "high": np.floor(high * s / 100),
                       "kept": tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64))} for q, s in panel["windows"]]

    def add(self, score, labels, ids):
        other = (labels[None] != self.panel["label"][:, None]) & (ids[None] != self.panel["vec_id"][:, None])
        for slot in self.slots:
            part = score[slot["q"]]
            w, j = np.nonzero(other[slot["q"]] & (part >= slot["low"][:, None]) & (part <= slot["high"][:, None]))
            w, s, i = (np.concatenate(x) for x in zip(slot["kept"], (w, part[w, j], ids[j])))
            at = first_per_group(w, -s, i, k=self.k)
            slot["kept"] = w, s, i = w[at], s[at], i[at]
            full = np.flatnonzero(np.bincount(w, minlength=len(slot["q"])) == self.k)
            worst = np.full(len(slot["q"]), np.inf)
            np.minimum.at(worst, w, s)
            slot["low"][full] = np.maximum(slot["low"][full], worst[full])

    def rows(self):
        """Each row once per anchor, whichever windows keep it; repeated rows as often as a window keeps them."""
        q, s, i, turn = [np.concatenate(x) for x in zip(*([slot["q"][slot["kept"][0]], slot["kept"][1], slot["kept"][2],
                                                           _turns(*slot["kept"])] for slot in self.slots))] if self.slots else [np.zeros(0, np.int64)] * 4
        if not len(q):
            return q, s, i
        once = np.unique(np.stack([q, s.astype(np.int64), i, turn]), axis=1)
        return once[0], once[1], once[2]


def _turns(w, s, i) -> np.ndarray:
    """0, 1, ... for equal entries that follow each other."""
    same = np.zeros(len(w), bool)
    same[1:] = (w[1:] == w[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(w))))
    return np.arange(len(w)) - start


def _scan(rows: DataFrame, panel: dict, make, width: int) -> DataFrame:
    """What ``make(panel)`` keeps in each task of all rows, as (anchor, anchor_id, negative, score, vec_id)."""
    def run(batches):
        import pyarrow as pa
        kept = make(panel)
        for batch in batches:
            if len(batch):
                score = panel["v"] @ matrix(batch.column("v"), width).T
                kept.add(score, batch.column("label").to_numpy(), batch.column("vec_id").to_numpy())
        q, s, i = kept.rows()
        yield pa.RecordBatch.from_pydict({"anchor": panel["anchor"][q], "anchor_id": panel["vec_id"][q],
                                          "negative": np.full(len(q), isinstance(kept, Negatives), np.int32),
                                          "score": np.asarray(s).astype(np.int64), "vec_id": i})
    return rows.mapInArrow(run, _PAIRS)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   panel_size: int = PANEL) -> DataFrame:
    """Hard negatives of (vec_id long, label long, v array<double>) for the rows where the column ``is_anchor`` holds."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = staged(rows.select("vec_id", "label", "v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    anchors = staged(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()))
    folder = f"{ensure_checkpoint_dir(spark)}/hard_negatives/{uuid.uuid4().hex}"
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    ranges = panels(anchors, "anchor", panel_size)
    for first, end in ranges:
        own = anchors.where((F.col("anchor") >= first) & (F.col("anchor") < end)).toArrow().combine_chunks()
        column = lambda name: own.column(name).combine_chunks()
        panel = {"anchor": column("anchor").to_numpy(), "vec_id": column("vec_id").to_numpy(), "label": column("label").to_numpy(),
                 "v": matrix(column("v"), width)}
        found = staged(_scan(rows, panel, lambda p: Positives(p, positives), width))
        # a few rows per anchor and task
        top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
        top.drop("place").write.mode("append").parquet(folder)
        chosen = top.where("score >= 0").select("anchor", "score", "place").toPandas()
        where = {a: k for k, a in enumerate(panel["anchor"].tolist())}
        chosen["q"] = chosen["anchor"].map(where)
        panel["windows"] = [(g["q"].to_numpy(np.int64), g["score"].to_numpy(float)) for _, g in chosen.groupby("place")]
        _scan(rows, panel, lambda p: Negatives(p, negatives, low, high), width).write.mode("append").parquet(folder)
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = spark.read.schema(_PAIRS).parquet(folder).rdd.map(
        lambda r: (pack(r["anchor"], r["score"], r["negative"], r["vec_id"]), r["anchor_id"]))
    ordered = pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(ordered.mapPartitions(lambda it: stream(it, positives, negatives, low, high)), SCHEMA)


def labelled(vectors: DataFrame, label, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v = floor(scale * x) of every component."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return (vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()))
