"""Quality classifier by compression with zstandard dictionaries.

Two dictionaries are built, from good and from bad labelled text.  A text is cut
into chunks, each chunk is compressed with either dictionary, and the difference
of the two sums, divided by the size of the text, says which kind of text it is
made of.  A logistic curve, fitted on labelled texts that went into no
dictionary, turns the difference into a score, at the share that the classes have
among all labels.

The labelled sample is bounded: ``per_class`` texts of each class, the first by
hash of the id, half for the dictionaries, half for the curve, both with their whole
texts.  Everything else covers whole texts of all rows.

Scores use the text alone.  Null and empty texts have difference 0 and the score
of that; very long texts are read chunk by chunk.  Columns besides doc_id and text play
no part and ``keep_good`` returns them as they are.  Labels that contradict each other, null labels and ids without a row
teach nothing.  Without both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from widemargin.llm.common import as_bytes, fold, small_batches

THRESHOLD = 0.3
_CHUNK, _PIECE, _DICTIONARY, _LEVEL = 2048, 1024, 112_640, 3


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels that teach."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~fold("doc_id", 0, 5))
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).where("quality = _q")
            .drop("_q"))


def _sample(documents: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, quality, half) of at most 2 * per_class labelled rows."""
    known = _known(labels).withColumn("_h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    # only ids, at most per_class of each class
    chosen = [known.where(F.col("quality") == q).orderBy("_h", "doc_id").limit(per_class) for q in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    half = F.conv(F.substring("_h", 32, 1), 16, 10).cast("int") % 2
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(ids, "doc_id")
            .groupBy("doc_id", "quality", half.alias("half")).agg(F.max("text").alias("text")))


def _pieces(text: bytes) -> list[bytes]:
    """The whole text in pieces, the samples of a dictionary."""
    return [text[i:i + _PIECE] for i in range(0, len(text), _PIECE)]


def _dictionary(samples: list[bytes]):
    import zstandard
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(_DICTIONARY, samples).as_bytes(), False
    except (zstandard.ZstdError, ValueError):  # too little text to train on: its end is the dictionary
        return b"".join(samples)[-_DICTIONARY:], True


def _compressor(dictionary: tuple[bytes, bool]):
    import zstandard
    data = zstandard.ZstdCompressionDict(dictionary[0], dict_type=zstandard.DICT_TYPE_RAWCONTENT if dictionary[1]
                                         else zstandard.DICT_TYPE_FULLDICT)
    data.precompute_compress(level=_LEVEL)
    return zstandard.ZstdCompressor(level=_LEVEL, dict_data=data, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


def difference(text: bytes | None, good, bad) -> float:
    """How much smaller the good dictionary makes the text, per byte."""
    if not text:
        return 0.0
    sizes = [(len(good.compress(text[i:i + _CHUNK])), len(bad.compress(text[i:i + _CHUNK]))) for i in range(0, len(text), _CHUNK)]
    return sum(b - g for g, b in sizes) / len(text)


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve, by Newton steps with a small ridge."""
    scale = float(np.std(x)) or 1.0
    rows, w = np.stack([np.ones(len(x)), x / scale], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), rows.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


class Model:
    """Two dictionaries and the curve."""

    def __init__(self, good=None, bad=None, intercept=0.0, slope=0.0):
        self.good, self.bad, self.intercept, self.slope = good, bad, intercept, slope

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.good is None:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.differences(texts), -30, 30)))

    def differences(self, texts) -> np.ndarray:
        good, bad = _compressor(self.good), _compressor(self.bad)
        return np.array([difference(t, good, bad) for t in texts], float)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    small_batches(documents.sparkSession)
    sample = _sample(documents, labels, per_class)
    rows = sample.where("half = 0").orderBy("doc_id").select("quality", "text").collect()
    text = {q: [p for r in rows if r["quality"] == q for p in _pieces(r["text"].encode())] for q in (0, 1)}
    if not text[0] or not text[1]:
        return Model()
    model = Model(_dictionary(text[1]), _dictionary(text[0]))

    def measure(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(model.differences(as_bytes(batch.column("text"))))], ["quality", "d"])

    known = sample.where("half = 1").mapInArrow(measure, "quality int, d double").collect()
    y = np.array([r["quality"] for r in known], float)
    if not 0 < y.sum() < len(y):
        return Model()
    # in a fixed order, so that reruns agree to the last bit
    x = np.array([r["d"] for r in known])
    order = np.lexsort((y, x))
    model.intercept, model.slope = _curve(x[order], y[order])
    # the sample holds the classes alike; the score follows their share among all labels
    share = {r["quality"]: r["count"] for r in _known(labels).groupBy("quality").count().collect()}
    model.intercept += float(np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def _scored(model: Model, columns: list[str]):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            scores = pa.array(model.scores(as_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], scores], [*columns, "score"])
    return run


def score_quality(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id", 0, 5).alias("held_out"), "text")
    scored = docs.mapInArrow(_scored(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that the classifier doesn't reject."""
    small_batches(documents.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield batch.filter(pa.array(model.scores(as_bytes(batch.column("text"))) >= THRESHOLD))
    return documents.mapInArrow(run, documents.schema)
