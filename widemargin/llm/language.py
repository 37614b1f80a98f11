"""Language identification with string kernels.

The kernel of two texts compares which character n-grams of 1 to 3 letters they
hold (presence, blended spectrum), normalised by the number each holds.  Nyström
landmarks stand for the kernel: with Z the landmarks, a text becomes
K(text, Z) K(Z, Z)^(-1/2).  One-versus-rest ridge regression on that is kernel
ridge regression; a text is scored by one matrix product per batch.  Long texts
are cut into passages and their scores averaged by length, so whole texts count.

The labelled sample is bounded: of every language ``per_language`` texts, the first by
hash of the id, with all their passages.  About ``landmarks`` of those passages, the first
of each language by hash, are landmarks and on the driver; the tasks sum the normal
equations of the others, so that no task or driver holds the sample.  n-grams are hashed
to ``DIMENSIONS`` presence bits.

Null texts and texts without a letter get ``und`` with score 0; without any
labelled text all do, and empty tables give no rows.  Ties go to the language that sorts
first, repeated rows are answered each, and other columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from widemargin.llm.common import fold, small_batches, staged

DIMENSIONS = 4096
_PASSAGE = 2000
#: Tasks of the fit, each with one partial sum.
_TASKS = 32


def passages(text: str, size: int = _PASSAGE) -> list[str]:
    """The whole text in passages of about equal length."""
    n = max(1, round(len(text) / size))
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def presence(texts: list[str]) -> np.ndarray:
    """One row per text: which hashed n-grams it holds, divided by the root of their number."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 48, np.uint32(32), code)  # marks and blanks are one sign
        gram = code.copy()
        for n in range(3):
            if n:
                gram = gram[:-1] * np.uint32(0x01000193) ^ code[n:]
            row[(gram * np.uint32(0x9E3779B1) ^ np.uint32(n * 977)) >> np.uint32(20)] = 1
    out /= np.sqrt(out.sum(1, keepdims=True))
    return out


class Model:
    """Weights of the presence bits for each language: landmarks and ridge weights in one matrix."""

    def __init__(self, languages: list[str], landmarks=None, weights=None):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def outputs(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), len(self.languages)))
        parts = [(k, p) for k, t in enumerate(texts) for p in passages(t)]
        for low in range(0, len(parts), 512):
            block = parts[low:low + 512]
            found = (presence([p for _, p in block]) @ self.landmarks.T) @ self.weights
            np.add.at(rows, [k for k, _ in block], found * np.array([[len(p)] for _, p in block]))
        return rows / np.array([[max(len(t), 1)] for t in texts])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)] if self.languages else []
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if known:
            found = self.outputs([texts[k] for k in known])
            for k, best, value in zip(known, found.argmax(1), found.max(1)):
                names[k], scores[k] = self.languages[best], min(max(value, 0.0), 1.0)
        return names, scores


def _lettered(text: str) -> list[str]:
    return [p for p in passages(text) if any(c.isalpha() for c in p)]


def _candidates(each: int):
    """The first ``each`` passages of every language in a task, by hash."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest
        best: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = {(xxh64_intdigest(p.encode()) >> 1, p) for p in _lettered(text)}
                best[lang] = sorted(own | set(best.get(lang, [])))[:each]
        rows = [(lang, h, p) for lang, own in best.items() for h, p in own]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string()])],
                                         ["lang", "h", "passage"])
    return run


def _equations(names: list[str], marks: np.ndarray, root: np.ndarray, shares: np.ndarray):
    """Sums of the normal equations over a task's passages, each weighed by its language's share."""
    def run(batches):
        import pyarrow as pa
        size, number = root.shape[1], {x: k for k, x in enumerate(names)}
        left, right = np.zeros((size, size)), np.zeros((size, len(names)))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own, k = _lettered(text), number[lang]
                for low in range(0, len(own), 512):
                    found = (presence(own[low:low + 512]) @ marks.T).astype(float) @ root
                    left += shares[k] * (found.T @ found)
                    right[:, k] += shares[k] * found.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["l", "r"])
    return run


def _counts(batches):
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([len(_lettered(t)) for t in batch.column("text").to_pylist()])],
                                         ["lang", "n"])


def fit_sample(sample: DataFrame, landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """Kernel ridge regression on the passages of ``sample`` (lang, text)."""
    counts = sample.mapInArrow(_counts, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0").collect()
    names = sorted(r["lang"] for r in counts)
    if not names:
        return Model([])
    times = np.array([dict(map(tuple, counts))[x] for x in names], float)
    each = max(1, landmarks // len(names))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "passage"))
    # at most ``each`` rows of a language leave a task
    chosen = (sample.mapInArrow(_candidates(each), "lang string, h long, passage string").distinct()
              .withColumn("rank", rank).where(F.col("rank") <= each).orderBy("lang", "rank").collect())
    marks = np.unique(presence([r["passage"] for r in chosen]), axis=0)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    # languages count alike, however many passages they have
    shares = times.sum() / len(names) / times
    parts = sample.mapInArrow(_equations(names, marks, root, shares), "l binary, r binary").collect()
    left = sum(np.frombuffer(r["l"]).reshape(root.shape[1], -1) for r in parts)
    right = sum(np.frombuffer(r["r"]).reshape(root.shape[1], -1) for r in parts)
    solved = np.linalg.solve(left + ridge * times.sum() * np.eye(len(left)) / 10, right)
    return Model(names, marks, (root @ solved).astype(np.float32))


def fit(documents: DataFrame, per_language: int = 250) -> Model:
    """Learns from text and lang of the rows whose crc32 of the id, mod 4, is not 2."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~fold("doc_id", 2, 4))
    small_batches(documents.sparkSession)
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # ids only, at most per_language of each language: the first of its parts first, so that a large one is not one task
    ids = rows.select("doc_id", "lang", order.alias("_h")).distinct().withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(1024)))
    for keys in (["lang", "_part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))
        ids = ids.withColumn("_rank", rank).where(F.col("_rank") <= per_language).drop("_rank")
    sample = (rows.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])
              .groupBy("doc_id", "lang").agg(F.max("text").alias("text")))
    # one partial sum a task; the order of a task's rows is fixed, so that reruns agree
    return fit_sample(staged(sample.repartition(_TASKS, "doc_id").sortWithinPartitions("doc_id", "lang")))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents``."""
    small_batches(documents.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                                             ["doc_id", "held_out", "lang_pred", "score"])
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id", 2, 4).alias("held_out"), "text")
    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
