"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from widemargin.session import cut_lineage

#: Rows of one Arrow batch; texts can be long, so a batch has to stay small.
BATCH_ROWS = 1000
#: Values of the bounded broadcast in ``marked``.
MARKS = 1 << 20
#: Fixed value: the characters that separate words.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, unless the session asks for less already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """64-bit key of a documents row; repeated rows share it, and share their results."""
    return F.xxhash64("doc_id", "text")


def fold(column: str, remainder: int, modulus: int) -> Column:
    """crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def marked(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Splits ``df`` into (rows whose ``key`` may be in ``keys``, rows whose key surely isn't).

    The broadcast holds hashes of the keys cut to ``MARKS`` values, so its size is
    bounded whatever the keys.  The first part still needs the exact join, which
    then shuffles few rows while the keys are few.
    """
    mark = lambda: F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(MARKS))
    marks = F.broadcast(keys.select(mark().alias("_widemargin_mark")).distinct())
    met = mark() == F.col("_widemargin_mark")
    return df.join(marks, met, "left_semi"), df.join(marks, met, "left_anti")


def staged(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder and read back."""
    return cut_lineage(df)


def fragments_for(spark: SparkSession, entries: int, per_fragment: int = 4_000_000) -> int:
    """Fragments that keep a task near ``per_fragment`` entries and give every core some."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-int(entries) // per_fragment))


# ---------------------------------------------------------------- hashing words in numpy
def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


_UP: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least n powers of the hash base, or of its inverse, mod 2**64."""
    key = int(inverse)
    if key not in _UP or len(_UP[key]) < n:
        _UP[key] = _powers(_BASE_INV if inverse else _BASE, max(n, _PIECE + 1))
    return _UP[key]


def byte_values(lower: bool, word_bytes: bytes | None = None) -> np.ndarray:
    """Hash value of each byte; 0 marks a separator.

    ``word_bytes`` None: all but the fixed separators belong to words.
    """
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    outside = np.frombuffer(SEPARATORS, np.uint8) if word_bytes is None else np.setdiff1d(
        np.arange(256, dtype=np.uint8), np.frombuffer(word_bytes, np.uint8))
    values[outside] = 0
    return values


def word_hashes(texts: list[bytes | None], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, words per text)."""
    buffer = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    inside = values != 0
    found, begun, low = [], [], 0
    while low < len(buffer):
        high = min(low + _PIECE, len(buffer))
        while high < len(buffer):  # end behind a separator, so that no word is cut
            gaps = np.flatnonzero(~inside[buffer[low:high]])
            if len(gaps):
                high = low + int(gaps[-1]) + 1
                break
            high = min(low + 2 * (high - low), len(buffer))
        piece = buffer[low:high]
        words = inside[piece].astype(np.int8)
        steps = np.diff(words, prepend=np.int8(0), append=np.int8(0))
        starts, stops = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * powers(len(piece))[:len(piece)], out=sums[1:])
        found.append(mix((sums[stops] - sums[starts]) * powers(len(piece), True)[starts]
                         + (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        begun.append(starts + low)
        low = high
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    upto = np.searchsorted(np.concatenate(begun), ends)
    return np.concatenate(found), np.diff(upto, prepend=0)


def as_bytes(column) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8."""
    import pyarrow as pa
    return column.cast(pa.large_binary()).to_pylist()


def runs(counts: np.ndarray) -> np.ndarray:
    """Start of each of consecutive pieces of these sizes, and the end."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])
