"""What the operators on vectors share: who takes part, Arrow lists as matrices, panels of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_PART = 33  # monotonically_increasing_id keeps the partition number above this bit


def usable(vector: str) -> Column:
    """The vector is not null and holds neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(column, width: int, fill: float = 0.0, kind=np.float64) -> np.ndarray:
    """The lists of an Arrow column as rows of a matrix; a list that ends earlier is filled up."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.astype(kind).reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, kind)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def first_per_group(group: np.ndarray, *order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group, in the order given (most important key first)."""
    at = np.lexsort((*order[::-1], group))
    own = group[at]
    start = np.flatnonzero(np.diff(own, prepend=own[:1] - 1)) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return at[place < k]


def panels(numbered: DataFrame, number: str, size: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of ``number``, a written monotonically_increasing_id, that hold at most ``size`` rows each.

    The driver gets a count per ``size`` rows and partition.
    """
    place = F.col(number).bitwiseAND((1 << _PART) - 1)
    chunk = F.shiftleft(F.shiftright(number, _PART), _PART) + F.floor(place / size) * size
    counts = numbered.groupBy(chunk.cast("long").alias("low")).agg(F.count(F.lit(1)).alias("n")).orderBy("low").collect()
    out, held = [], size
    for r in counts:
        if held + r["n"] > size:
            out.append(r["low"])
            held = 0
        held += r["n"]
    return list(zip(out, [*out[1:], (1 << 63) - 1]))
