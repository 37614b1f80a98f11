"""A matrix packed by row block, stored once for any number of passes, and the exchange between row blocks and features.

A block holds its rows as arrays: cells in pieces of a bounded number, with the places of their features in the block's own
list.  Features are dealt to parts by their id; a part knows where the features of each block stand in it.  A pass over the
matrix then moves one array per (part, block) with a number for each feature that the block has, and no cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from widemargin.session import bucketed, cut_lineage

#: Cells of a piece, on average; a piece is one row of the stored table.
PIECE_CELLS = 1 << 20
#: Cells of the matrix for each part of the features.
PART_CELLS = 1 << 22
_RAW = "block int, piece int, ids binary, y binary, starts binary, features binary, place binary, value binary"
_PACKED = "kind byte, block int, part int, ids binary, y binary, starts binary, place binary, value binary"
_PIECE, _FEATURES = 0, 1
#: What passes hand to each other: arrays of a part, of a block, or of both.
LINES = "kind byte, part int, block int, a binary, b binary, c binary, d binary, e binary, t binary"
IDS, LINK, STATE, MESSAGE, SUMS, ROWS, FAR, MOVED, TOTAL = range(9)


def _schema(ddl: str):
    import pyarrow as pa
    kinds = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[kind]) for n, kind in (c.split() for c in ddl.split(","))])


def line(kind: int, part: int = -1, block: int = -1, **arrays) -> dict:
    """One row of LINES."""
    return {"kind": kind, "part": part, "block": block} | {n: np.ascontiguousarray(v).tobytes() for n, v in arrays.items()}


def lines(rows: list[dict], ddl: str = LINES):
    import pyarrow as pa
    schema = _schema(ddl)
    return pa.Table.from_pydict({n: [r.get(n) for r in rows] for n in schema.names}, schema=schema)


def array(table, name: str, k: int, dtype="float64") -> np.ndarray:
    """Row ``k`` of a binary column, without a copy."""
    value = table.column(name)[k]
    return np.frombuffer(value.as_buffer(), dtype) if value.is_valid else np.zeros(0, dtype)


def found(table, kind: int) -> list[int]:
    """Places of the rows of one kind, by part and block."""
    kinds, part, block = (table.column(n).to_numpy() for n in ("kind", "part", "block"))
    at = np.flatnonzero(kinds == kind)
    return at[np.lexsort((block[at], part[at]))].tolist()


def row_sums(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; rows may be empty."""
    sums = np.add.reduceat(np.append(values, 0.0), np.minimum(starts[:-1], len(values))) if len(starts) > 1 else np.zeros(0)
    return sums * (np.diff(starts) > 0)


# ---------------------------------------------------------------- packing
def _piece(key, cells, rows):
    """The rows of a piece and their cells; a cell belongs to the first of several rows of its id, cells of no row are left out."""
    rows = rows.sort_by([("row_id", "ascending")])
    ids, y = rows.column("row_id").to_numpy(), rows.column("y").to_numpy().astype(float)
    at = np.searchsorted(ids, cells.column("row_id").to_numpy())
    keep = ids[np.minimum(at, len(ids) - 1)] == cells.column("row_id").to_numpy() if len(ids) else np.zeros(len(at), bool)
    features, place = np.unique(cells.column("feature_id").to_numpy()[keep], return_inverse=True)
    code, value = at[keep] * max(1, len(features)) + place, cells.column("value").to_numpy()[keep]
    del at, place, cells
    order = np.argsort(code, kind="stable")
    code, value = code[order], value[order]
    # the cells of one row and feature are one cell
    first = np.flatnonzero(np.append(True, np.diff(code) != 0)) if len(code) else np.zeros(0, int)
    if len(first) < len(code):
        code, value = code[first], np.add.reduceat(value, first)
    row, place = np.divmod(code, max(1, len(features)))
    starts = np.searchsorted(row, np.arange(len(ids) + 1))
    return lines([{"block": key[0].as_py(), "piece": key[1].as_py()} | {n: np.ascontiguousarray(v).tobytes() for n, v in (
        ("ids", ids.astype(np.int64)), ("y", y), ("starts", starts.astype(np.int64)), ("features", features.astype(np.int64)),
        ("place", place.astype(np.int32)), ("value", value.astype(float)))}], _RAW)


def _merge(parts: int):
    """The pieces of a block with places in one list of features, by part, those with most cells first."""
    def merge(key, pieces):
        block = key[0].as_py()
        pieces = pieces.sort_by([("piece", "ascending")])
        held = [array(pieces, "features", k, np.int64) for k in range(len(pieces))]
        ids, inside = np.unique(np.concatenate(held), return_inverse=True)
        ends = np.cumsum([0] + [len(h) for h in held])
        inside = [inside[a:z] for a, z in zip(ends[:-1], ends[1:])]
        count = np.zeros(len(ids), np.int64)
        for k, to in enumerate(inside):
            count[to] += np.bincount(array(pieces, "place", k, np.int32), minlength=len(to))
        part = np.mod(ids, parts)
        order = np.lexsort((ids, -count, part))
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(len(ids), dtype=np.int32)
        out = [{"kind": _PIECE, "block": block, "part": k, "place": rank[inside[k]][array(pieces, "place", k, np.int32)].tobytes()}
               | {n: pieces.column(n)[k].as_py() for n in ("ids", "y", "starts", "value")} for k in range(len(pieces))]
        ids, part = ids[order], part[order]
        out += [{"kind": _FEATURES, "block": block, "part": int(p), "ids": ids[part == p].tobytes()} for p in np.unique(part)]
        return lines(out, _PACKED)
    return merge


def _links(key, table):
    """The list of a part's features, and the places in it of the features of each block."""
    part, block = key[0].as_py(), table.column("block").to_numpy()
    held = [array(table, "ids", k, np.int64) for k in range(len(table))]
    ids = np.unique(np.concatenate(held))
    return lines([line(IDS, part, a=ids)] + [line(LINK, part, int(b), a=np.searchsorted(ids, h).astype(np.int32)) for b, h in zip(block, held)])


class Packed:
    """``pieces`` by block; ``links`` (LINES): IDS of each part, LINK of each part and block."""

    def __init__(self, matrix: DataFrame, labels: DataFrame, blocks: int, cells: int):
        spark = matrix.sparkSession
        self.blocks, self.parts = blocks, int(max(1, -(-cells // PART_CELLS)))
        pieces = int(max(1, -(-cells // (blocks * PIECE_CELLS))))
        # numbers of blocks that fall into a bucket each
        hashed = spark.range(40 * blocks + 40).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(blocks)).alias("b"))
        self.names = [r["id"] for r in hashed.groupBy("b").agg(F.min("id").alias("id")).orderBy("b").collect()]
        if len(self.names) < blocks:
            self.names = list(range(blocks))
        key = [self.block().alias("block"),
               F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(pieces)).cast("int").alias("piece")]
        cells = matrix.select(*key, "row_id", F.col("feature_id").cast("long").alias("feature_id"), F.col("value").cast("double").alias("value"))
        rows = labels.select(*key, "row_id", "y")
        raw = cells.groupBy("block", "piece").cogroup(rows.groupBy("block", "piece")).applyInArrow(_piece, _RAW)
        self.table = bucketed(raw.groupBy("block").applyInArrow(_merge(self.parts), _PACKED), "block", buckets=blocks)
        self.links = cut_lineage(self.table.where(F.col("kind") == _FEATURES).select("block", "part", "ids").groupBy("part").applyInArrow(_links, LINES))

    def block(self):
        """Block of a row."""
        return F.element_at(F.array(*[F.lit(n) for n in self.names]), F.pmod(F.xxhash64("row_id"), F.lit(self.blocks)).cast("int") + 1)

    def by_block(self, fn, light: DataFrame, schema: str = LINES) -> DataFrame:
        """``fn(block, pieces, features, lines)`` of each block, written."""
        def run(key, table, light):
            kinds, part = table.column("kind").to_numpy(), table.column("part").to_numpy()
            at = [np.flatnonzero(kinds == kind) for kind in (_PIECE, _FEATURES)]
            pieces, features = ([int(k) for k in a[np.argsort(part[a])]] for a in at)
            # (row ids, y, starts, places of the features, values) of each piece
            held = [tuple(array(table, n, k, d) for n, d in (("ids", np.int64), ("y", float), ("starts", np.int64), ("place", np.int32), ("value", float)))
                    for k in pieces]
            lists = {int(part[k]): array(table, "ids", k, np.int64) for k in features}
            return fn(key[0].as_py(), held, lists, light)
        return cut_lineage(self.table.groupBy("block").cogroup(light.groupBy("block")).applyInArrow(run, schema))

    def messages(self, values: DataFrame, names: list[str]) -> DataFrame:
        """MESSAGE lines with a..e = ``names`` of (feature_id, names) for the features of each block, 0 where there are none."""
        parts, given = self.parts, "abcde"[:len(names)]

        def send(key, links, values):
            if not len(links):
                return lines([])
            ids = array(links, "a", found(links, IDS)[0], np.int64)
            place = np.searchsorted(ids, values.column("feature_id").to_numpy())
            known = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == values.column("feature_id").to_numpy())
            held = {g: np.zeros(len(ids)) for g in given}
            for g, n in zip(given, names):
                held[g][place[known]] = values.column(n).to_numpy()[known]
            block = links.column("block").to_numpy()
            return lines([line(MESSAGE, key[0].as_py(), int(block[k]), **{g: v[array(links, "a", k, np.int32)] for g, v in held.items()})
                          for k in found(links, LINK)])
        keyed = values.select(F.pmod("feature_id", F.lit(parts)).cast("int").alias("part"), "feature_id", *[F.col(n).cast("double").alias(n) for n in names])
        return cut_lineage(self.links.groupBy("part").cogroup(keyed.groupBy("part")).applyInArrow(send, LINES))

    def scores(self, messages: DataFrame, names: dict[str, str]) -> DataFrame:
        """(row_id, cells, names): number of cells and X times each message, for the rows with cells."""
        def score(block, pieces, features, light):
            import pyarrow as pa
            of = {n: received(light, g) for n, g in names.items()}
            out = {"row_id": [], "cells": []} | {n: [] for n in names}
            for ids, _, starts, place, value in pieces:
                some = np.diff(starts) > 0
                out["row_id"].append(ids[some])
                out["cells"].append(np.diff(starts)[some])
                for n, v in of.items():
                    out[n].append(row_sums(starts, v[place] * value)[some])
            return pa.table({n: np.concatenate(v) if v else np.zeros(0) for n, v in out.items()}).cast(_schema(ddl))
        ddl = "row_id long, cells long, " + ", ".join(f"{n} double" for n in names)
        return self.by_block(score, messages, ddl)

    def cells_of(self, rows: DataFrame, messages: DataFrame, names: dict[str, str]) -> DataFrame:
        """(row_id, feature_id, value, names): the cells of ``rows`` (row_id) with the messages of their features."""
        def cells(block, pieces, features, light):
            import pyarrow as pa
            of, wanted = {n: received(light, g) for n, g in names.items()}, received(light, "a", np.int64, ROWS)
            ids = np.concatenate([features[p] for p in sorted(features)]) if features else np.zeros(0, np.int64)
            out = {"row_id": [], "feature_id": [], "value": []} | {n: [] for n in names}
            for rows, _, starts, place, value in pieces:
                row = np.repeat(rows, np.diff(starts))
                keep = np.isin(row, wanted)
                at = place[keep]
                for n, v in (("row_id", row[keep]), ("feature_id", ids[at]), ("value", value[keep]), *[(n, v[at]) for n, v in of.items()]):
                    out[n].append(v)
            return pa.table({n: np.concatenate(v) if v else np.zeros(0) for n, v in out.items()}).cast(_schema(ddl))
        ddl = "row_id long, feature_id long, value double, " + ", ".join(f"{n} double" for n in names)
        keyed = rows.select(self.block().alias("block"), "row_id")

        def gather(key, table):
            return lines([line(ROWS, -1, key[0].as_py(), a=np.unique(table.column("row_id").to_numpy()).astype(np.int64))])
        wanted = keyed.groupBy("block").applyInArrow(gather, LINES)
        return self.by_block(cells, messages.unionByName(wanted), ddl)


def received(light, name: str, dtype="float64", kind: int = MESSAGE) -> np.ndarray:
    """The arrays of one kind, of all parts in order: for messages one number per feature of the block."""
    held = [array(light, name, k, dtype) for k in found(light, kind)]
    return np.concatenate(held) if held else np.zeros(0, dtype)
