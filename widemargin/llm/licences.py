"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Words around a cue of licensing are compared with template sentences, in every window
of the sentence's own length, and whole texts with a cue with the full licence texts
in ``licence_texts``, by the cosine of sparse TF-IDF vectors of words and word pairs.
Document frequencies of the templates' terms are counted over the whole corpus;
terms outside the templates weigh as much as the heaviest template term.  A file
that is close to a full text, or mostly notices, is a licence file of its directory.  A file
without a notice of its own inherits from its nearest ancestor directory with a
licence file: directories are spread over their ancestors and joined by path, so
work grows with directories times depth, not with pairs.

Null and empty texts have no notice, but inherit.  Rows without a path inherit
nothing.  Ties between templates go to the name that sorts first; between licence
files of one directory the higher cosine wins, then the name.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from widemargin.llm.common import small_batches, staged

# fixed values: how licences name themselves
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
                   "you may not use this file except in compliance with the License"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
_CUE = re.compile(r"licen[cs]|copyright|redistribution|hereby granted|cc0|spdx", re.I)
_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> Counter:
    """Words and pairs of neighbours, with their number."""
    words = _TERM.findall(text.lower())
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def full_texts() -> dict[str, tuple[str, ...]]:
    """The full text of each licence, as far as ``licence_texts`` has it."""
    return {p.stem: (p.read_text(),) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


class Matcher:
    """Sentences and full texts as sparse unit vectors over their terms."""

    def __init__(self, frequencies: dict[str, int], total: int, templates=TEMPLATES, texts=()):
        vocabulary = sorted({t for group in (templates, dict(texts)) for g in group.values() for x in g for t in terms(x)})
        self.column = {t: k for k, t in enumerate(vocabulary)}
        # the last column is every term outside the templates
        idf = [log((1 + total) / (1 + frequencies.get(t, 0))) + 1 for t in vocabulary]
        self.idf = np.array([*idf, max(idf, default=1.0)])
        self.names, self.rows, self.lengths = self._rows(templates)
        self.text_names, self.text_rows, _ = self._rows(dict(texts))

    def _rows(self, templates):
        listed = [(name, t) for name, group in sorted(templates.items()) for t in group]
        rows = np.zeros((len(listed), len(self.idf)))
        for row, (_, t) in zip(rows, listed):
            for x, n in terms(t).items():
                row[self.column[x]] = n * self.idf[self.column[x]]
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        return [n for n, _ in listed], rows, [len(_TERM.findall(t.lower())) for _, t in listed]

    def _weight(self, words: list[str]) -> float:
        """Length of the vector of these words and their pairs."""
        found = Counter(words) + Counter(zip(words, words[1:]))
        other = len(self.column)
        return sqrt(sum((n * self.idf[self.column.get(t if isinstance(t, str) else " ".join(t), other)]) ** 2 for t, n in found.items()))

    def whole(self, words: list[str]) -> tuple[str | None, float]:
        """(licence, cosine) of the nearest full text."""
        if not self.text_names or not words:
            return None, 0.0
        columns = [self.column.get(t, -1) for t in words] + [self.column.get(f"{a} {b}", -1) for a, b in zip(words, words[1:])]
        columns = np.array([c for c in columns if c >= 0], np.int64)
        scores = self.text_rows[:, columns] @ self.idf[columns] / self._weight(words)
        k = int(scores.argmax())
        return self.text_names[k], float(scores[k])

    def notices(self, words: list[str], cues: np.ndarray, least: float) -> list[tuple[float, str, int, int]]:
        """(-cosine, licence, start, end) of the windows around a cue that are ``least`` close to a sentence."""
        other, found = len(self.column), []
        single = np.array([self.column.get(t, other) for t in words], np.int64)
        double = np.array([self.column.get(f"{a} {b}", other) for a, b in zip(words, words[1:])], np.int64)
        upto = lambda x: np.concatenate([np.zeros(1), np.cumsum(x)])
        square = upto(self.idf[single] ** 2), upto(self.idf[double] ** 2)
        for name, row, size in zip(self.names, self.rows, self.lengths):
            size = min(size, len(words))
            start = np.unique(np.clip((cues[:, None] - np.arange(size)).ravel(), 0, len(words) - size))
            product = upto(row[single] * self.idf[single]), upto(row[double] * self.idf[double])
            sums = [x[start + size] - x[start] + y[start + size - 1] - y[start] for x, y in (product, square)]
            # repeats inside a window only make its vector longer: the first cosine is never too low
            for k in np.flatnonzero(sums[0] >= (least - 1e-9) * np.sqrt(np.maximum(sums[1], 1e-12))):
                i = int(start[k])
                value = float(sums[0][k]) / self._weight(words[i:i + size])
                if value >= least:
                    found.append((-value, name, i, i + size))
        return sorted(found)

    def measure(self, text: str | None, least: float, share: float, near: float) -> tuple[str | None, float | None, bool]:
        """(licence, cosine, whether the text is a licence file)."""
        text = (text or "").lower()
        at = [m.start() for m in _CUE.finditer(text)]
        tokens = list(_TERM.finditer(text)) if at else []
        if not tokens:
            return None, None, False
        words = [m.group() for m in tokens]
        name, value = self.whole(words)
        if value >= near:
            return name, value, True
        cues = np.unique(np.maximum(np.searchsorted([m.start() for m in tokens], at, "right") - 1, 0))
        found = self.notices(words, cues, least)
        if not found:
            return None, None, False
        taken = np.zeros(len(words), bool)
        for _, _, low, high in found:  # the closest first, without overlap
            if not taken[low:high].any():
                taken[low:high] = True
        return found[0][1], -found[0][0], bool(taken.sum() >= share * len(words))


def _frequencies(files: DataFrame, *templates) -> tuple[dict[str, int], int]:
    """Documents that hold each template term, and how many documents there are."""
    vocabulary = {t for one in templates for group in one.values() for x in group for t in terms(x)}
    pairs = {tuple(t.split()) for t in vocabulary if " " in t}

    def run(batches):
        import pyarrow as pa
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                words = _TERM.findall(text.lower()) if text else ()
                counts.update(vocabulary.intersection(words))
                counts.update(f"{a} {b}" for a, b in pairs.intersection(zip(words, words[1:])))
        counts[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    # a row per template term at most
    rows = {r["term"]: r["n"] for r in files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return rows, rows.pop("", 0)


def _measure(matcher: Matcher, least: float, share: float, near: float):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = [matcher.measure(text, least, share, near) for text in batch.column("text").to_pylist()]
            name, score, whole = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(name, pa.string()),
                                              pa.array(score, pa.float64()), pa.array(whole, pa.bool_())],
                                             ["doc_id", "path", "licence", "cosine", "licence_file"])
    return run


def scan_licences(files: DataFrame, path: Column, least: float = 0.5, share: float = 0.5, templates=TEMPLATES, near: float = 0.75) -> DataFrame:
    """(doc_id, path, licence, cosine, licence_file, licence_source) per row of ``files`` (doc_id, text, ...).

    ``least`` is the cosine of a notice, ``share`` the part of a licence file's text
    that notices make up, ``near`` its cosine to a full licence text.  licence_source is ``own``, the directory inherited from,
    or null.
    """
    small_batches(files.sparkSession)
    texts = full_texts()
    matcher = Matcher(*_frequencies(files, templates, texts), templates, texts)
    given = files.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), "text")
    found = staged(given.mapInArrow(_measure(matcher, least, share, near),
                                    "doc_id long, path string, licence string, cosine double, licence_file boolean"))
    found = found.withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))
    own = (found.where(F.col("licence_file") & F.col("path").isNotNull()).groupBy("directory")
           .agg(F.min(F.struct((-F.col("cosine")).alias("order"), "licence")).alias("b"))
           .select(F.col("directory").alias("ancestor"), F.col("b.licence").alias("inherited")))
    parts = F.split("directory", "/")
    needed = found.where(F.col("licence").isNull() & F.col("path").isNotNull()).select("directory").distinct()
    ancestors = needed.select("directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select(
        "directory", "depth", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/").alias("ancestor"))
    nearest = (ancestors.join(own, "ancestor").groupBy("directory")
               .agg(F.max(F.struct("depth", "inherited", "ancestor")).alias("n")).select("directory", "n.inherited", "n.ancestor"))
    joined = found.join(nearest, "directory", "left")
    return joined.select("doc_id", "path", F.coalesce("licence", "inherited").alias("licence"), "cosine", "licence_file",
                         F.when(F.col("licence").isNotNull(), F.lit("own")).otherwise(F.col("ancestor")).alias("licence_source"))
