"""Removal of repeated word windows, found by recompression.

A text is a string of word symbols.  Rounds rename it: runs of one word become
one symbol first; then, round after round, every symbol falls to a left or right
class by its hash, and each neighbouring (left, right) pair becomes one symbol.
A name is the hash of what it replaces, so all tasks name alike and equal
substrings get equal symbols, but for a few near their borders.  Symbols over
``grow`` words are left alone, which keeps those borders narrow.

For each symbol the span of words that its making looked at is kept.  A window
that holds the whole span of a symbol that occurs nowhere else can't occur
elsewhere either, so symbols seen once rule out most windows.  The windows that
remain are verified: those whose words, as hash, start in two places are repeats,
and the words they cover go.

Both questions (which symbols, which windows occur twice) go through the same
exchange: entries are dealt to fragments by hash, and what occurs several times
in one unit of a task is sent once, so a passage in a third of all texts costs an
entry per unit, not per text.

Null texts have no words.  Repeated rows count as rows of their own: each repeats
the other.  Equality of windows means equality of 64 hash bits and, as
fragments are chosen by other bits, of the fragment.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from widemargin.llm.common import (as_bytes, byte_values, fragments_for, mix, powers, row_key, runs,
                                   small_batches, word_hashes)

#: Entries that a task holds before it sends them.
_UNIT = 1_000_000
_ROUNDS = 6
#: Symbols of more words join no pair.
_GROW = 4
_DEALT = "fragment int, keys binary, counts binary, places binary, vals binary, several binary"


def recompress(words: np.ndarray, counts: np.ndarray, rounds: int = _ROUNDS, grow: int = _GROW):
    """(symbols, first word, end, low, high) of the texts; [low, high) is the span of words that decided on the symbol.

    Spans that reach over an end of the text are wider than any text.
    """
    n = len(words)
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    far = np.int64(1) << 40
    at = np.arange(n, dtype=np.int64)
    if not n:
        return words, at, at, at, at
    # runs of one word: the neighbours decide where a run ends
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    length = end - first
    sym, text = words[first], text[first]
    many = length > 1
    sym[many] = mix(sym[many] * np.uint64(0xA24BAED4963EE407) + length[many].astype(np.uint64))
    opens = np.ones(len(text), bool)
    opens[1:] = text[1:] != text[:-1]
    closes = np.append(opens[1:], True)
    low, high = first - 1 - opens * far, end + 1 + closes * far
    for k in range(rounds):
        right = (mix(sym + np.uint64(k + 1) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(63)).astype(bool)
        active = end - first <= grow
        left = active & ~right
        right &= active
        beside = np.append(text[1:] == text[:-1], False)
        after = np.append(right[1:], False) & beside
        joined = np.flatnonzero(left & after)
        # an active symbol has looked at its neighbour on the side of its class
        wide = np.where(left, np.where(beside, np.append(high[1:], 0), far), high)
        back = np.append(False, beside[:-1])
        slim = np.where(right, np.where(back, np.append(0, low[:-1]), -far), low)
        wide, slim = np.maximum(high, wide), np.minimum(low, slim)
        sym[joined] = mix(sym[joined] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(sym[joined + 1]) + np.uint64(k))
        wide[joined] = np.maximum(wide[joined], wide[joined + 1])
        slim[joined] = np.minimum(slim[joined], slim[joined + 1])
        end[joined] = end[joined + 1]
        stay = np.ones(len(sym), bool)
        stay[joined + 1] = False
        sym, text, first, end, low, high = (x[stay] for x in (sym, text, first, end, slim, wide))
    return sym, first, end, low, high


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window that starts at each word; meaningless where the text ends before it does."""
    n = len(words)
    sums = np.zeros(n + width + 1, np.uint64)
    np.cumsum(words * powers(n + 1)[:n], out=sums[1:n + 1])
    sums[n + 1:] = sums[n]
    return mix((sums[width:width + n] - sums[:n]) * powers(n + 1, True)[:n])


def _send(owner, place, vals, keys, fragments):
    """Rows for the fragments, and the places of what occurs several times among these entries."""
    import pyarrow as pa
    order = np.argsort(vals, kind="stable")
    ranked = vals[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    known = np.sort(order[~alone])
    several, order = ranked[new & ~alone], np.sort(order[alone])

    def fragment(v):
        return ((mix(v ^ np.uint64(0x27BB2EE687B0B0FD)) >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)

    def grouped(owner, place):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        return [keys[owner[first]].tobytes(), np.diff(np.append(first, len(owner))).astype(np.uint32).tobytes(),
                place.astype(np.uint32).tobytes()]

    where, at = fragment(vals[order]), fragment(several)
    order, where = order[np.argsort(where, kind="stable")], np.sort(where)
    several, at = several[np.argsort(at, kind="stable")], np.sort(at)
    # only fragments that something goes to: no more rows than entries
    used, rows = np.unique(np.concatenate([where, at])), []
    cuts = zip(used.tolist(), *(np.searchsorted(x, used, side).tolist() for x in (where, at) for side in ("left", "right")))
    for f, low, high, start, end in cuts:
        own = order[low:high]
        rows.append([f, *grouped(owner[own], place[own]), vals[own].tobytes(), several[start:end].tobytes()])
    if len(known):  # already an answer: passes through one of the fragments
        rows.append([int(keys[owner[known[0]]] % fragments), *grouped(owner[known], place[known]), b"", b""])
    types = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      [x.split()[0] for x in _DEALT.split(", ")])


def _deal(entries, fragments):
    """mapInArrow function: ``entries`` gives (text number, place, value) of a batch."""
    def run(batches):
        held, size, base = [], 0, 0

        def flush():
            owner, place, vals, keys = (np.concatenate(x) for x in zip(*held))
            return _send(owner, place, vals, keys, fragments)

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            owner, place, vals = entries(batch)
            held.append((owner + base, place, vals, keys))
            base, size = base + len(keys), size + len(vals)
            if size > _UNIT:
                yield flush()
                held, size, base = [], 0, 0
        if size:
            yield flush()
    return run


def _twice(group):
    """Places of one fragment whose value occurs elsewhere too: (key, places)."""
    import pyarrow as pa

    def joined(name, kind, keep):
        return np.concatenate([np.frombuffer(x, kind) for x, k in zip(group.column(name).to_pylist(), keep) if k] or [np.zeros(0, kind)])

    sizes = np.array([len(x) // 8 for x in group.column("vals").to_pylist()])
    asked = sizes > 0
    n_places = np.array([len(x) // 4 for x in group.column("places").to_pylist()])
    done = (n_places > 0) & ~asked
    keys, counts = joined("keys", np.int64, asked), joined("counts", np.uint32, asked)
    places, vals = joined("places", np.uint32, asked), joined("vals", np.uint64, asked)
    order = np.argsort(vals, kind="stable")
    ranked = vals[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(vals), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    several = np.unique(joined("several", np.uint64, np.ones(len(asked), bool)))
    if len(several):
        at = np.minimum(np.searchsorted(several, vals), len(several) - 1)
        repeated |= several[at] == vals
    owner = np.repeat(np.arange(len(keys)), counts)[repeated]
    n = np.bincount(owner, minlength=len(keys))
    out_keys = np.concatenate([keys[n > 0], joined("keys", np.int64, done)])
    out_n = np.concatenate([n[n > 0], joined("counts", np.uint32, done)])
    out = np.concatenate([places[repeated], joined("places", np.uint32, done)])
    at = runs(out_n)
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(out_keys), [
        None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
    return pa.table({"key": pa.array(out_keys), "places": blobs.cast(pa.binary())})


def _repeated(dealt: DataFrame, fragments: int) -> DataFrame:
    """(key, places array<binary>) of the rows that have repeated entries."""
    return (dealt.repartition(fragments, "fragment").groupBy("fragment").applyInArrow(_twice, "key long, places binary")
            .groupBy("key").agg(F.collect_list("places").alias("places")))


def _places(lists) -> list[np.ndarray]:
    return [np.unique(np.frombuffer(b"".join(x), np.uint32)).astype(np.int64) if x else np.zeros(0, np.int64) for x in lists]


def _symbols(batch):
    words, counts = word_hashes(as_bytes(batch.column("text")), byte_values(lower=False))
    symbols, first, _, _, _ = recompress(words, counts)
    at = runs(counts)
    owner = np.searchsorted(at, first, side="right") - 1
    # an entry's place is the number of its symbol in the text
    begin = np.searchsorted(owner, np.arange(len(counts)))
    return owner, np.arange(len(owner)) - begin[owner], symbols


def candidate_windows(texts, shared, width):
    """(text number, first word, hash) of the windows that no symbol seen once rules out."""
    words, counts = word_hashes(texts, byte_values(lower=False))
    _, first, _, low, high = recompress(words, counts)
    at = runs(counts)
    owner = np.searchsorted(at, first, side="right") - 1
    begin = np.searchsorted(owner, np.arange(len(counts)))
    once = np.ones(len(first), bool)
    for k, numbers in enumerate(shared):
        once[begin[k] + numbers] = False
    once &= high - low <= width
    # such a symbol rules out the windows that start in [high - width, low]
    change = np.zeros(len(words) + 1, np.int64)
    text_low = at[owner[once]]
    np.add.at(change, np.maximum(high[once] - width, text_low), 1)
    np.add.at(change, low[once] + 1, -1)
    open_ = np.cumsum(change[:-1]) == 0
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(open_ & (np.arange(len(words)) + width <= at[1:][text]))
    return text[start], start - at[text[start]], window_hashes(words, counts, width)[start]


def _windows(width):
    def entries(batch):
        return candidate_windows(as_bytes(batch.column("text")), _places(batch.column("places").to_pylist()), width)
    return entries


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def _cut(width):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for text, starts in zip(as_bytes(batch.column("text")), _places(batch.column("places").to_pylist())):
                words = (text or b"").split()  # bytes split at the fixed separators alone
                gone = covered(starts, len(words), width)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if len(starts) else b" ".join(words)
                rows.append((len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            n, removed, kept, digest = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
    return run


def remove_repeats(documents: DataFrame, width: int = 35, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, if ``texts``, kept_text) for every row of ``documents``.

    ``documents`` has doc_id and text; other columns are ignored.  A window is
    ``width`` consecutive words of one text.  All words under a window whose words
    also start elsewhere are removed, judged on the texts as they came.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key())
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # a symbol every 3 words and a candidate window every 4, or fewer
    fragments = fragments_for(spark, chars // 18)
    seen = _repeated(docs.mapInArrow(_deal(_symbols, fragments), _DEALT), fragments)
    # both joins and the texts use one partitioning, so the texts are shuffled once
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = docs.repartition(parts, "key")
    open_texts = placed.join(seen, "key", "left")
    again = _repeated(open_texts.mapInArrow(_deal(_windows(width), fragments), _DEALT), fragments)
    result = placed.join(again, "key", "left").mapInArrow(
        _cut(width), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return result if texts else result.drop("kept_text")
