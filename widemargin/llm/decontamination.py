"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items become word sequences, aligned with passages word by word: 2 for a match,
-1 for another word or a gap.  The best local score, over that of the item against
itself, is the score; from ``threshold`` on, and from ``least`` points on, the
document holds the item, copied or edited.

Seeds are pairs of words, neighbours or with one word between.  An alignment of S
points with m matches has at most 2m - S edits, so at least ceil(S/2) - 1 of its
matches are followed by the next one with no more than one edit between: a pair that
item and passage share.  Each such link begins at a place of its own in the item, so
all but ceil(S/2) - 1 - ``_HITS`` of the item's places, the rarest by the counts of
their pairs in all documents, meet ``_HITS`` links of every alignment that reaches S
points.  Passages with that many links near one diagonal are aligned, in a window that
no alignment of S points leaves; nothing over the threshold is missed.  Counts only
choose the places and never the result.

Words are runs of letters and digits, ASCII letters in lower case.  Items are
worked off in blocks of a bounded number of characters, each block
against all documents, and only a block is broadcast.

Null texts and items hold nothing, and empty tables give no rows.  Items that cannot
reach ``least`` points (under four words) are left out: so few words are no evidence.
Repeated rows and items are reported each; of equal scores of an item in one text the
first passage is reported.  Very long texts are aligned near their links only.  Other
columns of ``documents`` are passed through by ``keep_clean`` and not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from widemargin.llm.common import as_bytes, byte_values, mix, runs, small_batches, word_hashes

THRESHOLD, LEAST = 0.5, 8
#: Characters of items in one block; a block is what a task holds of the benchmark.
BLOCK_CHARS = 8_000_000
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256))
_MATCH, _OTHER, _CELLS, _POSTINGS, _HITS = 2, -1, 2_000_000, 2_000_000, 3
_ODD = np.uint64(0x9FB21C651E98DF25)


def _words(texts):
    return word_hashes(texts, byte_values(lower=True, word_bytes=_WORD))


def _pairs(words: np.ndarray, text: np.ndarray, known: np.ndarray | None = None):
    """(hash, text number, position) of each word with the next and with the one after that, inside a text."""
    hashes, places = [], []
    for gap in (1, 2):
        inside = text[:-gap] == text[gap:]
        if known is not None:
            inside &= known[:-gap] & known[gap:]
        place = np.flatnonzero(inside)
        hashes.append(mix(words[place] + words[place + gap] * _ODD))
        places.append(place)
    place = np.concatenate(places)
    return np.concatenate(hashes), text[place], place


def _lookup(keys: np.ndarray) -> np.ndarray:
    """Whether some key has these low bits; most hashes of a text fail this."""
    may = np.zeros(1 << min(max((8 * len(keys)).bit_length(), 16), 25), bool)
    may[(keys & np.uint64(len(may) - 1)).astype(np.int64)] = True
    return may


def _may(lookup: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return lookup[(keys & np.uint64(len(lookup) - 1)).astype(np.int64)]


class Block:
    """Items of one block: ids, words, the points and links each needs, and the seeds with their places."""

    def __init__(self, ids: list, texts: list[bytes], threshold: float = THRESHOLD, least: int = LEAST):
        if least < 3:
            raise ValueError("an alignment of less than 3 points need not hold a link")
        words, counts = _words(texts)
        enough = _MATCH * counts >= least
        words = words[np.repeat(enough, counts)]
        self.ids, counts = [i for i, e in zip(ids, enough) if e], counts[enough]
        self.words, self.length, self.at = words, counts, runs(counts)
        self.points = np.maximum(np.ceil(_MATCH * threshold * counts - 1e-9).astype(np.int64), least)
        self.links = (self.points + 1) // 2 - 1
        self.slack = np.maximum(_MATCH * counts - self.points, 0)  # edits of an alignment that reaches the points
        self.vocabulary, self.numbers = np.unique(words, return_inverse=True)
        self.known = _lookup(self.vocabulary)
        self._seeds(*_pairs(words, np.repeat(np.arange(len(counts)), counts)))

    def _seeds(self, grams, item, place):
        order = np.lexsort((place, grams))
        self.grams, self.item, self.place = grams[order], item[order], place[order]
        self.seeds, self.first = np.unique(self.grams, return_index=True)
        self.times = np.diff(np.append(self.first, len(self.grams)))
        self.may = _lookup(self.seeds)

    def keep_rare(self, index: np.ndarray, counts: np.ndarray) -> "Block":
        """Keeps the seeds of as few places of each item as meet every alignment, the rarest; counts of all documents."""
        times = np.zeros(len(self.seeds), np.int64)
        times[index] = counts
        rarity = np.zeros(len(self.words), np.int64)
        np.add.at(rarity, self.place, np.repeat(times, self.times))
        item = np.repeat(np.arange(len(self.ids)), self.length)
        begins = np.arange(len(item)) < self.at[item + 1] - 1  # an item's last word begins no pair
        order = np.lexsort((np.arange(len(item)), rarity, ~begins, item))
        rank = np.empty(len(item), np.int64)
        rank[order] = np.arange(len(item)) - self.at[item[order]]
        chosen = begins & (rank < (self.length - 1 - self.links + np.minimum(self.links, _HITS))[item])
        keep = chosen[self.place]
        self._seeds(self.grams[keep], self.item[keep], self.place[keep])
        return self

    def may_reach(self, item, words, low, high) -> np.ndarray:
        """Whether words[low:high] holds enough words of the item for its points, in any order."""
        number = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        number[self.vocabulary[number] != words] = len(self.vocabulary)
        met, reach = np.full(len(self.vocabulary) + 1, -1, np.int64), np.zeros(len(item), bool)
        for k, (i, a, b) in enumerate(zip(item.tolist(), low.tolist(), high.tolist())):
            met[number[a:b]] = k
            own = self.numbers[self.at[i]:self.at[i + 1]]
            reach[k] = _MATCH * np.count_nonzero(met[own] == k) >= self.points[i]
        return reach

    def hits(self, words, counts):
        """(text number, position, index of the seed), by position."""
        grams, text, place = _pairs(words, np.repeat(np.arange(len(counts)), counts), _may(self.known, words))
        near = np.flatnonzero(_may(self.may, grams)) if len(self.seeds) else np.zeros(0, np.int64)
        index = np.minimum(np.searchsorted(self.seeds, grams[near]), max(len(self.seeds) - 1, 0))
        true = self.seeds[index] == grams[near] if len(near) else np.zeros(0, bool)
        near, index = near[true], index[true]
        order = np.argsort(place[near], kind="stable")
        return text[near][order], place[near][order], index[order]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score over the item's own, end of that alignment in the passage) of each pair."""
    best, ends = np.zeros(len(items)), np.zeros(len(items), np.int64)
    order = np.argsort([len(p) for p in passages], kind="stable")
    low = 0
    while low < len(order):
        high, wide = low, 0
        while high < len(order) and (high == low or (high - low + 1) * max(wide, len(passages[order[high]])) <= _CELLS // 64):
            wide = max(wide, len(passages[order[high]]))
            high += 1
        block = order[low:high]
        text = np.zeros((len(block), wide), np.uint64)
        item = np.ones((len(block), max(len(items[k]) for k in block)), np.uint64)
        for row, k in enumerate(block):
            text[row, :len(passages[k])] = passages[k]
            item[row, :len(items[k])] = items[k]
        lengths = np.array([len(items[k]) for k in block])
        above = np.zeros((len(block), wide + 1), np.int32)
        slope = np.arange(wide + 1, dtype=np.int32)
        top, end = np.zeros(len(block), np.int32), np.zeros(len(block), np.int64)
        for i in range(item.shape[1]):
            pair = np.where(text == item[:, i:i + 1], np.int32(_MATCH), np.int32(_OTHER))
            row = np.zeros_like(above)
            np.maximum(above[:, :-1] + pair, above[:, 1:] - 1, out=row[:, 1:])
            np.maximum(row, 0, out=row)
            # gaps in the item: the best cell to the left, less its distance
            row = np.maximum.accumulate(row + slope, axis=1) - slope
            row[i >= lengths] = 0
            here = row.max(1)
            end = np.where(here > top, row.argmax(1), end)
            top = np.maximum(top, here)
            above = row
        best[block], ends[block] = top / (_MATCH * lengths), end
        low = high
    return best, ends


def matches(texts: list[bytes | None], block: Block) -> list[tuple]:
    """(text number, item number, score, links met, first word, end) of every item that a text holds."""
    words, counts = _words(texts)
    at = runs(counts)
    text, place, index = block.hits(words, counts)
    if not len(text):
        return []
    times, found = block.times[index], {}
    # postings of whole texts at a time, so that a frequent seed doesn't fill the memory
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1
    upto, low = runs(times)[ends], 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _POSTINGS, "right")))
        part = slice(int(ends[low - 1]) if low else 0, int(ends[high - 1]))
        _aligned(found, words, at, text[part], place[part], index[part], block)
        low = high
    return [(*k, *v) for k, v in sorted(found.items())]


def _aligned(found: dict[tuple, tuple], words, at, text, place, index, block: Block):
    """Adds to ``found`` what the seeds met in some texts lead to."""
    times = block.times[index]
    row = np.repeat(np.arange(len(text)), times)
    within = np.arange(len(row)) - np.repeat(runs(times)[:-1], times)
    posting = block.first[index][row] + within
    item, text = block.item[posting], text[row]
    begin = place[row] - (block.place[posting] - block.at[item])  # where the item would begin
    order = np.lexsort((block.place[posting], begin, item, text))
    links = np.stack([text, item, begin, block.place[posting]])[:, order]
    links = links[:, np.append(True, (links[:, 1:] != links[:, :-1]).any(0))]  # both pairs of a place may meet
    text, item, begin = links[:3]
    # links of one alignment begin no further apart than its edits
    hits = np.minimum(block.links[item], _HITS)
    near = np.zeros(len(item), bool)
    for n in range(1, _HITS + 1):
        of = np.flatnonzero(hits == n)
        of = of[of + n <= len(item)]
        to = of + n - 1
        of = of[(text[of] == text[to]) & (item[of] == item[to]) & (begin[to] - begin[of] <= block.slack[item[of]])]
        for j in range(n):
            near[of + j] = True
    text, item, begin = text[near], item[near], begin[near]
    if not len(item):
        return
    slack = block.slack[item]
    new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    low = np.maximum(begin[first] - slack[first], at[text[first]])
    high = np.minimum(begin[last] + block.length[item[first]] + slack[first], at[text[first] + 1])
    reach = block.may_reach(item[first], words, low, high)
    first, last, low, high = first[reach], last[reach], low[reach], high[reach]
    scores, ends = align([block.words[block.at[i]:block.at[i + 1]] for i in item[first]], [words[a:b] for a, b in zip(low, high)])
    own = item[first]
    for k in np.flatnonzero(scores * _MATCH * block.length[own] >= block.points[own] - 1e-6):
        key = (int(text[first[k]]), int(own[k]))
        value = (float(scores[k]), int(last[k] - first[k] + 1), int(low[k] - at[key[0]]), int(low[k] + ends[k] - at[key[0]]))
        if key not in found or value[0] > found[key][0]:
            found[key] = value


def _counted(documents: DataFrame, block: Block) -> Block:
    """The block with its rare seeds, by a count of every seed in all documents."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(len(block.seeds), np.int64)
        for batch in batches:
            _, _, index = block.hits(*_words(as_bytes(batch.column("text"))))
            total += np.bincount(index, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["seed", "n"])

    # one number per seed of a block
    found = documents.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    return block.keep_rare(found["seed"].to_numpy(), found["n"].to_numpy())


def blocks(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, chars: int = BLOCK_CHARS):
    """Blocks of items with their seeds, one after the other."""
    small_batches(documents.sparkSession)
    items = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    for number in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number).orderBy("item_id", "text").collect()
        block = Block([r["item_id"] for r in own], [r["text"].encode() for r in own], threshold, least)
        if block.ids:
            yield _counted(documents, block)


def contaminated(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: int = LEAST,
                 chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, score, seeds, first_word, end_word): each item that a row of ``documents`` holds."""
    schema = "doc_id long, item_id long, score double, seeds long, first_word long, end_word long"
    docs, out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None

    def with_block(block):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], block.ids[i], *rest) for t, i, *rest in matches(as_bytes(batch.column("text")), block)]
                columns = list(zip(*rows)) if rows else [()] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 [x.split()[0] for x in schema.split(", ")])
        return run

    for block in blocks(documents, items, threshold, least, chars):
        part = docs.mapInArrow(with_block(block), schema)
        out = part if out is None else out.union(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: int = LEAST,
               chars: int = BLOCK_CHARS) -> DataFrame:
    """``documents`` without the rows that hold a test item."""
    def with_block(block):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches(as_bytes(batch.column("text")), block)]] = False
                yield batch.filter(pa.array(keep))
        return run

    out = documents
    for block in blocks(documents, items, threshold, least, chars):
        out = out.mapInArrow(with_block(block), documents.schema)
    return out
