"""N-gram Jaccard join by vertical partitioning.

Every text becomes a set of hashed word shingles.  The global order of shingles
is cut into fragments, and what two sets share is counted fragment by fragment
and summed per pair.  Which pairs to count comes from the order as well:

1. Fragments (by hash) tell how many shingles of a set occur in another set at
   all.  A set with less than ``threshold`` of its shingles elsewhere has no
   partner and leaves.
2. The rest is ordered from rare to frequent.  Two linked sets share one of the
   first ``(1 - threshold) * n + 1`` shingles.
3. Pairs that meet there, and can still share enough behind that place, are
   verified: overlaps per fragment, summed.

Large groups of copies never make all their pairs.  Equal sets are one set from
the start.  For the others, each shingle first names one of its sets as leader,
leaders are verified against the members, and members that are now in one
component need no pair among them.  Only pairs across components remain and are
all verified, so no link that joins components is lost.

Null and empty texts have no shingles: size 0, linked with nothing, component of
their own id.  Repeated rows are equal sets.  Rows without an id get the
component of their class if it has ids, else null.  Shingles and sets are
identified by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, functions as F

from widemargin.llm.common import (as_bytes, byte_values, fragments_for, marked, mix, row_key, runs, small_batches,
                                   staged, word_hashes)
from widemargin.llm.components import components

#: Sets whose shingles a task holds back before it sends them, pre-aggregated, to the fragments.
_UNIT = 1_500_000
#: Another leader round pays while pairs across components are this multiple of the postings, and
#: this share of the pairs of the last round was linked.  Neither changes the result.
_SPREAD, _WORTH = 4, 0.1
_HASHES = "array<bigint>"


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted inside each text; shingles per text)."""
    words, counts = word_hashes(texts, byte_values(lower=True))
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        whole += words[j:len(words) - width + 1 + j] * factors[j]
    whole, at, sets = mix(whole), runs(counts), []
    for k, n in enumerate(counts):
        low = at[k]
        if n >= width:
            sets.append(np.unique(whole[low:low + n - width + 1]))
        elif n:
            short = (words[low:low + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(words[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else words[:0]), sizes


def set_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for the empty set."""
    at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    ends = runs(sizes)
    ids = mix(at[ends[1:]] - at[ends[:-1]] + sizes.astype(np.uint64))
    return np.where(sizes > 0, ids, np.uint64(0))


def _measure(width: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            values, sizes = shingle_sets(as_bytes(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes),
                 pa.array(set_ids(values, sizes).view(np.int64))], ["doc_id", "key", "n", "set_id"])
    return run


def _deal(width: int, fragments: int):
    """Sends the shingles of distinct sets to the fragments: (fragment, sets, counts, values, several, known, shared).

    A shingle of several sets of one unit goes out once, without its sets, so that a
    frequent shingle costs one entry per unit; ``shared`` already counts it for
    each of them.
    """
    def send(sets):
        import pyarrow as pa
        ids = np.fromiter(sets, np.uint64, len(sets))
        sizes = np.array([len(v) for v in sets.values()], np.int64)
        values = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(values, kind="stable")
        ranked, owner = values[order], owner[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        known = np.bincount(owner[~alone], minlength=len(ids))
        several = ranked[new & ~alone]
        values, owner = ranked[alone], owner[alone]

        def place(v):
            return (((v & np.uint64(0xFFFFFFFF)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int32)

        where = place(values)
        order = np.lexsort((owner, where))
        values, owner, where = (values[order] >> np.uint64(32)).astype(np.uint32), owner[order], where[order]
        among = np.argsort(place(several), kind="stable")
        several, at = (several[among] >> np.uint64(32)).astype(np.uint32), place(several)[among]
        home = int(ids[0] % np.uint64(fragments))
        hits, rows = known > 0, []
        # only fragments that something goes to: no more rows than entries
        used = np.unique(np.concatenate([where, at, np.array([home] * int(hits.any()), np.int32)]))
        cuts = zip(used.tolist(), *(np.searchsorted(x, used, side).tolist() for x in (where, at) for side in ("left", "right")))
        for f, low, high, start, end in cuts:
            own = owner[low:high]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
            mine = hits & (f == home)
            rows.append((f, ids[own[first]].tobytes(), np.diff(np.append(first, len(own))).astype(np.uint32).tobytes(),
                         values[low:high].tobytes(), several[start:end].tobytes(),
                         ids[mine].tobytes(), known[mine].astype(np.uint32).tobytes()))
        names = ["fragment", "sets", "counts", "vals", "several", "known", "shared"]
        types = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        unit, size = {}, 0
        for batch in batches:
            values, sizes = shingle_sets(as_bytes(batch.column("text")), width)
            at = runs(sizes)
            for k, i in enumerate(set_ids(values, sizes)):
                if sizes[k] and i not in unit:
                    unit[i] = values[at[k]:at[k + 1]].copy()
                    size += int(sizes[k])
            if size > _UNIT:
                yield send(unit)
                unit, size = {}, 0
        if unit:
            yield send(unit)
    return run


def _tally(group):
    """Shingles of one fragment that occur in several sets, counted per set: (set_id, shared)."""
    import pyarrow as pa

    def joined(name, kind):
        return np.concatenate([np.frombuffer(x, kind) for x in group.column(name).to_pylist()])

    sets, counts, vals = joined("sets", np.uint64), joined("counts", np.uint32), joined("vals", np.uint32)
    ids, inverse = np.unique(sets, return_inverse=True)
    pairs = (vals.astype(np.uint64) << np.uint64(32)) | np.repeat(inverse.astype(np.uint64), counts)
    pairs.sort()
    if len(pairs):
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    vals = (pairs >> np.uint64(32)).astype(np.uint32)
    same = vals[1:] == vals[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(vals) else np.zeros(0, bool)
    shared |= np.isin(vals, np.unique(joined("several", np.uint32)))
    n = np.bincount((pairs[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(ids))
    out = np.concatenate([ids[n > 0], joined("known", np.uint64)])
    n = np.concatenate([n[n > 0], joined("shared", np.uint32).astype(np.int64)])
    return pa.table({"set_id": pa.array(out.view(np.int64)), "shared": pa.array(n)})


def _sets(width: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            values, sizes = shingle_sets(as_bytes(batch.column("text")), width)
            lists = pa.ListArray.from_arrays(pa.array(runs(sizes).astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, sizes).view(np.int64)), lists], ["set_id", "vals"])
    return run


def _verified(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, ratio: Fraction) -> DataFrame:
    """(a, b, linked) for every pair: overlaps per fragment of the order, summed."""
    left = segments.select(F.col("set_id").alias("a"), "fragment", F.col("vals").alias("left_vals"))
    right = segments.select(F.col("set_id").alias("b"), "fragment", F.col("vals").alias("right_vals"))
    overlaps = (pairs.join(left, "a").join(right, ["b", "fragment"])
                .select("a", "b", F.size(F.array_intersect("left_vals", "right_vals")).alias("part"))
                .groupBy("a", "b").agg(F.sum("part").alias("both")))
    size_a = sizes.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"))
    size_b = sizes.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"))
    return overlaps.join(size_a, "a").join(size_b, "b").select(
        "a", "b", (ratio.denominator * F.col("both") >= ratio.numerator * (F.col("n_a") + F.col("n_b") - F.col("both")))
        .alias("linked"))


def _link(postings: DataFrame, segments: DataFrame, sizes: DataFrame, ratio: Fraction) -> DataFrame | None:
    """(node, root) of sets with a partner, from ``postings`` (set_id, n, val, rest).

    ``rest`` counts the shingles of the set behind ``val``.  If ``val`` is the first
    that two sets share, they share 1 + the smaller rest at most, and the smaller
    set of a linked pair has it among its first few: it is ``slim`` there.
    """
    rows, roots, tried, found, turn = postings.count(), None, None, 0, 0
    p, q = ratio.numerator, ratio.denominator
    fits = ((F.col("n_a") * q >= F.col("n_b") * p) & (F.col("n_b") * q >= F.col("n_a") * p)
            & ((p + q) * (1 + F.least("rest_a", "rest_b")) >= p * (F.col("n_a") + F.col("n_b"))))
    slim = (p + q) * (1 + F.col("rest")) >= 2 * p * F.col("n")
    postings = postings.withColumn("slim", slim.cast("int"))
    while True:
        placed = postings.withColumn("root", F.col("set_id")) if roots is None else postings.join(
            roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        k, s = F.col("k"), F.col("s")
        open_shingles = staged(
            placed.groupBy("val", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("slim").alias("s"))
            .groupBy("val").agg((F.sum(k) * F.sum(s) - F.sum(k * s)).alias("across")).where("across > 0"))
        across = open_shingles.agg(F.sum("across")).first()[0] or 0
        if not across:
            return roots
        placed = staged(placed.join(open_shingles.select("val"), "val"))
        # leaders first, while they link well and many pairs are left
        last = turn > 0 and (across <= _SPREAD * rows or found <= _WORTH * pairs_tried)
        small = placed.where("slim = 1").select("val", F.col("set_id").alias("a"), F.col("root").alias("root_a"),
                                                F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
        other = placed.select("val", F.col("set_id").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"),
                              F.col("rest").alias("rest_b"))
        if not last:
            # the set with the fewest rarer shingles is nearest to what the others have in common
            rank = F.col("n_a") - F.col("rest_a") if turn % 2 == 0 else F.lit(0)
            lead = F.struct(rank.alias("rank"), F.xxhash64(F.lit(turn), F.col("a")).alias("h"), "a", "root_a", "n_a", "rest_a")
            small = small.groupBy("val").agg(F.min(lead).alias("lead")).select("val", "lead.a", "lead.root_a", "lead.n_a", "lead.rest_a")
            first = F.col("a") != F.col("b")
        else:
            first = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))
        pairs = (small.join(other, "val").where(first & (F.col("root_a") != F.col("root_b")) & fits)
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        done = staged(_verified(pairs, segments, sizes, ratio))
        new = done.where("linked").select("a", "b")
        pairs_tried, found = done.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("linked").cast("int")), F.lit(0))).first()
        tried = done.select("a", "b") if tried is None else tried.union(done.select("a", "b"))
        if found:
            links = new if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)
            roots = staged(components(links))
        if last:
            return roots
        turn += 1


def _classes(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, key, n, set_id, class): class is 0 for rows without words."""
    spark, ratio = documents.sparkSession, Fraction(percent, 100)
    small_batches(spark)
    p, q = ratio.numerator, ratio.denominator
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key())
    rows = staged(docs.mapInArrow(_measure(width), "doc_id long, key long, n long, set_id long"))
    sizes = rows.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.min("key").alias("key"))
    entries = rows.agg(F.sum("n")).first()[0] or 0
    fragments = fragments_for(spark, entries)
    dealt = docs.mapInArrow(_deal(width, fragments), "fragment int, sets binary, counts binary, vals binary, several binary, "
                                                     "known binary, shared binary")
    shared = (dealt.repartition(fragments, "fragment").groupBy("fragment").applyInArrow(_tally, "set_id long, shared long")
              .groupBy("set_id").agg(F.sum("shared").alias("shared")))
    partners = staged(shared.join(sizes, "set_id").where(F.col("shared") * q >= F.col("n") * p).select("set_id", "n", "key"))
    likely, _ = marked(docs, partners, "key")
    chosen = likely.join(partners.select("key"), "key", "left_semi")
    sets = chosen.mapInArrow(_sets(width), f"set_id long, vals {_HASHES}").dropDuplicates(["set_id"])
    shingles = staged(sets.select("set_id", F.explode("vals").alias("val")))
    # the order: octave of the frequency, then hash; what only one set has comes first and meets nothing
    frequent = shingles.groupBy("val").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(
        "val", F.floor(F.log2("df")).cast("int").alias("octave"))
    common = shingles.join(frequent, "val")
    segments = staged(common.withColumn("fragment", F.col("octave") * 16 + F.shiftrightunsigned("val", 60).cast("int"))
                      .groupBy("set_id", "fragment").agg(F.collect_list("val").alias("vals")))
    ordered = segments.select("set_id", F.struct("fragment", F.array_sort("vals").alias("vals")).alias("part"))
    known = partners.select("set_id", "n")
    first = (ordered.groupBy("set_id").agg(F.sort_array(F.collect_list("part")).alias("parts")).join(known, "set_id")
             .select("set_id", "n", F.flatten(F.col("parts.vals")).alias("vals"))
             .withColumn("take", F.col("n") - F.ceil(F.col("n") * p / F.lit(q)) + 1 - (F.col("n") - F.size("vals")))
             .where("take > 0").select("set_id", "n", F.size("vals").alias("shared"),
                                       F.posexplode(F.slice("vals", F.lit(1), F.col("take").cast("int"))).alias("rank", "val"))
             .select("set_id", "n", "val", (F.col("shared") - F.col("rank") - 1).alias("rest")))
    roots = _link(staged(first), segments, known, ratio)
    classes = rows if roots is None else rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    classes = classes.withColumn("class", F.coalesce("root", "set_id") if roots is not None else F.col("set_id"))
    return classes.select("doc_id", "key", "n", "set_id", "class")


def jaccard_classes(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id): one row per row of ``documents`` (doc_id, text, ...).

    Two rows are linked when ``100 * intersection >= percent * union`` of their
    ``width``-word shingle sets; component_id is the smallest doc_id reachable by
    links, itself included.  Other columns are ignored.
    """
    classes = _classes(documents, width, percent)
    least = classes.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return classes.join(least, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "set_id")


def keep_one(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``documents`` without near copies: of each class the row with the smallest id stays.

    Of rows that repeat id and text one stays; rows without an id stay only where
    no row of the class has one.  Rows without words all stay.
    """
    classes = staged(_classes(documents, width, percent).where("n > 0"))
    best = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("best"))
    touched = staged(classes.join(best, "class").groupBy("key")
                     .agg(F.max(F.col("key") == F.col("best.key")).alias("_stays"), F.count(F.lit(1)).alias("k"))
                     .where("NOT _stays OR k > 1").select(F.col("key").alias("_key"), "_stays"))
    spread = documents.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    check, stay = marked(spread, touched, "_key")
    check = check.join(touched, "_key", "left")
    one = check.where("_stays").dropDuplicates(["_key"])
    rest = check.where("_stays IS NULL")
    return stay.select(documents.columns).union(rest.select(documents.columns)).union(one.select(documents.columns))
