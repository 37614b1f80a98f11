"""Operators on embeddings against brute force: neighbours, hard negatives, whitening."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from widemargin.llm import hard_negatives as H, neighbours, whitening
from widemargin.llm.vectors import first_per_group, panels

SCHEMA = "vec_id long, embedding array<float>, label int, v string, slot long, list int, query long, x string, score double, anchor long"
EXTRA = (None,) * 7


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, *EXTRA) for i, v, lab in rows], SCHEMA)


def nasty(rng, n=700, width=12, kinds=4):
    """Clusters, one vector a third of all rows, negative ids, and the odd rows."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(kinds)]
    hot = [0.25] * width
    rows = []
    for i in range(n):
        c = rng.randrange(kinds)
        v = hot if i % 3 == 0 else [x + rng.gauss(0, 0.4) for x in centres[c]]
        rows.append((i - 50, [float(np.float32(x)) for x in v], (i * 7) % kinds))
    rows += [rows[10], rows[50], rows[51], (2000, None, 1), (2050, [None] * width, 1), (2100, [float("nan")] * width, 0),
             (2150, [1.0] * (width - 1) + [float("inf")], 0), (2200, [0.0] * width, 2), (2250, [0.5] * (width - 4), 1), (2300, [], 1),
             (None, [0.1] * width, 1), (2350, [0.2] * width, None), (2400, [-1.0] * width, 3)]
    return rows


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def filled(v, width, fill=0.0):
    return np.array(list(v) + [fill] * (width - len(v)), float)


@pytest.fixture(scope="module")
def rows():
    return nasty(random.Random(3))


@pytest.fixture(scope="module")
def table(spark, rows):
    return vectors(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return vectors(spark, [])


# ---------------------------------------------------------------- helpers
def test_first_per_group():
    rng = np.random.default_rng(0)
    g, a, b = rng.integers(0, 5, 200), rng.integers(0, 4, 200), rng.integers(0, 9, 200)
    got = sorted((g[i], a[i], b[i]) for i in first_per_group(g, a, b, k=3))
    want = [t for k in range(5) for t in sorted(zip(a[g == k], b[g == k]))[:3]]
    assert [t[1:] for t in got] == want
    assert len(first_per_group(g[:0], a[:0], k=3)) == 0


def test_panels_are_bounded(spark):
    numbered = spark.createDataFrame([(i << 33 | j,) for i in range(7) for j in range(143 * (i % 3))], "a long")
    found = panels(numbered, "a", 100)
    total = numbered.count()
    sizes = [numbered.where((F.col("a") >= low) & (F.col("a") < high)).count() for low, high in found]
    assert sum(sizes) == total and max(sizes) <= 100 and len(found) <= 2 * -(-total // 100)


# ---------------------------------------------------------------- neighbours
def search_all(rows, every, k):
    width = max((len(v) for i, v, _ in rows if i is not None and fine(v)), default=0)
    own = [(i, filled(v, width)) for i, v, _ in rows if i is not None and fine(v) and any(v)]
    out = {}
    for i, q in own:
        if i % every == 0:
            near = sorted((math.sqrt(float(((q - v) ** 2).sum())), j) for j, v in own if j != i)[:k]
            out.setdefault(i, near)
    return out, Counter(i for i, _ in own if i % every == 0)


def recall(got, want):
    """Share of the neighbours found; every row found has its exact distance and the right place."""
    met = total = 0
    found = defaultdict(list)
    for r in got:
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, near in want.items():
        limit = near[-1][0] if near else 0
        mine = sorted(found.get(q, []))
        met += sum(s <= limit + 1e-9 for _, _, s in mine[:len(near)])
        total += len(near)
    return met / max(1, total)


def test_neighbours(table, rows, none):
    want, asked = search_all(rows, 100, 10)
    got = neighbours.nearest_neighbours(table).collect()
    assert Counter(r["query_id"] for r in got) == {q: n * len(want[q]) for q, n in asked.items()}
    vectors_of = defaultdict(list)
    width = max(len(v) for _, v, _ in rows if fine(v))
    for i, v, _ in rows:
        if fine(v):
            vectors_of[i].append(filled(v, width))
    by_query = defaultdict(list)
    for r in got:
        assert r["query_id"] != r["vec_id"]
        assert r["score"] in {float(np.sqrt(((a - b) ** 2).sum())) for a in vectors_of[r["query_id"]] for b in vectors_of[r["vec_id"]]}
        by_query[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    for found in by_query.values():
        places = sorted(found)
        assert [(s, i) for _, s, i in places] == sorted((s, i) for _, s, i in places)
    assert recall([r for r in got], want) >= 0.9
    assert neighbours.nearest_neighbours(none).count() == 0


def test_neighbours_of_a_hot_vector_are_the_smallest_ids(spark):
    """A third of all rows are one vector, over several slices of its list: ties go to the smaller id."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.5, 0.0] if i % 3 == 0 else rng.normal(0, 3, 4).round(3).tolist(), 0) for i in range(9000)]
    got = neighbours.nearest_neighbours(vectors(spark, rows).repartition(6)).where("query_id in (0, 300, 600)").collect()
    want = {q: [i for i in range(0, 36, 3) if i != q][:10] for q in (0, 300, 600)}
    assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
    assert {r["score"] for r in got} == {0.0}


def test_neighbours_few_rows(spark):
    """Fewer candidates than k: all of them are found, also those outside the probed lists."""
    rows = [(100 * i, [float(i), 1.0], 0) for i in range(6)] + [(7, [50.0, 50.0], 0)]
    index = neighbours.fit_index(neighbours.participants(vectors(spark, rows)))
    index.probes = 1
    got = neighbours.search(index, index.rows.where("vec_id % 100 = 0")).collect()
    assert Counter(r["query_id"] for r in got) == {100 * i: 6 for i in range(6)}


def test_recall_on_embeddings(spark, sf_dir):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.nearest_neighbours(df).toPandas()
    data = df.orderBy("vec_id").toPandas()
    x, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    met = 0
    for q, found in got.groupby("query_id"):
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        met += len(set(ids[np.lexsort((ids, far))[:10]]) & set(found["vec_id"]))
    assert met >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_adaptive_scan_keeps_what_is_near():
    """Of the pairs within the limit the tests lose next to none; most of the far pairs go before the last block."""
    rng = np.random.default_rng(2)
    width = 64
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    rows = np.vstack([rng.standard_normal((300, width)), rng.standard_normal((300, width)) * 0.1])
    queries = rng.standard_normal((20, width)) * 0.1
    far = np.sqrt(((queries[:, None] - rows[None]) ** 2).sum(2))
    limits = np.sort(far, axis=1)[:, 100]
    blocks = [(k, k + 16) for k in range(0, width, 16)]
    q, j, d = neighbours.adaptive_scan(queries @ rotation, rows @ rotation, limits ** 2, blocks, width)
    near = {(a, b) for a, b in zip(*np.nonzero(far <= limits[:, None]))}
    kept = set(zip(q.tolist(), j.tolist()))
    assert len(near - kept) <= 0.01 * len(near)
    assert kept <= {(a, b) for a, b in zip(*np.nonzero(far <= limits[:, None] * (1 + 1e-6)))}
    early, _, _ = neighbours.adaptive_scan(queries @ rotation, rows @ rotation, limits ** 2, blocks[:1], width)
    assert len(early) < 0.6 * far.size


# ---------------------------------------------------------------- hard negatives
def mined(rows, every=50, scale=256, shift=True):
    width = max(len(v) for _, v, _ in rows if fine(v))
    own = []
    for i, v, lab in rows:
        if i is not None and lab is not None and fine(v):
            lab = int(math.fmod(lab + 1, 10)) if shift and i % 7 == 0 else lab
            own.append((i, lab, np.floor(filled(v, width) * scale)))
    out = Counter()
    for i, lab, q in own:
        if i % every:
            continue
        others = sorted((-int(q @ v), j, other) for j, other, v in own if j != i)
        for s, p, _ in [o for o in others if o[2] == lab][:5]:
            ok = [o for o in others if o[2] != lab and 50 * -s <= 100 * -o[0] <= 95 * -s][:3]
            for rank, (t, j, _) in enumerate(ok):
                out[i, p, rank + 1, j, -s, -t] += 1
    return out


def mine(df, **options):
    label = F.col("label").cast("long")
    rows = H.labelled(df, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    got = H.hard_negatives(rows, F.col("vec_id") % 50 == 0, **options)
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("panel", [4, 2048])
def test_hard_negatives(table, rows, none, panel):
    want = mined(rows)
    assert sum(want.values()) > 30
    assert mine(table, panel_size=panel) == want
    assert sum(mine(none).values()) == 0


def test_hard_negatives_ties(spark):
    """Few distinct vectors, so that nearly all scores tie, zero and negative ones among them."""
    rng = random.Random(8)
    pool = [[1.0, 0.0], [0.75, 0.0], [0.5, 0.5], [0.0, 1.0], [0.0, 0.0], [-1.0, 0.0], [0.9, 0.1]]
    rows = [(i, rng.choice(pool), rng.randrange(3)) for i in range(400)]
    rows += [rows[3], rows[3], rows[100]]
    assert mine(vectors(spark, rows).repartition(7), panel_size=3) == mined(rows)


def test_packed_keys_sort_as_their_parts():
    rng = random.Random(1)
    parts = [(rng.randrange(3), rng.choice([-2**52, -3, 0, 5, 2**52]), rng.randrange(2), rng.choice([-2**63, -7, 0, 9, 2**63 - 1])) for _ in range(300)]
    want = sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))
    assert [H.unpack(k) for k in sorted(H.pack(*p) for p in parts)] == want


def test_stream_holds_open_windows_only():
    """A stream far longer than its windows is read once, and ends them by score or by number."""
    def keys():
        for p in range(3):
            yield H.pack(1, 1000 - p, 0, p), 50
        for n in range(100_000):
            yield H.pack(1, 990 - n // 200, 1, n), 50
    got = list(H.stream(keys(), 5, 3, 50, 95))
    assert Counter(r[1] for r in got) == {0: 3, 1: 3, 2: 3}
    assert [r[3:] for r in got if r[1] == 0] == [(n, 1000, 950) for n in range(8000, 8003)]


# ---------------------------------------------------------------- whitening
def integers(rows, width):
    return [(i, np.array([int(math.floor(float(c) * 64)) for c in v] + [0] * (width - len(v)), dtype=object) + 1_000_000)
            for i, v, _ in rows if fine(v)]


def long_or_none(x):
    return x if x < 1 << 63 else None


def check_whitening(df, rows, components=16):
    got = whitening.whiten(df, components).collect()
    width = max(len(v) for _, v, _ in rows if fine(v))
    own = integers(rows, width)
    fit = sorted({tuple(x) for _, x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = (np.array(fit, dtype=object) * n - np.array(sums, dtype=object)).astype(float) / n
    cov = centred.T @ centred / n
    value = np.linalg.eigvalsh(cov)[::-1]
    k = min(width, components)
    want = Counter((i, c + 1, n, long_or_none(sum((n * a - s) ** 2 for a, s in zip(x, sums)))) for i, x in own for c in range(k))
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == want
    for r in got:
        assert r["explained"] == pytest.approx(max(0, value[r["component"] - 1]) / value.sum(), rel=1e-8, abs=1e-12)
        assert r["identity_error"] <= 1e-9
    return got, own, n, sums, cov


def test_whitening(table, rows, none):
    got, own, n, sums, cov = check_whitening(table, rows)
    # whitened distances equal distances by the inverse covariance, whatever the signs: all components are there
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r["whitened"]
    inverse = np.linalg.inv(cov)
    some = [(i, x) for i, x in own if i is not None and i % 37 == 0]
    for i, x in some:
        c = (x * n - np.array(sums, dtype=object)).astype(float) / n
        assert sum(v * v for v in by_id[i].values()) == pytest.approx(c @ inverse @ c, rel=1e-9)
    assert whitening.whiten(none).count() == 0


def test_whitening_of_few_vectors(spark):
    """Less variance than dimensions: components without any have no coordinate."""
    rows = [(1, [0.0, 1.0, 2.0], 0), (2, [1.0, 1.0, 2.0], 0), (3, [0.0, 1.0, 2.0], 0)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {(r["component"], r["whitened"] is None, r["n"]) for r in got} == {(1, False, 2), (2, True, 2), (3, True, 2)}
    assert {r["deviation"] for r in got} == {64 * 64}
    assert {round(abs(r["whitened"]), 12) for r in got if r["component"] == 1} == {1.0}
    assert [r["explained"] for r in got if r["vec_id"] == 1 and r["component"] == 1] == [pytest.approx(1.0)]
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.5], 0), (None, [0.5, 0.5], 0)])).collect()
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same) == \
        Counter((i, c, 1, 0, None, None, None) for i in (1, None) for c in (1, 2))
    assert whitening.whiten(vectors(spark, [(1, [], 0), (2, None, 0)])).count() == 0


def test_whitening_of_huge_entries(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 10 ** (2 * j)))) for j in range(6)], 0) for i in range(40)] + [(99, [3e38] * 6, 0)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 41 * 6 and {r["deviation"] for r in got if r["vec_id"] == 99} == {None}
    check_whitening(vectors(spark, rows[:-1]).where("vec_id < 30"), rows[:30])


@pytest.mark.parametrize("spread", [1e-2, 1e-8, 1e-11, 0.0])
def test_eigenvectors_of_clusters(spread):
    """Clustered eigenvalues: residuals and orthogonality at the level of double precision."""
    rng = np.random.default_rng(6)
    size = 40
    basis = np.linalg.qr(rng.standard_normal((size, size)))[0].astype(np.longdouble)
    for _ in range(2):
        basis = basis @ (1.5 * np.eye(size) - 0.5 * basis.T @ basis)
    value = np.concatenate([3 + spread * np.arange(15), 1 + spread * np.arange(15), np.linspace(0.1, 0.9, 10)]).astype(np.longdouble)
    a = (basis * value) @ basis.T
    found, x = whitening.eigenvectors(a)
    assert np.abs(found - np.sort(value.astype(float))[::-1]).max() < 1e-15 * 30
    assert np.abs(a @ x.astype(np.longdouble) - x.astype(np.longdouble) * found).max() < 1e-14
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-14
    if spread >= 1e-8:  # single vectors are determined, to the precision of double entries
        order = np.argsort(-value.astype(float))
        assert np.abs(np.abs(np.einsum("ij,ij->j", x, basis[:, order].astype(float))) - 1).max() < 1e-13
        off = x - basis[:, order].astype(float) * np.sign(np.einsum("ij,ij->j", x, basis[:, order].astype(float)))
        assert np.abs(off).max() < (1e-14 if spread == 1e-2 else 1e-9)
