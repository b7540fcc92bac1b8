"""Near-duplicate vectors and nearest neighbours against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.llm import onebit, pivots
from tenure.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def cloud():
    """Random vectors, groups of near copies around some of them, and exact copies."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    near = [base[i] + rng.normal(size=24) * s for i in range(30) for s in (0.05, 0.2, 0.35)]
    hot = [base[0] + rng.normal(size=24) * 0.02 for _ in range(60)]
    points = np.array([*base, *near, *hot, *base[:10], *base[:10]], np.float32)
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(points)]


ODD = [
    (900, None),
    (901, [0.0] * 24),
    (902, [float("nan")] + [1.0] * 23),
    (903, [float("inf")] + [1.0] * 23),
    (904, [None] + [1.0] * 23),
    (905, [1.0, 2.0]),
    (906, []),
    (None, [1.0] * 24),
]


def linked(rows):
    usable = [(i, np.array(v, float)) for i, v in rows]
    unit = np.array([v / np.linalg.norm(v) for _, v in usable])
    return [i for i, _ in usable], unit @ unit.T >= 0.9


def test_links_and_components(spark, cloud, rows):
    got = pivots.near_duplicates(table(spark, cloud + ODD), tile=16)
    ids, link = linked(cloud)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(link), strict=True):
            low = min(root[ids[a]], root[ids[b]])
            changed |= root[ids[a]] != low or root[ids[b]] != low
            root[ids[a]] = root[ids[b]] = low
    found = {r.vec_id: r for r in got.collect()}
    assert len(found) == len(cloud) + len(ODD)
    counts = link.sum(axis=1) - 1
    recall = sum(found[i].n_links for i in ids) / counts.sum()
    assert 0.99 <= recall <= 1
    assert all(found[i].n_links <= c for i, c in zip(ids, counts, strict=True))
    same = sum(found[i].component_id == root[i] for i in ids)
    assert same >= 0.99 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    for i, _ in ODD:
        assert found[i].n_links == 0 and found[i].component_id == i and found[i].kept


@pytest.mark.parametrize("cosine", [0.9996, 0.99, 0.92])
def test_links_of_a_large_dense_group(spark, cosine):
    # A third of the vectors are near copies of one, and so are a third of the candidates
    # for pivots.
    rng = np.random.default_rng(5)
    center = rng.normal(size=32)
    noise = np.linalg.norm(center) * math.sqrt((1 / cosine - 1) / 32)
    group = center + rng.normal(size=(800, 32)) * noise
    points = np.array([*group, *rng.normal(size=(1600, 32))], np.float32)
    given = [(int(i), [float(x) for x in points[i]]) for i in rng.permutation(len(points))]
    ids, link = linked(given)
    found = {r.vec_id: r for r in pivots.near_duplicates(table(spark, given), tile=256).collect()}
    counts = link.sum(axis=1) - 1
    assert all(found[i].n_links <= c for i, c in zip(ids, counts, strict=True))
    assert sum(r.n_links for r in found.values()) >= 0.99 * counts.sum()
    assert {found[i].component_id for i in range(800)} == {0}


def test_dimensions_and_repeated_ids(spark):
    # Vectors link within their dimension, whichever is the most frequent one, and an id that
    # several vectors share adds nothing to the links of any of them.
    given = [
        (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]),
        (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.0, 0.0]),
        (21, [1.0]), (22, [2.0]), (23, [-1.0]),
        (31, [0.0, 0.0, 0.0, 1.0]), (31, [1.0, 0.0, 0.0, 0.0]), (32, [1.0, 0.1, 0.0, 0.0]),
        (33, [1.0, 0.0, 0.1, 0.0]),
    ]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.near_duplicates(table(spark, given)).collect())
    assert got == [
        (1, 1, 1), (2, 1, 1), (3, 0, 3), (11, 1, 11), (12, 1, 11), (21, 1, 21), (22, 1, 21), (23, 0, 23),
        (31, 0, 31), (31, 2, 31), (32, 2, 31), (33, 2, 31),
    ]


def test_lengths_that_overflow(spark):
    given = [(1, [1e300, 1e299]), (2, [1e-300, 1e-301]), (3, [-1e300, 1.0]), (4, [3.0, 0.0])]
    docs = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.near_duplicates(docs).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)]


def test_links_in_parts_equal_links_in_whole_lists(spark, cloud):
    whole, parts = (
        sorted(tuple(r) for r in pivots.near_duplicates(table(spark, cloud), tile=size).collect())
        for size in (10_000, 8)
    )
    assert whole == parts


def test_nearest(spark, cloud):
    # Repeated rows are candidates as often as they occur.
    given = cloud + ODD + [cloud[1], cloud[1]]
    got = onebit.search(
        table(spark, given), F.col("id") % 20 == 0, k=7, index_block=100, query_block=8
    ).collect()
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in [*cloud, cloud[1], cloud[1]]]
    by_id = dict(usable)
    hits = total = 0
    for query in sorted(i for i in by_id if i % 20 == 0):
        scored = sorted(
            ((-math.fsum(v * by_id[query]), i) for i, v in usable if i != query)
        )[:7]
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 8))
        for r in mine:
            assert r.score == pytest.approx(float(by_id[query] @ by_id[r.vec_id]), abs=1e-9)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({i for _, i in scored} & {r.vec_id for r in mine})
        total += len({i for _, i in scored})
    assert hits >= 0.97 * total


def test_nearest_in_doubles(spark):
    # Whole doubles, not cut to floats, and lengths whose squares overflow.
    rng = np.random.default_rng(11)
    points = [[0.1, 0.2], [0.3, 0.7], [1e300, 1e-3], [-1e300, 2.0], [1e-200, 1e-200], [5.0, 1e8]]
    points += [[float(a), float(b)] for a, b in rng.normal(size=(40, 2)) * 10.0 ** rng.integers(-9, 9, (40, 1))]
    rows = list(enumerate(points))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = onebit.search(docs, F.col("id") % 20 == 0, k=5, index_block=16, query_block=2).collect()
    for query in (0, 20, 40):
        right = sorted(
            ((-(v[0] * points[query][0] + v[1] * points[query][1]), i) for i, v in rows if i != query)
        )[:5]
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)
        assert [(-r.score, r.vec_id) for r in mine] == right


def test_nearest_of_many(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = docs.collect()
    points = np.array([r.embedding for r in rows])
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in onebit.search(docs, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = points @ points[at]
        score[at] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits, total = hits + len(best & got[int(ids[at])]), total + 20
    assert hits >= 0.99 * total


def test_few_and_no_vectors(spark):
    none = table(spark, [])
    assert pivots.near_duplicates(none).collect() == []
    assert onebit.search(none, F.col("id") % 20 == 0).collect() == []
    odd = table(spark, ODD[:2])
    assert {r.kept for r in pivots.near_duplicates(odd).collect()} == {True}
    two = table(spark, [(0, [1.0, 0.0]), (20, [2.0, 0.0])])
    assert [r.n_links for r in pivots.near_duplicates(two).collect()] == [1, 1]
    got = onebit.search(two, F.col("id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 20, 2.0), (20, 1, 0, 2.0)]


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, 200)]
    edges = spark.createDataFrame(chain + chain[:5], "a long, b long")
    expected = [(i, 0) for i in range(41)] + [(100, 100), (103, 100), (105, 100)]
    assert rows(components(edges), "id", "component") == sorted(expected, key=repr)
    assert components(edges.limit(0)).collect() == []
