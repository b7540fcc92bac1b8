"""Hilbert shards and source mixes on small tables and against SQL."""

import itertools
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.llm import hilbert, mixing, oracles, registry

SMALL = "/root/testdata/sf0.001"


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = list(itertools.product(range(1 << bits), repeat=dims))
        index = hilbert.curve_index([np.array(c) for c in zip(*points, strict=True)], bits)
        assert sorted(index) == list(range(len(points)))
        path = [p for _, p in sorted(zip(index, points, strict=True))]
        steps = {sum(abs(a - b) for a, b in zip(p, q, strict=True)) for p, q in itertools.pairwise(path)}
        assert steps == {1}


@pytest.mark.parametrize("n", [0, 1, 5, 8, 101])
def test_even_runs(spark, n):
    given = [(i, None if i % 7 == 0 else i % 5, "curved", 1) for i in range(n)] + [(None, None, None, 1)] * (n > 8)
    table = spark.createDataFrame(given, "doc_id long, a long, shape string, k int")
    got = hilbert.shards(table, {"a": F.col("a"), "id": F.col("doc_id")}).collect()
    assert len(got) == len(given)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(8))


def test_shards_of_documents(spark):
    got = registry.op3_hilbert_shards(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    size = dict(zip(docs["doc_id"], docs["text"].map(lambda t: len((t or "").encode()) + 1), strict=True))
    assert all(size[i] == s for i, s in zip(got["doc_id"], got["size"], strict=True))
    joined = got.merge(docs, on="doc_id")
    # Four languages on eight shards: a curve keeps most shards to few of them.
    assert joined.groupby("shard")["lang"].nunique().mean() <= 3
    again = registry.op3_hilbert_shards(spark, SMALL).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert (got[key].sort_values("doc_id").values == again[key].sort_values("doc_id").values).all()


def brute_force_shards(rows, dims, tie, n_shards=8):
    """(shard, slot) of every row by sorting cells of exact quantiles in plain Python."""
    steps = (1 << hilbert.BITS) - 1
    cells = []
    for dim in dims:
        values = sorted(dim(r) for r in rows if dim(r) is not None)
        edges = [values[math.ceil(i / steps * len(values)) - 1] for i in range(1, steps)]
        cells.append([0 if dim(r) is None else 1 + sum(dim(r) > e for e in edges) for r in rows])
    curve = hilbert.curve_index([np.array(c) for c in cells], hilbert.BITS)
    order = sorted(range(len(rows)), key=lambda i: (curve[i], *tie(rows[i])))
    n, placed, used = len(rows), {}, Counter()
    for rank, i in enumerate(order):
        shard = rank * n_shards // n
        placed[i] = (shard, used[shard])
        used[shard] += 1
    return placed


def test_shards_against_sorted_cells(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.lang, r.source)
        for r in docs
    ]
    text = lambda at: lambda r: None if r[at] is None else r[at].encode()
    right = brute_force_shards(
        rows, [text(3), text(4), lambda r: r[1], lambda r: r[0]], lambda r: (r[2], r[0])
    )
    got = {r.doc_id: (r.shard, r.slot) for r in registry.op3_hilbert_shards(spark, SMALL).collect()}
    assert got == {rows[i][0]: place for i, place in right.items()}


def test_strings_that_begin_alike(spark):
    # Long common beginnings, bytes above 127, empty and null strings.
    names = [None, "", "common_crawl_2020", "common_crawl_2021", "common_crawl_2022", "é", "z"]
    rows = [(i, names[i * 5 % 7]) for i in range(140)]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    got = hilbert.shards(table, {"source": F.col("source")}, n_shards=7, tie=["doc_id"]).collect()
    right = brute_force_shards(
        rows, [lambda r: None if r[1] is None else r[1].encode()], lambda r: (r[0],), 7
    )
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {rows[i][0]: p for i, p in right.items()}
    assert len({(r.source, r.shard) for r in got}) == 7


def test_manifest_and_files(spark, tmp_path):
    table = spark.createDataFrame([(i, i * i) for i in range(40)], "doc_id long, a long")
    got = hilbert.shards(table, {"a": F.col("a")}, n_shards=4)
    ends = hilbert.manifest(got, ["a"]).orderBy("min_a").collect()
    assert [r.n_rows for r in ends] == [10] * 4
    assert all(p.max_a < q.min_a for p, q in itertools.pairwise(ends))
    hilbert.write(got, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out"))[-4:] == [f"shard={i}" for i in range(4)]


def waterfill(sizes, weights, share=1.5, repeats=2):
    """Resharing the excess in rounds, as the rule says it."""
    target = dict.fromkeys(sizes, 0.0)
    full, rest = set(), share * sum(sizes.values())
    while len(full) < len(sizes):
        free = [s for s in sizes if s not in full]
        level = rest / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > repeats * sizes[s]]
        for s in free:
            target[s] = level * weights[s]
        if not over:
            break
        for s in over:
            target[s] = repeats * sizes[s]
            rest -= target[s]
            full.add(s)
    return target


def sainte_lague(target, house):
    """Seat by seat, each to the highest quotient."""
    seats = dict.fromkeys(target, 0)
    order = sorted(target, key=lambda s: (s is None, s or ""))
    for _ in range(house):
        best = max(order, key=lambda s: (target[s] / (2 * seats[s] + 1), -order.index(s)))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("block", [1, 7, 32])
def test_quotas_are_seats_of_the_highest_quotients(spark, block):
    rng = np.random.default_rng(block)
    # Many equal small sources, whose roundings all miss the house the same way, a large one,
    # ties, sources without words and a null one.
    sizes = {None: 900, "big": 20_000, "none": 0, "empty": 0}
    sizes |= {f"even{i:02}": 48 for i in range(40)} | {f"r{i:02}": int(rng.integers(0, 400)) for i in range(20)}
    table = spark.createDataFrame(
        [(s, n, float(n) * 1.5) for s, n in sizes.items()], "source string, source_size long, target double"
    )
    got = {r.source: r.seats for r in mixing.quotas(table, 1.5, 5, block).collect()}
    assert set(got) == set(sizes)
    house = math.floor(1.5 * sum(sizes.values()) / block + 0.5)
    for j in range(6):
        right = sainte_lague({s: 1.5 * n for s, n in sizes.items()}, house * j // 5)
        assert {s: v[j] for s, v in got.items()} == right
    assert all(a <= b for v in got.values() for a, b in itertools.pairwise(v))


def test_quotas_without_words(spark):
    table = spark.createDataFrame([("a", 0, 0.0), (None, 0, 0.0)], "source string, source_size long, target double")
    assert [r.seats for r in mixing.quotas(table, 1.5, 2, 32).collect()] == [[0, 0, 0]] * 2


def test_rows_without_an_id_are_spread_by_text(spark):
    rows = [(None, f"w{i} x y z", "a") for i in range(400)] + [(None, "same words", "a")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, carry=("text",)).collect()
    size = 4 * 400 + 2 * 20
    assert len(got) == 420 and sum(r.taken for r in got) == math.floor(1.5 * size / 32 + 0.5) * 32
    again = mixing.mix(docs.repartition(5), carry=("text",)).collect()
    assert Counter((r.text, r.taken) for r in again) == Counter((r.text, r.taken) for r in got)
    # Drawn by text, the rows taken twice are not those that come first.
    twice = [r.text for r in got if r.taken == 2 * r.size and r.size == 4]
    assert 0 < len(twice) < 400 and sorted(twice) != sorted(t for _, t, _ in rows[: len(twice)])


def test_mix_by_hand(spark):
    rng = np.random.default_rng(1)
    names = ["b", "a", None, "", "é", "Z"]
    given = [
        (i, " ".join("w" * 2 for _ in range(rng.integers(0, 200))), names[rng.integers(0, 6)] if i % 3 else "a", 5)
        for i in range(200)
    ] + [(None, None, None, 5), (3, "x y", "a", 5), (3, "x y", "a", 5), (900, "", "empty", 5)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(given)
    sizes = {}
    for _, text, source, _ in given:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = waterfill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)})
    taken, target = {}, {}
    source_of = {i: s for i, _, s, _ in given}
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(expected[source])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(s["to"] - s["from"] for s in r.spans)
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    house = math.floor(1.5 * sum(sizes.values()) / mixing.BLOCK + 0.5)
    seats = sainte_lague({s: expected[s] for s in sizes}, house)
    assert taken == {s: min(seats[s] * mixing.BLOCK, 2 * sizes[s]) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in taken)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    row = mixing.mix(one).first()
    assert (row.size, row.target, row.taken, row.spans) == (0, 0.0, 0, [])


def test_mix_against_sql(spark):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = base.execute(oracles.MIX).fetchall()
    got = registry.op8_source_mix(spark, SMALL)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(expected)
