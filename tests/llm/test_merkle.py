"""The Merkle manifest against a plain recursion."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tenure.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, segments string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes, fan):
    """Levels from ``nodes`` up to the single last one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([sha("".join(own[i : i + fan])) for i in range(0, len(own), fan)])
    return levels


def siblings(levels, place, fan):
    out = []
    for own in levels[:-1]:
        begin = place // fan * fan
        out.append(("".join(own[begin:place]), "".join(own[place + 1 : begin + fan])))
        place //= fan
    return out


def expected(rows, fan):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), leaf(row), row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: grow([x[1] for x in sorted(trees[s])], fan) for s in names}
    top = grow([grown[s][-1][0] for s in names], fan)
    found = []
    for at, s in enumerate(names):
        for place, (_, own, i) in enumerate(sorted(trees[s])):
            way = siblings(grown[s], place, fan) + siblings(top, at, fan)
            found.append((i, s, own, grown[s][-1][0], top[-1][0], way))
    return sorted(found, key=repr)


def made_up():
    rows = [(i, "big", "en", i, f"text {i}") for i in range(300)]
    rows += [(i, f"s{i % 37:02}", None, None, "É" * (i % 3)) for i in range(60)]
    # Repeated rows and ids, a null and an empty group, null ids and texts, a long text.
    rows += [(7, "s01", "x", 1, "twice")] * 3 + [(7, "s01", "x", 1, "other")]
    rows += [(None, None, None, None, None), (None, "", "a", 0, ""), (5, "", "a", 0, "y" * 200_000)]
    rows += [(-3, None, "q", -1, "1:a"), (None, "s02", "x", 2, "no id")]
    return rows


def proved(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "t", 1, "s") for r in rows], SCHEMA).repartition(5)
    got = merkle.proofs(docs, **options)
    return got.withColumns(
        {"back": merkle.fold(F.col("leaf"), F.col("segments")), "all": merkle.digest(F.col("segments"))}
    ).collect()


@pytest.mark.parametrize(("fan", "n"), [(16, None), (3, None), (16, 1), (16, 3), (2, 200)])
def test_proofs(spark, fan, n):
    rows = made_up()[:n]
    got = proved(spark, rows, fan=fan)
    told = [
        (r.id, r.group, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.segments]) for r in got
    ]
    assert sorted(told, key=repr) == expected(rows, fan)
    assert {r.back for r in got} == {got[0].root}
    for r in got:
        assert r["all"] == sha("".join(s.left + s.right for s in r.segments))


def test_empty_and_carried(spark):
    assert proved(spark, []) == []
    rows = made_up()
    wrong = {"claim": F.when(F.col("doc_id") == 5, F.lit("0")).otherwise(merkle.leaf_hash([F.col(f) for f in merkle.FIELDS]))}
    docs = spark.createDataFrame([(*r, "t", 1, "s") for r in rows], SCHEMA)
    got = merkle.proofs(docs, carry=wrong)
    bad = got.where(merkle.fold(F.col("claim"), F.col("segments")) != F.col("root")).collect()
    assert {r.id for r in bad} == {5} and len(bad) == sum(r[0] == 5 for r in rows)
