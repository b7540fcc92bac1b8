"""Random time lines against trying every pair in plain Python."""

import datetime as dt
import random
from collections import Counter

import pytest

from tenure.plans import log, repair, windows

BASE = dt.datetime(2021, 1, 1)


@pytest.fixture(autouse=True, params=[2, 13], ids=["few cuts", "many cuts"])
def cuts(request, spark):
    """Where an account's line is cut must not matter."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)



def moment(rnd, hours):
    """Whole hours often, so that bounds and changes meet."""
    at = BASE + dt.timedelta(hours=rnd.randrange(hours))
    return at if rnd.random() < 0.5 else at + dt.timedelta(microseconds=rnd.randrange(3_600_000_000))


@pytest.fixture(scope="module")
def lines():
    """Account 0 holds far more than a join block; the others little."""
    rnd = random.Random(20210101)
    changes = [
        (0 if rnd.random() < 0.8 else rnd.randrange(1, 30), moment(rnd, 900), f"P{rnd.randrange(4)}")
        for _ in range(1800)
    ]
    relations = [
        {
            "id": f"r{i:03}",
            "account": 0 if rnd.random() < 0.4 else rnd.randrange(40),
            "start": moment(rnd, 900),
            "end": None if rnd.random() < 0.2 else moment(rnd, 1200),
            "owner": None if rnd.random() < 0.6 else f"P{rnd.randrange(4)}",
        }
        for i in range(150)
    ]
    return relations, changes


@pytest.fixture(scope="module")
def pairs(lines):
    relations, changes = lines
    return [
        (r, c)
        for r in relations
        for c in changes
        if r["account"] == c[0] and r["start"] <= c[1] and (r["end"] is None or c[1] <= r["end"])
    ]


@pytest.fixture
def tables(make, lines):
    relations, changes = lines
    return make.relations(*relations), make.history(*((a, at, "-", new) for a, at, new in changes))


def test_pairs(tables, pairs, rows):
    assert len(pairs) > 10_000
    got = rows(windows.relation_changes(*tables), "id", "changed_at", "new_value")
    assert got == sorted(((r["id"], c[1], c[2]) for r, c in pairs), key=repr)


def test_counts(tables, pairs, rows):
    wanted = Counter(r["id"] for r, _ in pairs if r["owner"] is None)
    got = rows(windows.changes_per_relation(*tables))
    assert got == sorted(wanted.items(), key=repr)

    owned = [(r, c) for r, c in pairs if r["owner"] is not None]
    agreeing = [r["id"] for r, c in owned if r["owner"] == c[2]]
    assert rows(windows.owner_agreement(*tables)) == [
        (len({r["id"] for r, _ in owned}), len(agreeing), len(set(agreeing)))
    ]


def test_single_changes_name_the_right_owner(tables, pairs, rows):
    n = Counter(r["id"] for r, _ in pairs)
    wanted = [
        (r["id"], c[2]) for r, c in pairs if r["owner"] is None and n[r["id"]] == 1
    ]
    found = windows.attributions(*tables).where("n_changes = 1")
    assert rows(found, "id", "last_value") == sorted(wanted, key=repr)


def test_next_starts(tables, lines, rows):
    relations, _ = lines
    line = sorted(relations, key=lambda r: (r["account"], r["start"], r["id"]))
    wanted = []
    for r, following in zip(line, [*line[1:], None]):
        same = following is not None and following["account"] == r["account"]
        wanted.append((r["id"], r["end"] or (following["start"] if same else None)))
    assert rows(repair.repair_end_dates(tables[0]), "id", "ended_at") == sorted(
        wanted, key=repr
    )


def test_history_counts(tables, lines, rows):
    relations, changes = lines
    per_account = Counter(c[0] for c in changes)
    missing = [r["account"] for r in relations if r["owner"] is None]
    known = [a for a in missing if per_account[a]]
    assert rows(log.to_fix_with_history(*tables)) == [
        (sum(per_account[a] for a in known), len(known))
    ]
    assert rows(log.to_fix_without_history(*tables)) == [(len(missing) - len(known),)]
