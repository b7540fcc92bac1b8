"""A Merkle manifest of a dataset, with a proof for every row, by pointer jumping.

A row's leaf is the SHA-256 of its fields. The leaves of a group (a source) are ordered,
and every ``FAN`` neighbours become one node, level by level, until one is left; the
groups' last nodes, ordered by group, become one root in the same way.

Every inner node first holds a pointer to its parent and the segment of siblings that it
needs on the way there. Joined to the node it points to, it takes over that one's pointer
and appends its segments, so each round doubles the distance and a logarithmic number of
rounds reaches the root. Leaves enter in the last join only: their own siblings are a
list that all of a run share, so long segments never travel with a leaf. A node is asked
by at most ``FAN ** 2 ** round`` others: 65 536 in the third round, after which pointers
span eight levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import discard, stage

# Nodes that become one of the next level.
FAN = 16
# Rows of a partition are numbered in the low bits of monotonically_increasing_id().
ROW_BITS = 33
# The tree over the groups. The trees of groups are "" (null) and "+" with the name, which
# sorts as the contract asks: null first, then by bytes.
TOP = "*"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["tree", "level", "idx"]
SEGMENT = "array<struct<left:string,right:string>>"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 in hex of the fields, each ``-`` if null, else its bytes, a colon, its text."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        size = F.octet_length(text).cast("string")
        return F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def _node_hash(members: Column) -> Column:
    return F.sha2(F.array_join(members, ""), 256)


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, str]:
    """``rows`` with ``idx``, the place among those of the same tree from 0, and ``n``, their
    number; and the folder that holds them. Sorted in ranges, so a large tree is spread."""
    keys = [tree, *order]
    placed, folder = stage(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("part", F.shiftright("at", ROW_BITS))
    line = Window.partitionBy(tree).orderBy("part")
    whole = Window.partitionBy(tree)
    parts = (
        placed.groupBy(tree, "part")
        .agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("first"))
        .select(
            tree,
            "part",
            (F.sum("own").over(line) - F.col("own") - F.col("first")).alias("shift"),
            F.sum("own").over(whole).alias("n"),
        )
    )
    found = placed.join(parts, [tree, "part"]).withColumn("idx", F.col("at") + F.col("shift"))
    return found.drop("at", "part", "shift"), folder


def _runs(nodes: DataFrame, fan: int) -> list[tuple[DataFrame, str]]:
    """Level by level the nodes above ``nodes`` (``tree``, ``idx``, ``n``, ``hash``), each with the
    hashes that it covers as ``members``, written. ``n`` counts the nodes of a level."""
    found = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.expr(f"idx div {fan}")
        member = F.struct("idx", "hash")
        nodes, folder = stage(
            nodes.where("n > 1")
            .groupBy("tree", run.alias("run"))
            .agg(F.sort_array(F.collect_list(member)).alias("m"), F.first("n").alias("n"))
            .select(
                "tree",
                F.lit(len(found) + 1).alias("level"),
                F.col("run").alias("idx"),
                F.expr(f"(n + {fan - 1}) div {fan}").alias("n"),
                F.col("m.hash").alias("members"),
                _node_hash(F.col("m.hash")).alias("hash"),
            )
        )
        found.append((nodes, folder))
        most = -(-most // fan)
    return found


def _siblings(members: Column, place: Column, fan: int) -> Column:
    """What stands left and right of a place in its run."""
    left = F.array_join(F.slice(members, F.lit(1), place.cast("int")), "")
    right = F.array_join(F.slice(members, place.cast("int") + 2, F.lit(fan)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _links(runs: DataFrame, fan: int) -> DataFrame:
    """A pointer for every member of ``runs``; none where the run is the root of all."""
    place = F.col("place")
    to = F.struct("tree", "level", "idx")
    return runs.select(
        "*", F.when((F.col("tree") != TOP) | (F.col("n") > 1), to).alias("to"),
        F.posexplode("members").alias("place", "own"),
    ).select(
        "tree",
        (F.col("level") - 1).alias("level"),
        (F.col("idx") * fan + place).alias("idx"),
        "to",
        F.array(_siblings(F.col("members"), place, fan)).cast(SEGMENT).alias("segments"),
        F.when((F.col("tree") == TOP) & (F.col("level") == 1), F.col("own")).alias("subroot"),
    )


def _jump(pointers: DataFrame) -> DataFrame:
    """One round: every pointer moves on to where the node that it names points to."""
    named = pointers.select(
        *(F.col(c).alias(f"_{c}") for c in NODE),
        F.col("to").alias("next"),
        F.col("segments").alias("more"),
        F.col("subroot").alias("above"),
    )
    moved = pointers.where("to is not null").join(
        named,
        (F.col("to.tree") == F.col("_tree"))
        & (F.col("to.level") == F.col("_level"))
        & (F.col("to.idx") == F.col("_idx")),
    )
    return moved.select(
        *NODE,
        F.col("next").alias("to"),
        F.concat("segments", "more").alias("segments"),
        F.coalesce("subroot", "above").alias("subroot"),
    ).unionByName(pointers.where("to is null"))


def proofs(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    carry: dict[str, Column] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Per row ``id``, ``group``, ``leaf``, ``subroot``, ``root`` and ``segments``: level by level what
    stands left and right of it (arrays of digests in hex, joined), from its run to the
    root; with the expressions in ``carry`` under their names. ``fold`` and ``digest`` use it.

    Leaves of a group follow their id (null first), ties their hash, so rows that agree in
    all fields are interchangeable. A null group comes before all others, an empty one is
    a group of its own. Levels without siblings have an empty segment. An empty table gives
    none. Columns that are not named are left out, whatever their names. The driver sees
    two counts and the root.
    """
    carry = carry or {}
    group = F.col(group_col).cast("string")
    carried = F.struct(*(c.alias(n) for n, c in carry.items()), F.lit(0).alias("_"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        group.alias("group"),
        F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("tree"),
        leaf_hash([F.col(f) for f in fields]).alias("hash"),
        carried.alias("carried"),
    )
    leaves, leaf_folder = stage(rows)
    numbered, number_folder = _numbered(leaves, "tree", ["id", "hash"])
    nodes = numbered.select("tree", "idx", "n", "hash")
    runs = _runs(nodes, fan)
    last = [nodes.withColumn("level", F.lit(0)), *(r for r, _ in runs)]
    ends = reduce(DataFrame.unionByName, (r.where("n = 1").select("tree", "level", "hash") for r in last))
    ranked, rank_folder = _numbered(ends.withColumn("top", F.lit(TOP)), "top", ["tree"])
    tops = ranked.select(F.col("top").alias("tree"), "idx", "n", "hash")
    top_runs = _runs(tops, fan)
    # A group's last node stands for the leaf of the upper tree that has its rank.
    up = F.struct(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), "idx")
    none = F.array().cast(SEGMENT)
    of_groups = ranked.where("level > 0").select(
        "tree", "level", F.lit(0).cast("long").alias("idx"),
        F.when(F.col("n") > 1, up).alias("to"), none.alias("segments"), F.col("hash").alias("subroot"),
    )
    alone = tops.where("n = 1").select(
        "tree", F.lit(0).alias("level"), "idx",
        F.lit(None).cast("struct<tree:string,level:int,idx:bigint>").alias("to"),
        none.alias("segments"), F.col("hash").alias("subroot"),
    )
    inner = [r for r, _ in runs[1:]] + [r for r, _ in top_runs]
    pointers = reduce(DataFrame.unionByName, [of_groups, alone, *(_links(r, fan) for r in inner)])
    held, folder = stage(pointers)
    root = (top_runs[-1][0] if top_runs else tops).select("hash").first()
    distance = 1
    while distance < len(runs) + len(top_runs):
        farther, next_folder = stage(_jump(held))
        discard(docs.sparkSession, folder)
        held, folder, distance = farther, next_folder, 2 * distance
    way = held.select(*NODE, "segments", "subroot")
    lone = ranked.where("level = 0").select(
        F.col("tree").alias("of"), F.col("idx").alias("at"), F.array("hash").alias("members")
    ).join(way.where(F.col("tree") == TOP).where("level = 0"), F.col("at") == F.col("idx")).select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("run"), "members", "segments", "subroot"
    )
    paths = lone
    if runs:
        first = runs[0][0].select("tree", "level", "idx", "members").join(way, NODE)
        paths = lone.unionByName(
            first.select("tree", F.col("idx").alias("run"), "members", "segments", "subroot")
        )
    own = F.when(
        F.col("n") > 1,
        F.array(_siblings(F.col("members"), F.expr(f"idx % {fan}"), fan)).cast(SEGMENT),
    ).otherwise(none)
    return (
        numbered.withColumn("run", F.expr(f"idx div {fan}"))
        .join(paths, ["tree", "run"])
        .select(
            "id",
            "group",
            F.col("hash").alias("leaf"),
            "subroot",
            F.lit(root["hash"] if root else None).cast("string").alias("root"),
            F.concat(own, "segments").alias("segments"),
            *(F.col(f"carried.{n}").alias(n) for n in carry),
        )
    )


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf leads to along its segments."""
    return F.aggregate(
        segments, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256)
    )


def digest(segments: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), ""), 256)
