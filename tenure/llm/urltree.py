"""Allow or block addresses by rules and by the path templates of their host.

The paths of a host form a tree of segments. Level by level, a segment stays a branch
of its own only if it is frequent and its labelled pages differ from those of all its
siblings; variable segments (those that are rare or statistically like the rest) are merged,
first by their extension and then, unless that tells them apart, into the wildcard ``*``.
The tree is followed as deep as any of its branches can still be told apart. What is left
are the templates of the host. A template is judged by the share of bad ones among its
labelled pages, smoothed towards its host, which is smoothed towards all pages.

DataFrame functions only. All counting is over distinct (host, path) pairs, which are
counted first, so a popular path is one row; sums are added up before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Pages that a branch must have to be told apart, and the difference of bad shares, in
# standard errors, that tells it.
MIN_PAGES, Z = 20, 3.0
# Labelled pages that the prior of a template and of a host counts for.
PRIOR = 10.0
# Parts that the paths of a node are dealt into where they join what is known of it.
SALTS = 32
# Smoothed share of bad pages that blocks a template.
BLOCK_AT = 0.5


@dataclass(frozen=True)
class Rule:
    pattern: str
    allow: bool

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty for a null address and for one without ``://``."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return (
        F.translate(F.coalesce(host, F.lit("")), UPPER, UPPER.lower()),
        F.coalesce(path, F.lit("")),
    )


def matching_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule whose host is the address's or a parent of it and whose path the
    address's starts with, as (pattern, allow); null if none fits."""
    found = F.lit(None).cast("struct<pattern:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        own = F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.allow).alias("allow"))
        found = F.when(fits, own).otherwise(found)
    return found


def segments_of(path: Column) -> Column:
    """The segments of a path, without empty ones."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _apart(n: str, labelled: str, bad: str) -> Column:
    """Whether a branch with these sums is frequent, and its share of bad pages further from
    that of its siblings than chance explains. The node has ``all_labelled`` and ``all_bad``."""
    pooled = F.col("all_bad") / F.col("all_labelled")
    others = F.col("all_labelled") - F.col(labelled)
    gap = F.abs(F.try_divide(bad, labelled) - F.try_divide(F.col("all_bad") - F.col(bad), others))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), others)))
    return (F.col(n) >= MIN_PAGES) & F.coalesce(gap > Z * error, F.lit(False))


def _told(paths: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """``paths`` with the one row of ``known`` for their ``on``, if there is one. A node may have
    a third of all paths; ``known`` has far fewer rows, which are copied for each part."""
    copies = known.withColumn("salt", F.explode(F.lit(list(range(SALTS))).cast("array<long>")))
    salt = F.pmod(F.xxhash64("segments"), F.lit(SALTS))
    return paths.withColumn("salt", salt).join(copies, [*on, "salt"], "left").drop("salt")


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (``host``, ``segments``, ``n`` pages, ``labelled``, ``bad``) with ``template``.

    A node with few pages, or whose labelled pages are all good or all bad, has no branch to
    be told apart: what lies below it are wildcards, and only the others are followed. So
    the number of levels is that of the deepest node with a choice, and each level has the
    paths below such nodes only.
    """
    sums = ("n", "labelled", "bad")
    tree = cut(paths.withColumn("template", F.lit("")))
    done: list[DataFrame] = []
    level = 0
    while not tree.isEmpty():
        nodes = (
            tree.groupBy("host", "template")
            .agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
            .where((F.col("all_n") >= MIN_PAGES) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled")))
        )
        segment = F.coalesce(F.try_element_at("segments", F.lit(level + 1)), F.lit(""))
        rest = F.repeat(F.lit("/*"), F.size("segments") - level)
        # Written at every level: what follows reads it several times.
        followed = cut(
            _told(tree, nodes, ["host", "template"])
            .withColumn("segment", segment)
            .withColumn("open", F.col("all_n").isNotNull() & (F.col("segment") != ""))
        )
        done.append(
            followed.where("not open").select(
                "host", "segments", *sums,
                # Open nodes end here with the paths that do.
                F.when(F.col("all_n").isNull(), F.concat("template", rest)).otherwise(F.col("template")).alias("template"),
            )
        )
        branches = (
            followed.where("open")
            .groupBy("host", "template", "segment")
            .agg(*(F.sum(c).alias(c) for c in sums), *(F.first(c).alias(c) for c in ("all_labelled", "all_bad")))
            .withColumn("own", _apart(*sums))
            .withColumn("extension", F.regexp_extract("segment", r"(\.[a-zA-Z]{1,5})$", 1))
        )
        # Variable segments with the same extension, as one branch.
        alike = (
            branches.where(~F.col("own") & (F.col("extension") != ""))
            .groupBy("host", "template", "extension")
            .agg(*(F.sum(c).alias(c) for c in sums), *(F.first(c).alias(c) for c in ("all_labelled", "all_bad")))
            .where(_apart(*sums))
            .select("host", "template", "extension", F.lit(True).alias("kind"))
        )
        own = branches.where("own").select("host", "template", "segment", "own")
        variable = F.when(F.col("kind"), F.concat(F.lit("/*"), "extension")).otherwise(F.lit("/*"))
        step = F.when(F.col("own"), F.concat(F.lit("/"), "segment")).otherwise(variable)
        stepping = followed.where("open").select(
            "host", "segments", *sums, "template", "segment",
            F.regexp_extract("segment", r"(\.[a-zA-Z]{1,5})$", 1).alias("extension"),
        )
        stepping = _told(stepping, own, ["host", "template", "segment"])
        stepping = _told(stepping, alike, ["host", "template", "extension"])
        tree = cut(stepping.select("host", "segments", *sums, F.concat("template", step).alias("template")))
        level += 1
    return reduce(DataFrame.unionByName, done) if done else tree


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...],
    id_col: str = "page_id",
    url_col: str = "url",
    prior: float = PRIOR,
    block_at: float = BLOCK_AT,
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``template``, ``bad_share`` and ``verdict``.

    ``labels`` has ``id_col`` and ``bad`` (boolean); several labels of a page count as one,
    bad if any is. Null ids have no label. Without any label every template takes the
    prior of 0.5 bad, which does not exceed ``block_at``. A null address and one without
    ``://`` have an empty host and path, which is a host of its own. Repeated pages count
    and are judged each; other columns play no part.
    """
    host, path = host_and_path(F.col(url_col))
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(F.bool_or("bad").alias("bad"))
    own = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn(
        "segments", segments_of(F.col("path"))
    )
    known = own.join(marked, "id", "left")
    paths = known.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("bad").alias("labelled"),
        F.count_if("bad").alias("bad"),
    )
    found = cut(templates(paths))
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    whole = (
        found.agg(*sums)
        .select(
            (F.coalesce("bad", F.lit(0)) + 0.5 * prior)
            / (F.coalesce("labelled", F.lit(0)) + prior)
        )
        .scalar()
    )
    hosts = (
        found.groupBy("host")
        .agg(*sums)
        .select(
            "host",
            ((F.col("bad") + prior * whole) / (F.col("labelled") + prior)).alias("host_share"),
        )
    )
    shares = (
        found.groupBy("host", "template").agg(*sums).join(hosts, "host")
        .select("host", "template", ((F.col("bad") + prior * F.col("host_share"))
                                     / (F.col("labelled") + prior)).alias("bad_share"))
    )
    judged = _told(found.select("host", "segments", "template"), shares, ["host", "template"])
    rule = matching_rule(rules, F.col("host"), F.col("path"))
    allowed = F.coalesce(F.col("match.allow"), F.col("bad_share") <= block_at)
    return (
        own.join(judged, ["host", "segments"])
        .withColumn("match", rule)
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("match.pattern").alias("rule"),
            "template",
            "bad_share",
            F.when(allowed, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"),
        )
    )
