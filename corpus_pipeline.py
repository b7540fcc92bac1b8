"""A training corpus from ``documents``, stage by stage.

Every stage takes what the one before it kept. Documents whose language cannot be told
go; lines that repeat an earlier one go, and with them documents that are left empty; one
document of each group of near-duplicates stays, the one with the smallest id; sources
are mixed to their target weights, so a document may come twice, or in part; the last
stage encodes what is left. Each function takes (spark, docs, sf_dir) and looks at the
columns of ``documents`` only; others are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import bpe, langid, lines, mixing, ngrams, registry
from tenure.llm.common import cut, read, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence tells with enough probability.

    Null and empty texts have no evidence of their own and go, as do texts without a
    trigram. Every row is judged by itself, so repeated rows share their fate. An empty
    table gives none.
    """
    docs = docs.select(*COLUMNS)
    pages = read(spark, sf_dir, "pages")
    model = langid.train(docs)
    scored = docs.withColumn("scores", langid.text_scores(F.col("text"), model))
    slim = cut(registry.with_page(scored.select("doc_id", "source", "scores"), pages))
    judged = langid.fuse(
        registry.with_page(scored, pages), model, langid.gather(slim, model)
    )
    return judged.where("accepted").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one.

    Earlier is what has the smaller id; rows without one come last. Rows that agree in id
    and text keep the same lines. Null and empty texts stay as they are; documents that are
    left without any line go. An empty table gives none.
    """
    return _counted(lines.without_repeats(docs.select(*COLUMNS)))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Of rows that agree in id and text one stays, also of those without an id. Groups are
    made of the rows, whatever their ids: of equal ids the text with the smaller hash comes
    first, and rows without an id come last. Rows without words are in no group.
    """
    docs = docs.select(*COLUMNS)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Numbers in the order of the ids, as these may be missing or repeated. Staged, so that
    # every reader sees the same numbers. The last key lets equal rows be sorted in parts.
    numbered, _ = stage(
        docs.where(has_words)
        .withColumn("place", F.monotonically_increasing_id())
        .orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"), "place")
        .withColumn("row", F.monotonically_increasing_id())
    )
    groups, _ = stage(ngrams.near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text")))
    # Every row knows the smallest number of its group: the one that has it itself stays.
    heads = groups.where("n_shingles > 0 and doc_id = component_id").select(
        F.col("doc_id").alias("row")
    )
    return (
        numbered.join(heads, "row", "left_semi")
        .select(*docs.columns)
        .unionByName(docs.where(~has_words).dropDuplicates(["doc_id", "text"]))
    )


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each run of words that it takes of a document in one round.

    A document taken whole keeps its text as it is; one taken in part keeps the part from
    its first to its last word taken, with all line breaks and spaces between. Null and
    empty texts have no words and are not taken. Rows that agree in id and size may stand
    for each other; an empty table gives none.
    """
    docs = docs.select(*COLUMNS)
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    mixed = mixing.mix(
        docs.withColumn("origin", F.col("source")), carry=(*carried, "origin")
    )
    rounds = F.array(*(_round(turn) for turn in range(2)))
    taken = mixed.withColumn("run", F.explode(rounds)).where("run.to > run.from")
    whole = (F.col("run.from") == 0) & (F.col("run.to") == F.col("size"))
    # Only texts that are cut go to the function.
    part = mixing.word_range(F.when(~whole, F.col("text")), F.col("run.from"), F.col("run.to"))
    text = F.when(whole, F.col("text")).otherwise(part)
    return _counted(
        taken.select("doc_id", *carried, F.col("origin").alias("source"), text.alias("run_text"))
        .withColumn("text", F.col("run_text"))
        .select(*docs.columns)
    )


def _round(turn: int):
    """The shards' spans of one round follow each other, so they are one run."""
    own = F.filter("spans", lambda s: s["pass"] == turn)
    return F.struct(
        F.coalesce(F.array_min(F.transform(own, lambda s: s["from"])), F.lit(0)).alias("from"),
        F.coalesce(F.array_max(F.transform(own, lambda s: s["to"])), F.lit(0)).alias("to"),
    )


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` with the ids of each row, checked by decoding them again.

    A null text counts as empty. Every row is encoded, repeated ones and those without an id
    too. An empty table gives none.
    """
    pattern = registry.public_tokenizers.PATTERN
    ids = bpe.encode(docs, registry.VOCABULARY, pattern)
    return bpe.digests(bpe.decode(ids, registry.VOCABULARY))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

# SQL cannot state the language model, the similarity joins or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs, _ = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
