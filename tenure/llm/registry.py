"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import bpe, chat, hilbert, langid, lines, merkle, mixing, ngrams, onebit, oracles, passages, pivots, urltree, whitening
from tenure.llm.common import cut, n_bytes, read

RULES = (
    urltree.Rule("org/", True),
    urltree.Rule("example.org/es/", False),
    urltree.Rule("example.org/en/1", False),
    urltree.Rule("com/fr/", True),
    urltree.Rule("com/de/", False),
)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pivot_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return pivots.near_duplicates(read(spark, folder, "embeddings"))


def op2_one_bit_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every 20th embedding among all others."""
    return onebit.search(read(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op3_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards along a curve over language, source, size and id."""
    rows = read(spark, folder, "documents").select(
        "doc_id",
        (n_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        "lang",
        "source",
    )
    dims = {
        "lang": F.col("lang"),
        "source": F.col("source"),
        "size": F.col("size"),
        "doc_id": F.col("doc_id"),
    }
    return hilbert.shards(rows, dims, tie=["text_crc32", "doc_id"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the numbers of the lines that no earlier line is similar to."""
    docs = read(spark, folder, "documents")
    kept = lines.kept_lines(docs)
    own = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    joined = own.join(
        kept, own["doc_id"].eqNullSafe(kept["id"]) & (own["hash"] == kept["content"]), "left"
    )
    return joined.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("kept", F.array().cast("array<int>")).alias("kept_lines"),
        (F.coalesce("n_lines", F.lit(0)) - F.coalesce(F.size("kept"), F.lit(0))).alias("n_removed"),
    )


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its shingles and the group of near-duplicates that it is in."""
    return ngrams.near_duplicates(read(spark, folder, "documents"))


def shown_document(url: Column) -> Column:
    """The document that a page of these tables shows; its address has the id."""
    _, path = urltree.host_and_path(url)
    return F.regexp_extract(path, r"/(\d{1,18})(?:\.\w+)?/?$", 1).try_cast("long")


def op6_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict for every page's address, by rules and by the labels of like addresses."""
    pages = read(spark, folder, "pages")
    labels = read(spark, folder, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    shown = pages.select("page_id", shown_document(F.col("url")).alias("doc_id"))
    return urltree.judge(pages, shown.join(labels, "doc_id").select("page_id", "bad"), RULES)


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Per document a digest of its token ids, and of what they decode to."""
    ids = bpe.encode(read(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(ids, VOCABULARY))


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(read(spark, folder, "documents")).drop("spans")


def with_page(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``docs`` with ``declared``, ``suffix`` and ``host`` of the page that shows them, the
    first by id; the source stands for the host of a document without a page."""
    host, _ = urltree.host_and_path(F.col("url"))
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1)
    seen = (
        pages.select(
            shown_document(F.col("url")).alias("doc_id"),
            F.struct(
                "page_id", F.nullif(declared, F.lit("")).alias("declared"), host.alias("host")
            ).alias("page"),
        )
        .where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("page").alias("page"))
    )
    return docs.join(seen, "doc_id", "left").select(
        *docs.columns,
        F.col("page.declared").alias("declared"),
        F.substring_index("page.host", ".", -1).alias("suffix"),
        F.coalesce("page.host", "source").alias("host"),
    )


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document by text, page and host together."""
    docs = read(spark, folder, "documents")
    model = langid.train(docs)
    slim = docs.select("doc_id", "source", langid.text_scores(F.col("text"), model).alias("scores"))
    scored = cut(with_page(slim, read(spark, folder, "pages")))
    return langid.fuse(scored, model, langid.gather(scored, model)).select(
        "doc_id", "language", "probability", "accepted"
    )


# A conversation that holds the marks of another template.
MARKED = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one of our own, as read back from its formatted turns."""
    record = {"id": -7, "messages": [{"role": r, "content": MARKED} for r in ("user", "assistant")]}
    one = spark.range(1).select(F.lit(json.dumps(record)).alias("record"))
    turns = chat.turns_of_table(read(spark, folder, "conversations")).unionByName(
        chat.turns_of_records(one, "record")
    )
    return chat.read_back(chat.format_turns(turns))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings along their first eight whitened components."""
    return whitening.whiten(read(spark, folder, "embeddings"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 50 words and more that a document before it
    has, too: how many words go, and a digest of those that stay."""
    return passages.without_repeats(read(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's proof, its digest, and whether the text as it is now leads to the
    root: one in five has been put into lower case."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    now = F.when(tampered, F.translate("text", upper, lower)).otherwise(F.col("text"))
    fields = [now if name == "text" else F.col(name) for name in merkle.FIELDS]
    proved = merkle.proofs(
        read(spark, folder, "documents"), carry={"now": merkle.leaf_hash(fields)}
    )
    return proved.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.digest(F.col("segments")).alias("proof_sha256"),
        merkle.fold(F.col("now"), F.col("segments")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_near_dup": op1_pivot_near_dup,
        "op2_one_bit_search": op2_one_bit_search,
        "op3_hilbert_shards": op3_hilbert_shards,
        "op4_line_dedup": op4_line_dedup,
        "op5_ngram_join": op5_ngram_join,
        "op6_url_templates": op6_url_templates,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_source_mix": op8_source_mix,
        "op9_language": op9_language,
        "op10_chat_format": op10_chat_format,
        "op11_whitening": op11_whitening,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
