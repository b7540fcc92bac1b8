"""The pipeline's stages on their own inputs."""

import hashlib

import pytest

import corpus_pipeline as pipeline
from tenure.llm import bpe, registry
from tests.llm.test_similarity import expected_groups, expected_lines, words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {"documents": docs}
    for name, function in pipeline.STAGES:
        function(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    columns = stages["documents"].columns
    assert [stages[n].columns for n, _ in pipeline.STAGES[:-1]] == [columns] * 4


def test_languages_keep_clean_documents(stages):
    assert stages["language_id"].count() >= 0.99 * stages["documents"].count()


def test_lines(stages):
    given = texts(stages["language_id"])
    kept = expected_lines(given)
    expected = [
        (i, "\n".join(line for k, line in enumerate(t.split("\n")) if k in kept[i] or not words(line)))
        for i, t in given
        if kept[i] or not words(t)
    ]
    assert texts(stages["line_dedup"]) == expected


def test_one_of_each_group(stages):
    groups = expected_groups(texts(stages["line_dedup"]))
    assert [i for i, _ in texts(stages["ngram_join"])] == sorted(
        i for i, (_, head) in groups.items() if i == head
    )


def test_mix(spark, stages):
    given = dict(texts(stages["ngram_join"]))
    taken = {}
    for i, text in texts(stages["source_mix"]):
        taken[i] = taken.get(i, 0) + len(words(text))
        # Cut, but otherwise as it was, with its line breaks.
        assert text in given[i]
    from tenure.llm import mixing

    expected = {r.doc_id: r.taken for r in mixing.mix(stages["ngram_join"]).collect() if r.taken}
    assert taken == expected


def test_word_ranges(spark):
    from pyspark.sql import functions as F

    from tenure.llm import mixing

    text = "  eins\tzwei\n\ndrei \u00a0vier  fünf "
    rows = [(text, 0, 5), (text, 1, 3), (text, 2, 2), (text, 4, 99), (text, 7, 9), (None, 0, 1), ("", 0, 1)]
    table = spark.createDataFrame(rows, "t string, a int, b int")
    got = [r[0] for r in table.select(mixing.word_range(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == ["eins\tzwei\n\ndrei \u00a0vier  fünf", "zwei\n\ndrei", "", "fünf", "", None, ""]


def test_empty_table_and_missing_values(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", None, None, 0), (1, "", "en", "s", 0), (1, None, "en", "", 0)],
        docs.schema,
    )
    for given in (docs.limit(0), odd):
        for name, function in pipeline.STAGES:
            assert function(spark, given, FOLDER).count() <= given.count(), name


def test_tokens(stages):
    library = bpe.encoding_of(registry.VOCABULARY, registry.public_tokenizers.PATTERN)
    expected = []
    for i, text in texts(stages["source_mix"]):
        ids = library.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        expected.append((i, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, stages["byte_bpe"].collect())) == sorted(expected)


def test_other_columns_are_left_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    more = docs.selectExpr("*", "1 host", "2 scores", "3 spans", "4 kept", "5 component_id", "6 size")
    for name, function in pipeline.STAGES[:-1]:
        got = function(spark, more, FOLDER)
        assert got.columns == docs.columns, name
        assert got.count() > 0


def test_one_of_each_group_whatever_the_ids(spark):
    def text(name, changed=None):
        own = [f"{name}{i}" for i in range(80)]
        return " ".join([*own[:79], changed or own[79]])

    given = [
        # Without ids: an exact copy, a near one, and a copy of a document with an id.
        (None, text("a")), (None, text("a")), (None, text("a", "x")), (None, text("b")), (7, text("b")),
        # One id with two texts: one is the head of its group, the other is not.
        (3, text("c")), (3, text("d")), (1, text("d")),
        # Near and exact copies under one id.
        (5, text("e")), (5, text("e", "x")), (5, text("e")),
        (None, " "), (None, " "), (8, None), (8, None), (9, None), (None, "alone"),
    ]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(3)
    got = [(r.doc_id, r.text) for r in pipeline.ngram_join(spark, docs, FOLDER).collect()]
    fixed = [(7, text("b")), (3, text("c")), (1, text("d")), (None, " "), (8, None), (9, None), (None, "alone")]
    assert all(got.count(row) == 1 for row in fixed)
    rest = [row for row in got if row not in fixed]
    assert len(rest) == 2
    assert {i for i, _ in rest} == {None, 5}
    assert {t.split()[0] for _, t in rest} == {"a0", "e0"}
