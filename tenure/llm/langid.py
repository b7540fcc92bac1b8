"""Languages of texts by Bayesian fusion of four kinds of evidence.

The likelihood of the text under each language comes from its byte trigrams; the
declared markup language and the suffix of the address have a likelihood each; the host
contributes a prior, smoothed towards its parent domain, which is smoothed towards all
rows. All tables are grouped counts over all rows: those of trigrams over the labelled
texts, the others over what the text alone says. Missing evidence contributes nothing.

One more hypothesis is that the text is in none of the languages: all trigrams are
equally likely then. A text that this explains better is rejected and counts in no table.

Neighbouring trigrams tell nearly the same, so a text's log likelihood is weighed down
to that of at most ``INDEPENDENT`` trigrams; otherwise nothing else would ever count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.hashing import BLOCK, LOWER, bytes_of

# Hashed trigrams. The model is a table of languages by these, held by every task.
FEATURES = 1 << 14
INDEPENDENT = 100.0
# Trigrams added to a language, spread evenly, as a share of its total at least; all have the
# same share, so unseen trigrams favour none.
ADDED = 0.1
# Rows that a parent counts for in the prior of a domain or host.
PRIOR = 20.0
# Probability of the best language below which a text is rejected.
ACCEPT_AT = 0.5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_share: np.ndarray  # languages by FEATURES


def _features(data: np.ndarray) -> np.ndarray:
    low = LOWER[data].astype(np.uint32)
    three = low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))
    return (three * np.uint32(2_654_435_761)) >> np.uint32(32 - 14)


def trigrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, trigram numbers) in blocks of bounded size, each of one string."""
    data, at = bytes_of(column)
    for row in range(len(column)):
        for begin in range(at[row], at[row + 1] - 2, BLOCK):
            yield row, _features(data[begin : min(begin + BLOCK + 2, at[row + 1])])


def train(texts: DataFrame, label_col: str = "lang", text_col: str = "text") -> Model:
    """Shares of the trigrams in each language, over all texts with a label."""

    def count(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in given:
            labels = batch["label"].to_pylist()
            for row, found in trigrams(batch["text"]):
                own = counts.setdefault(labels[row], np.zeros(FEATURES, np.int64))
                own += np.bincount(found, minlength=FEATURES)
        for label, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(used)), pa.array(used), pa.array(own[used])],
                names=["label", "feature", "n"],
            )

    labelled = texts.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    found = (
        labelled.where(F.col("label").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(count, "label string, feature long, n long")
        .groupBy("label", "feature")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = tuple(sorted(set(found["label"].to_pylist())))
    table = np.zeros((len(languages), FEATURES))
    place = {name: i for i, name in enumerate(languages)}
    rows = [place[name] for name in found["label"].to_pylist()]
    table[rows, found["feature"].to_numpy()] += found["n"].to_numpy()
    if languages:
        total = table.sum(axis=1, keepdims=True)
        # Half a trigram of each kind for the language with the fewest, if that is more.
        table += total * max(0.5 / total.min(), ADDED / FEATURES)
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def text_scores(text: Column, model: Model) -> Column:
    """A weighed log likelihood per language, that of none of them and, last, the number of
    trigrams."""
    shares = model.log_share.T.astype(np.float32)
    width = shares.shape[1] + 2

    @F.arrow_udf("array<double>")
    def score(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), width))
        for row, found in trigrams(column):
            out[row, :-2] += shares[found].sum(axis=0, dtype=np.float64)
            out[row, -1] += len(found)
        n = out[:, -1:]
        out[:, -2:-1] = -np.log(FEATURES) * n
        out[:, :-1] *= 1 / (1 + n / INDEPENDENT)
        offsets = np.arange(0, out.size + 1, width, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))

    return score(text)


def _best(scores: Column, n: int) -> Column:
    values = F.slice(scores, 1, n)
    return F.array_position(values, F.array_max(values)).cast("int")


def _counts(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Per value of ``key`` how many rows the text alone puts in each language, zeros where
    it puts none in any."""
    each = F.array(*(F.count_if(F.col("best") == i + 1).cast("double") for i in range(n)))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(each.alias(name))


@dataclass(frozen=True)
class Evidence:
    """Log likelihoods per declared language and suffix, last under none of the languages,
    and log priors per host."""

    declared: DataFrame
    suffix: DataFrame
    host: DataFrame
    overall: list[float]


def parent_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def gather(scored: DataFrame, model: Model) -> Evidence:
    """Evidence tables from ``scores``, ``declared``, ``suffix`` and ``host`` of all rows. A
    row whose text is in none of the languages shows only that its host is there."""
    n = len(model.languages)
    told = F.array_max(F.slice("scores", 1, n)) >= F.element_at("scores", -2)
    rows = scored.where(F.element_at("scores", -1) > 0).select(
        F.when(told, _best(F.col("scores"), n)).otherwise(0).alias("best"),
        "declared", "suffix", "host",
        parent_of(F.col("host")).alias("parent"),
    )
    counted = [F.count_if(F.col("best") == i + 1) for i in range(n)]
    seen = np.array(rows.agg(F.count(F.lit(1)), *counted).first()[1:], float)
    overall = (seen + 1) / (seen.sum() + max(n, 1))

    def likelihood(key: str) -> DataFrame:
        # Half a row more for each value and language, so that nothing is impossible.
        table = _counts(rows.where("best > 0"), key, n, "c")
        given = F.array(*(F.lit(float(x) + 1.0) for x in seen))
        share = F.zip_with("c", given, lambda c, of: F.log((c + 0.5) / of))
        # Under none of the languages a value is as frequent as in all rows.
        every = F.aggregate("c", F.lit(0.5 * n), lambda a, x: a + x) / float(seen.sum() + max(n, 1))
        share = F.concat(share, F.array(F.log(every)))
        return table.select(key, share.alias(f"{key}_log"))

    def smoothed(counts: Column, towards: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, towards, lambda c, p: (c + PRIOR * p) / (total + PRIOR))

    parents = _counts(rows, "parent", n, "c").select(
        "parent", smoothed(F.col("c"), F.array(*map(F.lit, map(float, overall)))).alias("p")
    )
    hosts = (
        _counts(rows, "host", n, "c")
        .withColumn("parent", parent_of(F.col("host")))
        .join(parents, "parent")
        .select(
            "host",
            F.transform(smoothed(F.col("c"), F.col("p")), lambda p: F.log(p)).alias("host_log"),
        )
    )
    return Evidence(
        likelihood("declared"), likelihood("suffix"), hosts, [float(x) for x in np.log(overall)]
    )


def fuse(
    scored: DataFrame, model: Model, evidence: Evidence, accept_at: float = ACCEPT_AT
) -> DataFrame:
    """Adds ``language``, ``probability`` and ``accepted`` to rows with ``scores``, ``declared``,
    ``suffix`` and ``host``, all under exactly these names.

    A text without a trigram is rejected, as is one whose best language has a probability
    below ``accept_at`` or below that of none of the languages, which has the prior of an
    average one. Such a row names its best language all the same. Ties go to the first
    language by name.
    """
    n = len(model.languages)
    if not n:
        return scored.withColumns({
            "language": F.lit(None).cast("string"), "probability": F.lit(0.0), "accepted": F.lit(False)
        })
    nothing = F.array(*[F.lit(0.0)] * (n + 1))
    known = F.coalesce("host_log", F.array(*map(F.lit, evidence.overall)))
    prior = F.concat(known, F.array(F.lit(-float(np.log(n)))))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    logs = plus(
        plus(F.slice("scores", 1, n + 1), prior),
        plus(F.coalesce("declared_log", nothing), F.coalesce("suffix_log", nothing)),
    )
    best = F.array_max(F.slice("logs", 1, n))
    weights = F.aggregate("logs", F.lit(0.0), lambda total, x: total + F.exp(x - best))
    names = F.array(*map(F.lit, model.languages))
    return (
        scored.join(evidence.host, "host", "left")
        .join(evidence.declared, "declared", "left")
        .join(evidence.suffix, "suffix", "left")
        .withColumn("logs", logs)
        .withColumn("probability", 1 / weights)
        .withColumn("language", F.element_at(names, _best(F.col("logs"), n)))
        .withColumn(
            "accepted",
            (F.element_at("scores", -1) > 0)
            & (F.col("probability") >= accept_at)
            & (best >= F.element_at("logs", -1)),
        )
        .drop("logs", "host_log", "declared_log", "suffix_log")
    )
