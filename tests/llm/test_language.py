"""Language evidence: held-out accuracy, plain Python and the cases without evidence."""

import math
import re
from collections import Counter, defaultdict

import pyspark.sql.functions as F
import pytest

from tenure.llm import langid, registry

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = langid.train(docs.where(fold == 0))
    held = registry.with_page(docs.where(fold == 1), spark.read.parquet(f"{FOLDER}/pages.parquet"))
    scored = held.withColumn("scores", langid.text_scores(F.col("text"), model))
    judged = langid.fuse(scored, model, langid.gather(scored, model)).toPandas()
    assert len(judged) > 400
    assert (judged["language"] == judged["lang"]).mean() >= 0.99
    assert judged["accepted"].mean() >= 0.99


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "Ολοι οι ανθρωποι γεννιουνται ελευθεροι και ισοι στην αξιοπρεπεια.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
    "Tutti gli esseri umani nascono liberi ed eguali in dignita e diritti.",
    "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08",
    "=-*#@ {}[] ;; || && %% $$ ^^ ~~ <> =-*#@ {}[] ;; || && %% $$",
    "xqzvk jwpfh gbtqx zzkvj qwxpd mfhtz kqjxv wzgpb vxqkj hzfwq",
]
CLEAN = [
    "All human beings are born free and equal in dignity and rights.",
    "Todos los seres humanos nacen libres e iguales en dignidad y derechos.",
    "Alle Menschen sind frei und gleich an Wuerde und Rechten geboren.",
    "Tous les etres humains naissent libres et egaux en dignite et en droits.",
]


def test_texts_in_none_of_the_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs)
    rows = [(i, t, None, None, None, 0) for i, t in enumerate(CLEAN + FOREIGN)]
    rows += [(100 + i, t, "xx", "xx", f"h{i}.xx", 0) for i, t in enumerate(FOREIGN)]
    got = {r.doc_id: r for r in judge(spark, rows, model)}
    assert [got[i].language for i in range(4)] == ["en", "es", "de", "fr"]
    assert all(got[i].accepted and got[i].probability > 0.9 for i in range(4))
    assert [r.text for i, r in got.items() if i >= 4 and r.accepted] == []
    # Nothing is learned from such rows, but their hosts are known.
    scored = spark.createDataFrame(rows, SCHEMA).withColumn(
        "scores", langid.text_scores(F.col("text"), model)
    )
    evidence = langid.gather(scored, model)
    assert evidence.declared.count() == evidence.suffix.count() == 0
    hosts = [r.host_log for r in evidence.host.collect()]
    assert len(hosts) == len(FOREIGN)
    assert all(abs(x - y) < 1e-9 for h in hosts for x, y in zip(h, evidence.overall, strict=True))


def test_unseen_trigrams_favour_no_language(spark):
    train = [("a", "the cat and the dog " * 50), ("b", "der hund")]
    model = langid.train(spark.createDataFrame(train, "lang string, text string"))
    unseen = model.log_share.min(axis=1)
    assert abs(unseen[0] - unseen[1]) < 1e-9


SCHEMA = "doc_id long, text string, declared string, suffix string, host string, extra int"


def judge(spark, rows, model):
    scored = spark.createDataFrame(rows, SCHEMA).withColumn(
        "scores", langid.text_scores(F.col("text"), model)
    )
    return langid.fuse(scored, model, langid.gather(scored, model)).collect()


def test_evidence_decides_where_the_text_does_not(spark):
    train = [("a", "the cat and the dog"), ("b", "der hund und die katze"), (None, "nothing")]
    model = langid.train(spark.createDataFrame(train, "lang string, text string"))
    assert model.languages == ("a", "b")
    rows = [(50 + i, "the cat and the dog", "x", "org", "h.one.org", 0) for i in range(40)]
    rows += [(100 + i, "der hund und die katze", "y", "de", "k.two.de", 0) for i in range(40)]
    rows += [
        (1, "zzz", "y", "de", "k.two.de", 0),
        (2, "zzz", "x", "org", "new.one.org", 0),
        (3, "", "x", "org", "h.one.org", 0),
        (4, None, None, None, None, 0),
        (5, "der hund und die katze", None, None, None, 0),
        (5, "der hund und die katze", None, None, None, 0),
        (None, "the the the", "unseen", "zz", "zz", 0),
    ]
    got = judge(spark, rows, model)
    assert len(got) == len(rows)
    odd = {r.doc_id: r for r in got if r.doc_id and r.doc_id < 10}
    assert odd[2].language == "a"
    assert not odd[3].accepted and not odd[4].accepted
    assert odd[5].language == "b" and odd[5].accepted
    by_text = [r for r in got if r.doc_id and r.doc_id >= 100]
    assert {r.language for r in by_text} == {"b"}
    assert [r.language for r in got if r.text == "zzz" and r.host == "k.two.de"] == ["b"]


def test_nothing_to_learn_or_judge(spark):
    empty = langid.train(spark.createDataFrame([], "lang string, text string"))
    got = judge(spark, [(1, "some text", None, None, None, 0)], empty)
    assert got[0].language is None and not got[0].accepted
    model = langid.train(spark.createDataFrame([("a", "text")], "lang string, text string"))
    assert judge(spark, [], model) == []


def told_by_page(docs, pages):
    """Declared language, suffix and host of every document, from its first page."""
    shown = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        host, path = re.match(r"(?:.*?://([^/?#]*)([^?#]*))?", r.url or "").groups("")
        number = re.search(r"/(\d{1,18})(?:\.\w+)?/?$", path)
        lang = re.search(r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", r.html or "")
        if number:
            shown.setdefault(int(number[1]), (lang and lang[1], host.lower()))
    out = []
    for r in docs:
        lang, host = shown.get(r.doc_id, (None, None))
        suffix = None if host is None else host.rsplit(".", 1)[-1]
        out.append((r.doc_id, r.text or "", lang, suffix, r.source if host is None else host))
    return out


def posterior(trained, rows):
    """The fused evidence one row at a time: (language, probability, accepted)."""

    def trigrams(text):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
        # The published multiplicative hash, to 14 bits.
        return Counter(
            (int.from_bytes(low[i : i + 3], "little") * 2_654_435_761 % 2**32) >> 18 for i in range(len(low) - 2)
        )

    counts = defaultdict(Counter)
    for lang, text in trained:
        if lang is not None:
            counts[lang].update(trigrams(text))
    names = sorted(counts)
    n, kinds = len(names), 2**14
    totals = {a: sum(counts[a].values()) for a in names}
    added = max(0.5 / min(totals.values()), 0.1 / kinds)

    def log_share(a, t):
        return math.log((counts[a][t] + totals[a] * added) / (totals[a] * (1 + added * kinds)))

    scored = []
    for _, text, declared, suffix, host in rows:
        own = trigrams(text)
        size = sum(own.values())
        weight = 1 / (1 + size / 100)
        by = [weight * sum(k * log_share(a, t) for t, k in own.items()) for a in names]
        none = -weight * size * math.log(kinds)
        told = by.index(max(by)) if size and max(by) >= none else None
        scored.append((by, none, size, told, declared, suffix, host))
    seen = [sum(r[3] == i for r in scored) for i in range(n)]
    overall = [(c + 1) / (sum(seen) + n) for c in seen]

    def table(column):
        found = defaultdict(lambda: [0] * n)
        for r in scored:
            key = column(r)
            if r[2] and key is not None:
                own = found[key]
                if r[3] is not None:
                    own[r[3]] += 1
        return found

    def smoothed(own, towards):
        return [(c + 20 * p) / (sum(own) + 20) for c, p in zip(own, towards, strict=True)]

    def parent(host):
        return ".".join(host.split(".")[-2:])

    parents = table(lambda r: r[6] and parent(r[6]))
    hosts, of_declared, of_suffix = table(lambda r: r[6]), table(lambda r: r[4]), table(lambda r: r[5])

    def likelihood(found, key):
        own = found.get(key)
        if own is None or not sum(own):
            return [0.0] * (n + 1)
        each = [math.log((c + 0.5) / (of + 1)) for c, of in zip(own, seen, strict=True)]
        return [*each, math.log((sum(own) + 0.5 * n) / (sum(seen) + n))]

    out = []
    for by, none, size, _, declared, suffix, host in scored:
        prior = overall
        if host in hosts:
            prior = smoothed(hosts[host], smoothed(parents[parent(host)], overall))
        logs = [s + math.log(p) for s, p in zip(by, prior, strict=True)] + [none - math.log(n)]
        for found, key in ((of_declared, declared), (of_suffix, suffix)):
            logs = [x + y for x, y in zip(logs, likelihood(found, key), strict=True)]
        best = max(logs[:n])
        probability = 1 / sum(math.exp(x - best) for x in logs)
        accepted = size > 0 and probability >= 0.5 and best >= logs[n]
        out.append((names[logs.index(best)], probability, accepted))
    return out


def test_whole_query_against_plain_python(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    rows = told_by_page(docs, pages)
    assert sum(r[2] is not None for r in rows) > 20
    expected = dict(zip([r[0] for r in rows], posterior([(r.lang, r.text or "") for r in docs], rows), strict=True))
    got = registry.op9_language(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        language, probability, accepted = expected[r.doc_id]
        assert (r.language, r.accepted) == (language, accepted)
        assert r.probability == pytest.approx(probability, abs=1e-3)


def test_undecided_texts_against_plain_python(spark):
    """Short texts, for which host, suffix and declared language count."""
    trained = [("a", "the cat and the dog"), ("b", "der hund und die katze"), ("c", "le chat et le chien")]
    texts = ["the cat", "der hund", "le chien", "cat hund", "xyz", "", "zz", "und the le", "die dog"]
    rows = [
        (i, texts[i * 7 % 9], [None, "x", "y"][i % 3], [None, "org", "de"][i * i % 3], [None, "h.one.org", "k.one.org", "two.de"][i % 4])
        for i in range(200)
    ]
    model = langid.train(spark.createDataFrame(trained, "lang string, text string"))
    got = {r.doc_id: r for r in judge(spark, [(*r, 0) for r in rows], model)}
    shares = Counter()
    for r, (language, probability, accepted) in zip(rows, posterior(trained, rows), strict=True):
        own = got[r[0]]
        assert own.probability == pytest.approx(probability, abs=1e-4)
        assert (own.language, own.accepted) == (language, accepted) or abs(probability - 0.5) < 1e-4
        shares[language, accepted] += 1
    assert len(shares) >= 4
