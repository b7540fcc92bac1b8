"""Rules, templates and verdicts of addresses."""

import math
import random

import pytest

from tenure.llm import registry, urltree

PAGES = "page_id long, url string, html string, host string"
LABELS = "page_id long, bad boolean"


def judged(spark, pages, labels=()):
    table = spark.createDataFrame([(i, u, "h", "clash") for i, u in pages], PAGES)
    marks = spark.createDataFrame(list(labels), LABELS)
    return {r.page_id: r for r in urltree.judge(table, marks, registry.RULES).collect()}


def test_parts_and_rules(spark):
    got = judged(
        spark,
        [
            (1, "http://A.Example.ORG/es/x?q#f"),
            (2, "https://example.org/en/12"),
            (3, "https://example.org/en/2"),
            (4, "http://x.com/fr/1"),
            (5, "http://x.com/de/1"),
            (6, "http://x.net/de/1"),
            (7, None),
            (8, "no scheme/org/"),
            (9, "http://notexample.org"),
            (10, "http://badorg/"),
            (11, "://org/a://b/"),
            (12, "http://x.com?/fr/"),
            (None, "http://org/"),
            (13, ""),
        ],
    )
    rule = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert rule[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert rule[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert rule[3] == ("example.org", "/en/2", "org/", "allow")
    assert rule[4] == ("x.com", "/fr/1", "com/fr/", "allow")
    assert rule[5] == ("x.com", "/de/1", "com/de/", "block")
    assert rule[6] == ("x.net", "/de/1", None, "allow")
    assert rule[7] == rule[8] == rule[13] == ("", "", None, "allow")
    assert rule[9] == ("notexample.org", "", None, "allow")
    assert rule[10] == ("badorg", "/", None, "allow")
    assert rule[11] == ("org", "/a://b/", "org/", "allow")
    assert rule[12] == ("x.com", "", None, "allow")
    assert rule[None] == ("org", "/", "org/", "allow")


def test_bad_branch_is_told_apart(spark):
    pages = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(200)]
    pages += [(1000 + i, f"http://h.net/rare{i}/a/b/c/d/e") for i in range(3)]
    labels = [(i, i % 2 == 1) for i in range(120)] + [(0, False), (2, None), (None, True)]
    got = judged(spark, pages, labels)
    assert got[1].template == "/spam/*" and got[0].template == "/news/*"
    assert got[199].verdict == "block" and got[198].verdict == "allow"
    assert got[1000].template == "/*/*/*/*/*/*"


def test_similar_branches_are_merged(spark):
    pages = [(i, f"http://h.net/{'ab'[i % 2]}/{i}") for i in range(200)]
    got = judged(spark, pages, [(i, i % 4 < 2) for i in range(200)])
    assert {r.template for r in got.values()} == {"/*/*"}


def test_branches_at_any_depth(spark):
    kinds = ("spam", "news")
    pages = [(i, f"http://h.net/a/b/c/d/{kinds[i % 2]}/{i}") for i in range(200)]
    got = judged(spark, pages, [(i, i % 2 == 0) for i in range(200)])
    assert {(r.template, r.verdict) for r in got.values()} == {
        ("/*/*/*/*/spam/*", "block"), ("/*/*/*/*/news/*", "allow")
    }


def test_frequent_segments_with_digits(spark):
    kinds = ("web3", "top10")
    pages = [(i, f"http://h.net/{kinds[i % 2]}/{i}") for i in range(200)]
    got = judged(spark, pages, [(i, i % 2 == 0) for i in range(200)])
    assert {(r.template, r.verdict) for r in got.values()} == {("/web3/*", "block"), ("/top10/*", "allow")}


def test_extensions_of_variable_segments(spark):
    kinds = ("php", "html")
    pages = [(i, f"http://h.net/{i}.{kinds[i % 2]}") for i in range(200)]
    got = judged(spark, pages, [(i, i % 2 == 0) for i in range(200)])
    assert {(r.template, r.verdict) for r in got.values()} == {("/*.php", "block"), ("/*.html", "allow")}


def extension(segment):
    _, dot, end = segment.rpartition(".")
    return "." + end if dot and 0 < len(end) < 6 and end.isascii() and end.isalpha() else ""


def apart(branch, node):
    n, labelled, bad = len(branch), sum(b is not None for _, b in branch), sum(bool(b) for _, b in branch)
    all_labelled, all_bad = sum(b is not None for _, b in node), sum(bool(b) for _, b in node)
    others = all_labelled - labelled
    if n < urltree.MIN_PAGES or not labelled or not others:
        return False
    pooled = all_bad / all_labelled
    gap = abs(bad / labelled - (all_bad - bad) / others)
    return gap > urltree.Z * math.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / others))


def grown(node, level=0):
    """Templates of the paths of a node, (segments, bad), by plain recursion."""
    found, branches, open_ = {}, {}, []
    for path, bad in node:
        if len(path) == level:
            found[path] = ""
        else:
            open_.append((path, bad))
            branches.setdefault(path[level], []).append((path, bad))
    steps = {s: "/" + s for s, b in branches.items() if apart(b, node)}
    alike = {}
    for segment, branch in branches.items():
        if segment not in steps and extension(segment):
            alike.setdefault(extension(segment), []).extend(branch)
    kept = {e for e, b in alike.items() if apart(b, node)}
    children = {}
    for path, bad in open_:
        own = extension(path[level])
        step = steps.get(path[level], "/*" + own if own in kept else "/*")
        children.setdefault(step, []).append((path, bad))
    for step, child in children.items():
        found |= {path: step + rest for path, rest in grown(child, level + 1).items()}
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_tree(spark, seed):
    draw = random.Random(seed)
    pages, labels, hosts = [], [], {}
    names = ["", "a", "v2", "spam", "news", "x.php", "y.html"]
    for i in range(3000):
        host = draw.choice(["one.net", "two.net", "two.net"])
        path = [draw.choice(names) if draw.random() < 0.8 else f"{i}.{draw.choice(['php', 'gif'])}" for _ in range(draw.randrange(7))]
        likely = 0.9 if "spam" in path[2:] or path[:1] == ["v2"] else 0.3 if path and path[-1].endswith("php") else 0.05
        bad = draw.random() < likely if draw.random() < 0.7 else None
        pages.append((i, f"http://{host}/" + "/".join(path) + draw.choice(["", "/", "?q"])))
        labels += [(i, bad)] * (bad is not None)
        hosts.setdefault(host, []).append((i, tuple(s for s in path if s), bad))
    got = judged(spark, pages, labels)
    marks = [b for _, b in labels]
    whole = (sum(marks) + 0.5 * urltree.PRIOR) / (len(marks) + urltree.PRIOR)
    for rows in hosts.values():
        template = grown([(p, b) for _, p, b in rows])
        own = [b for _, _, b in rows if b is not None]
        prior = (sum(own) + urltree.PRIOR * whole) / (len(own) + urltree.PRIOR)
        assert len(set(template.values())) > 5
        for i, path, _ in rows:
            assert got[i].template == template[path]
        for name in set(template.values()):
            ids = [(i, b) for i, p, b in rows if template[p] == name]
            known = [b for _, b in ids if b is not None]
            right = (sum(known) + urltree.PRIOR * prior) / (len(known) + urltree.PRIOR)
            for i, _ in ids:
                assert got[i].bad_share == pytest.approx(right)
                assert got[i].verdict == ("block" if right > urltree.BLOCK_AT else "allow")


def test_no_pages(spark):
    assert judged(spark, []) == {}


def test_no_python_in_the_plan(spark, capsys):
    df = registry.op6_url_templates(spark, "/root/testdata/sf0.001")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoop" not in plan
    assert df.count() == 50
