"""URL rules and source mix against plain versions."""

import hashlib
import random
import re

import pytest

from twinledger.llm import mixing, url_filter
from twinledger.llm.url_filter import RULES

PAGES = "page_id long, url string, HOST string, rule int, _url string"


def plain_verdict(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(1)
    parts = ["org", "com", "example", "a", "www", "", "EXAMPLE", "Org", "fr", "net"]
    made = [None, "", "x", "://", "http://", "http://org", "http://org/", "mailto:a@b.org", "http://ORG?x=http://a.com/fr/1", "a://b://org/",
            "http://example.org/en/1", "http://example.org/en/19", "http://Example.ORG/es", "http://notexample.org/es/", "http://é.com/fr/é?q#z",
            "http://a.com#/fr/", "http://user@com/de/", "http://org:80/"]
    for _ in range(300):
        host = ".".join(rng.choices(parts, k=rng.randrange(1, 5)))
        made.append("https://" + host + rng.choice(["", "/", "/en/1", "/en/2", "/es/", "/fr/x", "/de/?a", "?/de/", "/ES/"]))
    return made + made[:40]


@pytest.mark.parametrize("rules, default", [(RULES, "allow"), ((), "block"), ((("block", "org", ""), ("allow", "org", ""), ("allow", "example.org", "/")), "allow")])
def test_verdicts(spark, rules, default):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "h", 1, "u") for i, u in rows], PAGES).repartition(3)
    found = {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in url_filter.judge(pages, rules, default).collect()}
    if ("allow", "org", "") in rules:
        rules = [r for r in rules if r != ("allow", "org", "")]
    assert found == {i: plain_verdict(u, rules, default) for i, u in rows}


def test_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, SIZE int, _at string"


def plain_targets(sizes, weights, cap):
    """Water-filling by rounds, as it is told."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, shares = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / shares > cap * sizes[s] + 1e-9]
        if not above:
            return {s: fixed.get(s, 0) if s in fixed else rest * weight[s] / shares for s in names}
        fixed.update({s: cap * sizes[s] for s in above})


def documents(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 5 + ["a", "B", "é", "", None, "rare"] + (["tiny"] if i % 60 == 0 else []))
        text = None if i % 50 == 0 else " ".join(["w"] * rng.choice([0, 1, 5, 30, 400]))
        rows.append((i, text, "en", source, 0, 1, "x"))
    return rows + [rows[1], rows[2], (None, "no id", None, "a", None, None, None), (500, " \t", None, "blank", 1, 1, "")]


@pytest.mark.parametrize("weights, cap", [((5, 2, 1), 3), ((1,), 3), ((1, 100), 2)])
def test_mix(spark, weights, cap):
    rows = documents(len(weights))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = mixing.mix(docs, weights, cap).collect()
    again = mixing.mix(docs.repartition(2), weights, cap).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    target = plain_targets(sizes, weights, cap)
    taken = {}
    for r in found:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= cap * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for source in sizes:  # the extra part is the first of the seeded order
        part = sorted((r for r in found if r.source == source and r.size and r.doc_id is not None),
                      key=lambda r: (hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest(), r.doc_id))
        extras = [r.extra >= r.size for r in part]
        assert extras == sorted(extras, reverse=True)


def test_mixed_documents(spark):
    docs = spark.createDataFrame(documents(3), DOCS)
    out = mixing.mixed_documents(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "SIZE", "_at"] or set(out.columns) <= set(docs.columns)
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, None, None)], DOCS)
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)]
