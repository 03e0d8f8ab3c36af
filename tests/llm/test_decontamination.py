"""Hits of benchmark windows against a plain search, and what is left of the texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from twinledger.llm import decontamination as dec
from twinledger.llm.scratch import reachable

DOCS = "doc_id long, text string, N_WORDS int, items string, lang string"
ITEMS = "item_id long, text string, lang string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, size):
    windows = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for length in range(1, size + 1):
            for i in range(len(words) - length + 1):
                if (window := tuple(words[i:i + length])) in windows:
                    hit.update(range(i, i + length))
                    found |= windows[window]
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Éa", "x1", "日本", "ÀB"] + [f"w{i}" for i in range(60)]

    def some(n):
        return rng.choices(vocabulary, k=n)

    passages = [some(rng.randrange(1, 40)) for _ in range(12)]
    items = [(i, rng.choice([" ", ", ", "--"]).join(p)) for i, p in enumerate(passages)]
    items += [(3, "further row of item three with other words in it now"), (None, " ".join(some(14))), (20, None), (21, "?!"), (22, items[2][1]), (22, items[2][1]),
              (100, "Lone"), (9, items[0][1] + " and more words behind it")]
    docs = []
    for _ in range(60):
        words = some(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            p = words_of(rng.choice(items)[1])
            words += [w.upper() if w.isascii() else w for w in p[rng.randrange(3):]] + some(rng.randrange(20))
        docs.append(rng.choice([" ", "\n* ", "_"]).join(words))
    return list(enumerate(docs)) + [(5, docs[5]), (None, docs[6]), (None, None), (70, ""), (71, "lone"), (72, "a lone-wolf LONE")], items


def frames(spark, docs, items):
    reachable(spark)
    return (spark.createDataFrame([(i, t, 1, "i", "en") for i, t in docs], DOCS).repartition(3),
            spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS).repartition(2))


@pytest.mark.parametrize("seed, size", [(1, 10), (2, 10), (3, 4), (4, 1)])
def test_against_plain_search(spark, seed, size):
    docs, items = tables(seed)
    got = sorted([tuple(r) for r in dec.digests(*frames(spark, docs, items), size).collect()], key=repr)
    assert got == plain(docs, items, size)
    assert sum(r[5] for r in got) > 20


def test_benchmark_in_parts(spark):
    docs, items = tables(5)
    known = frames(spark, docs, items)
    key = lambda r: repr(tuple(r))
    whole = sorted(dec.scan(*known).collect(), key=key)
    assert sorted(dec.scan(*known, most_bytes=900).collect(), key=key) == whole
    assert dec.scan(*known).columns == ["doc_id", "text", "lang", "n_words", "hit_spans", "items"]


def test_equal_hashes_of_unlike_windows(monkeypatch):
    """Verified word by word: with one hash for all windows the result is the same."""
    docs, items = tables(6)
    monkeypatch.setattr(dec, "run_hashes", lambda hashes, length, odd: np.full(max(0, len(hashes) - length + 1), 7, np.uint64))
    found = [(None if i is None else str(i), " ".join(words_of(t)).encode()) for i, t in items if words_of(t)]
    texts = [dec.normalised(t) for _, t in docs]
    got = [(d[0], n, int(hit.sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit.any()))
           for d, (n, hit, ids) in zip(docs, dec.hits(dec.hash_set(found, 10), texts))]
    assert sorted(got, key=repr) == plain(docs, items, 10)


def test_long_items_in_pieces(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{rng.randrange(4000)}" for _ in range(30_000)]
    docs = [(1, " ".join(words[8180:8200])), (2, " ".join(words[100:5000])), (3, "x " * 50), (4, " ".join(words))]
    docs, items = frames(spark, docs, [(1, " ".join(words))])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in dec.digests(docs, items).collect()}
    assert got == {1: (20, 20, 1), 2: (4900, 4900, 1), 3: (50, 0, 0), 4: (30_000, 30_000, 1)}


def test_what_is_left(spark):
    docs = [(1, "Before: one, TWO three -- after."), (2, "clean  text "), (3, None), (4, "one two three"), (5, "é one two three one two three ü, one two")]
    known = frames(spark, docs, [(1, "one two three")])
    left = {r.doc_id: (r.text, r.lang) for r in dec.decontaminate(*known).collect()}
    assert left == {1: ("Before:  -- after.", "en"), 2: ("clean  text ", "en"), 3: (None, "en"), 4: ("", "en"), 5: ("é  ü, one two", "en")}
    whole = dec.decontaminate(*known, remove="documents")
    assert sorted((r.doc_id, r.text) for r in whole.collect()) == [(2, "clean  text "), (3, None)]
    with pytest.raises(ValueError):
        dec.decontaminate(*known, remove="words")


def test_nothing(spark):
    docs, items = tables(8)
    full_docs, full_items = frames(spark, docs, items)
    none_docs, none_items = frames(spark, [], [])
    assert dec.digests(none_docs, full_items).count() == 0
    assert {(r.n_hit, r.n_items, r.contaminated) for r in dec.digests(full_docs, none_items).collect()} == {(0, 0, False)}
