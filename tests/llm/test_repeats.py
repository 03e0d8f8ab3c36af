"""Repeated passages against a plain search for equal windows."""

import hashlib
import random

import numpy as np
import pytest

from twinledger.llm import substring_dedup as sub
from twinledger.llm.scratch import reachable
from twinledger.llm.words import mix, word_hashes

SCHEMA = "doc_id long, text string, lang string, kept_text string, _keys int"


def plain(rows, window):
    """Words, kept words of every row; earlier is a smaller doc_id, or an earlier start in the row."""
    first = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i:i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words, own, gone = (text or "").encode().split(), set(), set()
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            key = tuple(words[i:i + window])
            if first[key] < doc_id or key in own:
                gone.update(range(i, i + window))
            own.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Éa", "c.", "d", "x" * 40] + [f"w{i}" for i in range(300)]

    def some(n, few=False):
        return rng.choices(vocabulary[:3] if few else vocabulary, k=n)

    passages = [some(rng.randrange(15, 90)) for _ in range(4)]
    made = []
    for _ in range(60):
        words = some(rng.randrange(0, 80), rng.random() < 0.1)
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a:a + rng.randrange(len(p))] + some(rng.randrange(30))
        made.append(rng.choice([" ", "\n", " \t "]).join(words))
    return made + [made[3], made[5], "a " * 100, "a " * 130, "a b " * 40, "b a " * 30, "", " \n", None]


@pytest.mark.parametrize("seed, window", [(1, 20), (2, 20), (3, 5), (4, 8)])
def test_against_plain_search(spark, seed, window):
    found = texts(seed)
    order = list(range(len(found)))
    random.Random(seed).shuffle(order)
    rows = list(zip(order, found)) + [(order[0], found[0]), (None, found[1]), (None, None)]
    docs = reachable(spark).createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA).repartition(4)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sub.digests(docs, window).collect()], key=repr)
    assert got == plain(rows, window)
    assert sum(r[2] for r in got) > 100


def test_long_text_in_parts_and_blocks(spark, monkeypatch):
    words = [f"w{i % 97} v{i % 89}" for i in range(3000)]
    long = " ".join(words)
    names, _ = word_hashes([long.encode()])
    whole = sub.window_keys(names, 20)
    monkeypatch.setattr(sub, "_WORDS", 700)
    assert np.array_equal(sub.text_keys(names, 20), whole)


def test_equal_windows_have_equal_keys():
    rng = random.Random(9)
    for _ in range(150):
        names = mix(np.arange(1, 1 + rng.choice([1, 2, 3, 10, 1000]), dtype=np.uint64))
        some = lambda n: np.array([rng.choice(names) for _ in range(n)], np.uint64)
        one = some(rng.randrange(20, 200))
        a = rng.randrange(len(one) - 19)
        other = np.concatenate([some(rng.randrange(60)), one[a:a + rng.randrange(20, 90)], some(rng.randrange(60))])
        keys = {}
        for names_of in (one, other):
            for i, k in enumerate(sub.window_keys(names_of, 20)):
                assert keys.setdefault(names_of[i:i + 20].tobytes(), k) == k


def test_nothing(spark):
    assert sub.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, "a  b\nc", None, None, None), (2, None, None, None, None)], SCHEMA)
    assert sorted((r.doc_id, r.kept_text, r.n_removed, r.lang) for r in sub.remove_repeats(few).collect()) == [
        (1, "a b c", 0, None), (2, "", 0, None)]


def test_lone_documents_that_repeat_themselves(spark):
    """Every period by itself: no other document holds any of its words."""
    rows = [(p, " ".join(f"w{p}.{i % p}" for i in range(100)), "en", "x", 1) for p in range(1, 21)]
    docs = reachable(spark).createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sub.digests(docs).collect()], key=repr)
    assert got == plain([r[:2] for r in rows], 20)
    assert all(r[2] == 100 - r[0] for r in got)


def test_anchors_of_long_texts(monkeypatch):
    names, at = word_hashes([" ".join(f"w{i % 7}" for i in range(100)).encode()] * 2)
    keys, places = sub.window_anchors(names[:100], 20)
    monkeypatch.setattr(sub, "_WORDS", 60)
    text, start, key, place = sub.batch_keys(names, at, 20)
    for t in (0, 1):
        assert np.array_equal(start[text == t], np.arange(81))
        assert np.array_equal(key[text == t], keys) and np.array_equal(place[text == t], places)
