"""Runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from twinledger.llm import periodic_runs as pr
from twinledger.llm.scratch import reachable
from twinledger.llm.words import word_hashes

SCHEMA = "doc_id long, text string, RUNS int, n_words string, lang string"


def plain_runs(words, least_words=24, least_turns=3):
    """Every maximal stretch of every period, if that is its least."""
    n, found = len(words), []
    for p in range(1, n // least_turns + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least_words, least_turns * p) and not any(
                    all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                found.append((i, length, p))
            i = j + 1 if j == i else j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, least_words=24, least_turns=3, planted=False):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, least_words, least_turns)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts(seed):
    rng = random.Random(seed)
    made = []
    for _ in range(60):
        vocabulary = [f"é{i}" for i in range(rng.choice([1, 2, 2, 3, 5, 40]))]
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(4)):
            unit = rng.choices(vocabulary, k=rng.randrange(1, 14))
            words += (unit * rng.randrange(2, 12))[:rng.randrange(1, 90)] + rng.choices(vocabulary, k=rng.randrange(9))
        made.append(rng.choice([" ", "\n", " \t "]).join(words))
    fib, last = ["a", "b"], ["a"]
    while len(fib) < 300:
        fib, last = fib + last, fib
    return made + [" ".join(fib), "a " * 300, "a b " * 12, "a b " * 11 + "a", ("x " * 24 + "y ") * 5, "a " * 23, "a " * 24, "", " \n", None, "w"]


def frame(spark, rows):
    return reachable(spark).createDataFrame([(i, t, 1, "n", "en") for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed, least_words, least_turns", [(1, 24, 3), (2, 24, 3), (3, 6, 2), (4, 5, 3), (5, 2, 2), (6, 12, 4)])
def test_runs_of_blocks(monkeypatch, seed, least_words, least_turns):
    monkeypatch.setattr(pr, "_LOOKUPS", 50 if seed % 2 else 2_000_000)
    made = [t or "" for t in texts(seed)]
    names, at = word_hashes([t.encode() for t in made])
    text, *rest = pr.runs_of(names, at, least_words, least_turns)
    found = [sorted(zip(*(x[text == k].tolist() for x in rest)), key=lambda r: (r[0], r[2])) for k in range(len(made))]
    assert found == [plain_runs(t.split(), least_words, least_turns) for t in made]
    assert sum(map(len, found)) >= 50


def test_short_alphabets():
    """All words over two letters of up to 11, and every least length."""
    for n in range(1, 12):
        names = np.array([[x >> i & 1 for i in range(n)] for x in range(1 << n)], np.uint64).ravel()
        at = np.arange(0, len(names) + 1, n)
        text, start, length, period = pr.runs_of(names, at, 2, 2)
        found = [[] for _ in range(1 << n)]
        for t, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
            found[t].append(tuple(run))
        assert found == [plain_runs([x >> i & 1 for i in range(n)], 2, 2) for x in range(1 << n)]


def test_digests(spark):
    rows = list(enumerate(texts(7))) + [(3, "a b c " * 20), (3, "a b c " * 20), (None, "a b " * 30), (None, None)]
    got = sorted([tuple(r) for r in pr.digests(frame(spark, rows)).collect()], key=repr)
    assert got == sorted([plain(i, t) for i, t in rows], key=repr)


def test_planted(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(500)], k=rng.randrange(0, 120)))) for i in range(200)] + [(None, "a b c"), (207, None), (207, "")]
    got = sorted([tuple(r) for r in pr.digests(pr.with_planted_run(frame(spark, rows))).collect()], key=repr)
    assert got == sorted([plain(i, t, planted=True) for i, t in rows], key=repr)
    assert sum(r[1] for r in got) > 5


def test_columns_and_nothing(spark):
    out = pr.collapse_runs(frame(spark, [(1, "so " * 30 + "it  goes")]))
    assert out.columns == ["doc_id", "text", "lang", "n_words", "runs", "collapsed_text"]
    row = out.first()
    assert (row.lang, row.n_words, [tuple(r) for r in row.runs], row.collapsed_text) == ("en", 32, [(0, 30, 1)], "so it goes")
    assert pr.digests(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pr.collapse_runs(frame(spark, []), 24, 1)


def test_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(50)}" for _ in range(150_000)]
    words[50_000:140_000] = (words[:20_000] * 5)[:90_000]
    got = pr.digests(frame(spark, [(5, " ".join(words))])).collect()[0]
    start, length, period = got.start, got.length, got.period
    assert period == 20_000 and start <= 50_000 and start + length >= 140_000
    assert all(words[i] == words[i + period] for i in range(start, start + length - period))
    assert words[start - 1] != words[start - 1 + period] and words[start + length] != words[start + length - period]
