"""The n-gram join against all pairs, and the rules that make it whole."""

import os
import random
import sys
import tracemalloc

import numpy as np
import pytest

from twinledger.llm import jaccard_join as join
from twinledger.llm.graph import components
from twinledger.llm.scratch import reachable
from twinledger.llm.words import mix, released

SCHEMA = "doc_id long, text string, component int"
RULE = join.Rule(75, 100)


def grams(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def plain(rows):
    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(a), None if i is None else root(i)) for i, a in sets), key=repr)


def texts(seed, sources=30, n=150):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)] + ["é", "A", "a"]
    shared = rng.choices(vocabulary, k=40)
    bases = [rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 45, 90, 200])) for _ in range(sources)]
    made = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(words) + 1)
            words[at:at + rng.randrange(3)] = rng.choices(vocabulary, k=rng.randrange(3))
        if rng.random() < 0.2:
            words += shared
        made.append(rng.choice([" ", "\n", "  "]).join(w.lower() if rng.random() < 0.3 else w for w in words))
    return made + ["", " ", None, "a", "A", "a\n", made[0], made[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    found = texts(seed)
    order = list(range(len(found)))
    random.Random(seed).shuffle(order)
    rows = list(zip(order, found)) + [(order[4], found[4]), (order[5], found[9]), (None, found[1]), (None, None)]
    docs = reachable(spark).createDataFrame([(i, t, 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join.similar_documents(docs).collect()), key=repr)
    assert got == plain(rows)


def test_first_round_and_hints_change_nothing(spark, monkeypatch):
    rows = list(enumerate(texts(7)))
    docs = reachable(spark).createDataFrame([(i, t, 1) for i, t in rows], SCHEMA)
    monkeypatch.setattr(join, "_ROUND_ONE", 1 << 40)
    monkeypatch.setattr(join, "_COMMON", 2)
    monkeypatch.setattr(join, "_STAR", 3)
    monkeypatch.setattr(join, "_ENTRIES", 400)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join.similar_documents(docs).collect()), key=repr)
    assert got == plain(rows)


def test_similar_sets_share_a_probed_segment():
    """Whatever the costs: some key that the smaller set probes is indexed by the larger one."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.choice([3, 4, 5, 7, 8, 15, 16, 31, 33, 64, 100, 127, 300]))
        both = mix(rng.integers(1, 1 << 62, 2 * n, np.uint64))
        a = np.unique(both[:n])
        lost, won = rng.integers(0, n // 6 + 2), rng.integers(0, n // 6 + 2)
        b = np.unique(np.concatenate([a[rng.permutation(n)[lost:]], both[n:n + won]]))
        if not RULE.similar(a, b) or len(a) == len(b) and len(np.setdiff1d(a, b)) == 0:
            continue
        a, b = sorted((a, b), key=len)
        short = join.short_bands(a, RULE) | join.short_bands(b, RULE)
        weigh = lambda s: rng.integers(0, 3, len(s)) * rng.integers(0, 2)
        ka, fa = join.entries(a, RULE, weigh(a), short)
        kb, fb = join.entries(b, RULE, weigh(b), short)
        hit = np.isin(ka[fa & 2 > 0], kb[fb & 1 > 0]).any()
        if len(a) == len(b):
            hit = hit and np.isin(kb[fb & 2 > 0], ka[fa & 1 > 0]).any()
        assert hit


def _payloads(sets, first, short):
    """Per bucket the payloads of the sets, as ``packed`` lays them out, each set in a payload of its own."""
    out = {}
    for i, grams in enumerate(sets):
        key, flag, band = join.banded_entries(grams, RULE, None, short)
        flag = np.where(flag & join._TWO, join._RAISED, flag)
        bucket = first[band] + ((key >> np.uint64(44)) * (first[band + 1] - first[band]) >> np.uint64(20))
        mark = np.frombuffer(join.sketch(grams), np.uint64).reshape(2, -1)
        for b in np.unique(bucket):
            at = bucket == b
            out.setdefault(int(b), []).append(b"".join(x.tobytes() for x in (
                np.array([1, at.sum()], np.int64), np.array([i]), np.array([i]), np.array([len(grams)], np.int32), mark[0] ^ mark[1],
                (key[at] >> np.uint64(8)).astype(np.uint32), flag[at].astype(np.uint16))))
    return out


def test_buckets_report_similar_pairs_and_few_others(monkeypatch):
    """Every similar pair in some bucket, however many there are; unlike sets with a common part in few of them."""
    monkeypatch.setattr(join, "_ENTRIES", 3000)
    rng = np.random.default_rng(8)
    sets = []
    for n in (6, 20, 60, 300, 900, 1500):
        base = mix(rng.integers(1, 1 << 62, n, np.uint64))
        for share in (0.02, 0.05, 0.1, 0.13, 0.14):
            sets.append(np.unique(np.where(rng.random(n) < share, mix(rng.integers(1, 1 << 62, n, np.uint64)), base)))
    shared = mix(rng.integers(1, 1 << 62, 300, np.uint64))
    sets += [np.unique(np.concatenate([shared, mix(rng.integers(1, 1 << 62, 1300, np.uint64))])) for _ in range(12)]
    totals = {}
    for s in sets:
        totals[join.band_of(len(s))] = totals.get(join.band_of(len(s)), 0) + len(s)
    short = int(np.bitwise_or.reduce([join.short_bands(s, RULE) for s in sets]))
    buckets = _payloads(sets, join.first_buckets(totals), short)
    found = [pair for held in buckets.values() for pair in zip(*(x.tolist() for x in join.bucket_pairs(held, RULE)))]
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if RULE.similar(sets[i], sets[j])}
    assert len(similar) > 15 and similar <= set(found)
    unlike = len(sets) - 12
    assert len([p for p in found if min(p) >= unlike]) <= 12


def test_large_groups_of_near_copies_are_compared_once_per_pair(monkeypatch):
    """Sets of a group meet in dozens of long runs: neither memory nor pairs follow from their number."""
    rng = np.random.default_rng(3)
    base, first = mix(rng.integers(1, 1 << 62, 120, np.uint64)), join.first_buckets({})
    near = [np.unique(np.where(rng.random(120) < 0.1, mix(rng.integers(1, 1 << 62, 120, np.uint64)), base)) for _ in range(900)]
    short = int(np.bitwise_or.reduce([join.short_bands(s, RULE) for s in near]))
    held = _payloads(near, first, short)
    tracemalloc.start()
    found = {b: join.bucket_pairs(h, RULE) for b, h in held.items()}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6
    few = _payloads(near[:200], first, short)
    found = {b: np.stack(join.bucket_pairs(h, RULE)) for b, h in few.items()}
    shown = {p for f in found.values() for p in zip(*f.tolist())}
    assert {(i, j) for j in range(200) for i in range(j) if RULE.similar(near[i], near[j])} <= shown
    for many in (1, 1_000):  # all runs are long, or none is
        monkeypatch.setattr(join, "_MANY", many)
        monkeypatch.setattr(join, "_AT_ONCE", 5_000)
        assert all(np.array_equal(found[b], np.stack(join.bucket_pairs(h, RULE))) for b, h in few.items())


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_goes_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    made = [bytearray(4_000) for _ in range(50_000)]
    last, most = made[-1], held()
    made.clear()
    released()
    assert len(last) == 4_000 and most - held() > 100e6


def test_few_units_take_empty_segments():
    one = np.sort(np.arange(1, 4, dtype=np.uint64))  # three n-grams in one segment
    assert join.short_bands(one, RULE)
    other = np.concatenate([one, [np.uint64(1 << 63)]])
    short = join.short_bands(one, RULE)
    keys, flags = join.entries(one, RULE, None, short)
    held, kinds = join.entries(other, RULE, None, short)
    assert RULE.similar(one, other) and np.isin(keys[flags & 2 > 0], held[kinds & 1 > 0]).any()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 340)] + [
        (i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 3)]
    parent = {x: x for p in pairs for x in p if x is not None and None not in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame(pairs, "a long, b long")
    assert sorted((r.node, r.component) for r in components(links).collect()) == sorted((x, root(x)) for x in parent)


def test_nothing(spark):
    assert join.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
