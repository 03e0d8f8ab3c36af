"""Documents whose sets of word n-grams are similar, joined by a partition of the universe.

Two sets with Jaccard similarity of at least num/den differ in at most
H = (|r| + |s|) * (den - num) / (den + num) n-grams. Sizes fall into bands [2^j, 2^(j+1));
each band cuts the universe of n-gram hashes into segments. A set takes part in its own
band, where its segments are indexed, and looks for sets of its size and more there and in
the next band, if these can be similar. Of all segments it needs only so many units that
they exceed H: an equal segment is one unit, and in a few segments of each band, which are
indexed with their one-deletion neighbours too, a segment equal up to one n-gram is two.
Then at least one unit shows each similar set. Which segments are taken is a matter of
cost: first those with an n-gram that is not among the very common ones (counted over all
documents; the list of them is bounded and only a hint), then deletion segments, then common
segments by their count, and empty ones at the very last. Bands in which some set needs
empty segments are found beforehand; only there are these indexed.

Rounds, so that groups of copies are never paired out:
1. Equal texts are one document, the one with the least doc_id.
2. A thin share of all segments links each document to the least one with the same
   segment; the links are verified and give first components.
3. All segments, with components as labels: within a segment only sets of different
   components are compared, so a group of thousands of copies gives no pairs.
Candidates whose parity sketches differ in more bits than similar sets can are dropped; every
other link is verified on the whole sets. Segment hashes travel as packed arrays, one per
block of documents and bucket; texts are shuffled once, into a table that is bucketed by
doc_id, so later joins do not move them.

Each band has its own buckets, as many as its n-grams ask for, so a document goes to those of
its own band and the next only. A bucket also counts by how many of its segments a set differs
from one of the same band: it reports a pair only if these are fewer than the units probed
there. If every bucket that shows a pair had as many, the others, which show nothing, would
add all their units, and the sets would differ in more than H n-grams; so some bucket reports
each similar pair.

Defined cases: null or blank text has no n-grams and no link; fewer words than ``size`` are
one n-gram; rows that share a doc_id are one node, with the links of all their texts; a
null doc_id has no component; a very long text is one set in a block of its own; columns other
than doc_id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.graph import components
from twinledger.llm.scratch import discard, new_path, shuffles_dropped, written
from twinledger.llm.words import U64, blocks, folded, mix, released, shingle_sets

_BYTES, _ROWS = 4_000_000, 8192
_DELETION_SEGMENTS = 4
_HINTS = 100_000
_COMMON = 2  # documents of a block that make an n-gram worth counting
_ROUND_ONE = 16  # one of so many segments is looked at in round 2 of the docstring
_STAR = 2_000
_MANY = 33  # documents with the same segment
_SKETCH = 1024  # bits
_ENTRIES = 6_000_000  # of a bucket
_BUCKET_BITS = 20
_AT_ONCE = 250_000  # pairs of a bucket looked at together
_INDEX, _PROBE, _OWN, _TWO = 1, 2, 4, 8  # _OWN: a whole segment in the set's own band, _TWO: of two units
_RAISED = _OWN | _PROBE  # how _OWN, _PROBE, _INDEX and _TWO travel
_EXACT, _DELETED = U64(0x51ED270B4D2F5C11), U64(0x2545F4914F6CDD1D)


def band_of(n: int) -> int:
    return n.bit_length() - 1


def segments_of(band: int) -> int:
    """Segments of a band: about two n-grams each in the largest sets, fewer in small ones."""
    top = 1 << (band + 1)
    return 1024 if top <= 32 else top if top <= 128 else top // 2


class Rule:
    """Similarity of at least num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, n: int) -> int:
        """The size of the largest set that can be similar to one of size n."""
        return n * self.den // self.num

    def bands(self, n: int) -> list[tuple[int, int]]:
        """Bands in which a set of size n looks for sets at least as large, with the units it needs there."""
        top = self.largest(n)
        return [(j, self.differ(n, min(top, (1 << (j + 1)) - 1)) + 1) for j in range(band_of(n), band_of(top) + 1)]

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b) or min(len(a), len(b)) * self.den < max(len(a), len(b)) * self.num:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both * self.den >= (len(a) + len(b) - both) * self.num


def _key(sums: np.ndarray, band: int, segment: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix(sums + mix(kind + (segment.astype(U64) << U64(8)) + U64(band)))


class Segments:
    """The segments of one set in one band."""

    def __init__(self, grams: np.ndarray, band: int):
        self.band, self.m = band, segments_of(band)
        place = ((grams >> U64(32)) * U64(self.m) >> U64(32)).astype(np.int64)  # ascending, as the n-grams are
        self.mixed = mix(grams ^ _EXACT)
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.segment, self.sums = place[head], np.add.reduceat(self.mixed, head)
        self.bounds = np.concatenate([head, [len(grams)]])

    def keys(self) -> np.ndarray:
        return _key(self.sums, self.band, self.segment, _EXACT)

    def deletion(self) -> np.ndarray:
        """Which of the non-empty segments are indexed with their deletions; those of one n-gram are not."""
        return np.flatnonzero((self.segment < _DELETION_SEGMENTS) & (np.diff(self.bounds) > 1))

    def without_one(self, which: np.ndarray, kind: np.uint64) -> np.ndarray:
        """Keys of segments less one n-gram each."""
        out = [_key(self.sums[i] - self.mixed[self.bounds[i]:self.bounds[i + 1]], self.band,
                    np.full(self.bounds[i + 1] - self.bounds[i], self.segment[i]), kind) for i in which]
        return np.concatenate([np.zeros(0, U64), *out])

    def empty(self) -> np.ndarray:
        gone = np.setdiff1d(np.arange(self.m), self.segment)
        return _key(np.zeros(len(gone), U64), self.band, gone, _EXACT)

    def cost(self, weights: np.ndarray | None) -> np.ndarray:
        """Of each non-empty segment: 0 if some n-gram of it is not common, else the least count."""
        return np.zeros(len(self.segment), np.int64) if weights is None else np.minimum.reduceat(weights, self.bounds[:-1])


def entries(grams: np.ndarray, rule: Rule, weights: np.ndarray | None, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and flags (index, probe) of a set's segments; ``short``: bits of the bands where empty segments are indexed."""
    return banded_entries(grams, rule, weights, short)[:2]


def banded_entries(grams: np.ndarray, rule: Rule, weights: np.ndarray | None, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``entries`` with the band of each."""
    keys, flags, bands = [], [], []

    def add(found: np.ndarray, flag) -> None:
        keys.append(found)
        flags.append(np.broadcast_to(np.asarray(flag, np.uint8), found.shape))
        bands.append(np.full(len(found), band, np.uint8))

    for band, units in rule.bands(len(grams)):
        own = band == band_of(len(grams))
        cut = Segments(grams, band)
        cost = cut.cost(weights)
        order = np.argsort(cost, kind="stable")
        taken = np.zeros(len(cost), bool)
        cheap = int((cost == 0).sum())
        # A cheap deletion segment raised to two units saves a dear one.
        deletion = cut.deletion()
        raised = deletion[cost[deletion] == 0][:max(0, units - cheap)]
        need = units - len(raised)
        taken[order[:need]] = True
        taken[raised] = True
        twice = np.zeros(len(cost), bool)
        twice[raised] = True
        add(cut.keys(), (_INDEX | _OWN) * own + _PROBE * taken + _TWO * (twice & own))
        if own:
            add(cut.without_one(deletion, _DELETED), _INDEX)
        if len(raised):  # the other set has one more, or one less
            add(_key(cut.sums[raised], band, cut.segment[raised], _DELETED), _PROBE)
            add(cut.without_one(raised, _EXACT), _PROBE)
        if short >> band & 1:
            gone = cut.empty()
            lacking = max(0, need - len(cost))
            add(gone, (_INDEX | _OWN) * own + _PROBE * (np.arange(len(gone)) < lacking))
    key, flag, where = np.concatenate(keys), np.concatenate(flags), np.concatenate(bands)
    keep = flag > 0
    return key[keep], flag[keep], where[keep]


def first_buckets(grams: dict[int, int]) -> np.ndarray:
    """The first bucket of each band, by the n-grams of its sets: these have some three entries for four
    n-grams in their own band and one for eight in the next."""
    counts = [min(1 << _BUCKET_BITS, 1 + (6 * grams.get(j, 0) + grams.get(j - 1, 0)) // (8 * _ENTRIES)) for j in range(64)]
    return np.concatenate([[0], np.cumsum(counts)]).astype(U64)


def short_bands(grams: np.ndarray, rule: Rule) -> int:
    """Bits of the bands in which the set needs empty segments, whatever the costs."""
    found = 0
    for band, units in rule.bands(len(grams)):
        if len(grams) < units or len(Segments(grams, band).segment) < units:
            found |= 1 << band
    return found


def thin_keys(grams: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """A share of the set's segment hashes, of small sets all, and ``short_bands``: one cut of the set for both."""
    keys, short = [np.zeros(0, U64)], 0
    for band, units in rule.bands(len(grams)) if len(grams) else ():
        cut = Segments(grams, band)
        keys.append(cut.keys())
        short |= (len(cut.segment) < units) << band
    found = np.concatenate(keys)
    return found if len(grams) < 32 else found[found % U64(_ROUND_ONE) == 0], short


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the n-grams in each of ``_SKETCH`` classes: sets that differ in d n-grams differ in at most d bits."""
    counts = np.bincount((mix(grams ^ _DELETED) % U64(_SKETCH)).astype(np.int64), minlength=_SKETCH)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def profile(texts: DataFrame, rule: Rule, size: int) -> DataFrame:
    """One pass: per document n, short and its keys for round one; and rows of common n-grams with counts."""

    names = ["doc_id", "digest", "n", "short", "keys", "gram", "sketch"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column("doc_id"), batch.column("digest")
            raws = [folded(t) for t in batch.column("text").to_pylist()]
            for s in blocks(raws, _BYTES, _ROWS):
                sets = shingle_sets(raws[s], size)
                keys, short = [], []
                for grams in sets:
                    thin, few = thin_keys(grams, rule)
                    keys.append(np.unique(thin).view(np.int64))
                    short.append(few)
                yield pa.RecordBatch.from_arrays(
                    [ids[s], digests[s], pa.array([len(g) for g in sets], pa.int64()), pa.array(short, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), pa.nulls(len(sets), pa.int64()),
                     pa.array([sketch(g) for g in sets], pa.binary())], names)
                grams, counts = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_counts=True)
                often = counts >= _COMMON
                grams, counts = grams[often], counts[often]
                none = pa.nulls(len(grams), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, pa.nulls(len(grams), pa.binary()), pa.array(counts), none, pa.nulls(len(grams), pa.list_(pa.int64())),
                     pa.array(grams.view(np.int64)), pa.nulls(len(grams), pa.binary())], names)
                del sets, keys, short, grams, counts, often
        released()

    return texts.mapInArrow(run, "doc_id long, digest binary, n long, short long, keys array<long>, gram long, sketch binary")


def plausible(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow similarity; loses no similar pair."""
    about = sets.select("doc_id", "n", "sketch")
    both = pairs.join(about.toDF("a", "na", "sa"), "a").join(about.toDF("b", "nb", "sb"), "b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(na), -1) for c in ("sa", "sb"))
            apart = np.bitwise_count(sa ^ sb).sum(axis=1, dtype=np.int64)
            fits = (np.minimum(na, nb) * rule.den >= np.maximum(na, nb) * rule.num) & (apart <= (na + nb) * (rule.den - rule.num) // (rule.den + rule.num))
            keep = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule, size: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are similar. A document in very many pairs is dealt to many tasks."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / _STAR).cast("int").alias("parts"))
    right = texts.join(hubs, texts.doc_id == hubs.b).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("right"))
    dealt = pairs.join(hubs, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    left = dealt.join(texts, dealt.a == texts.doc_id).select("a", "b", "part", F.col("text").alias("left"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def grams(text: str) -> np.ndarray:
            if text not in known:
                if len(known) > 64:
                    known.clear()
                known[text] = shingle_sets([folded(text)], size)[0]
            return known[text]

        for batch in batches:
            keep = [rule.similar(grams(x), grams(y)) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])
        known.clear()
        released()

    return left.join(right, ["b", "part"]).select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def packed(labelled: DataFrame, rule: Rule, size: int, hints, short: int, first: np.ndarray) -> DataFrame:
    """Rows of bucket and payload: documents, labels, sizes, sketches, and for each segment hash its document and flags."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        common, weight = hints.value
        for batch in batches:
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            labels = np.array(batch.column("label").to_pylist(), np.int64)
            raws = [folded(t) for t in batch.column("text").to_pylist()]
            for s in blocks(raws, _BYTES, _ROWS):
                sets = shingle_sets(raws[s], size)
                marks = np.frombuffer(b"".join(sketch(g) for g in sets), np.uint64).reshape(len(sets), 2, -1)
                marks = marks[:, 0] ^ marks[:, 1]  # half as many classes
                keys, flags, owner, bands = [np.zeros(0, U64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
                for i, grams in enumerate(sets):
                    if not len(grams):
                        continue
                    weights = None
                    if len(common):
                        spot = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                        weights = np.where(common[spot] == grams, weight[spot], 0)
                    key, flag, band = banded_entries(grams, rule, weights, short)
                    keys.append(key)
                    flags.append(np.where(flag & _TWO, _RAISED, flag).astype(np.uint8))
                    bands.append(band)
                    owner.append(np.full(len(key), i, np.uint16))
                key, flag, who, band = np.concatenate(keys), np.concatenate(flags), np.concatenate(owner), np.concatenate(bands)
                bucket = (first[band] + ((key >> U64(64 - _BUCKET_BITS)) * (first[band + 1] - first[band]) >> U64(_BUCKET_BITS))).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, low, flag, who = bucket[order], (key[order] >> U64(8)).astype(np.uint32), flag[order], who[order]
                heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
                payloads = []
                sizes = np.array([len(g) for g in sets], np.int32)
                for a, b in zip(heads, [*heads[1:], len(bucket)]):
                    docs, local = np.unique(who[a:b], return_inverse=True)
                    held = (local.astype(np.uint16) << 3) | flag[a:b]  # 13 bits hold _ROWS documents
                    payloads.append(b"".join(x.tobytes() for x in (
                        np.array([len(docs), b - a], np.int64), ids[s][docs], labels[s][docs], sizes[docs], marks[docs], low[a:b], held)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[heads] if len(bucket) else [], pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])
                del sets, marks, keys, flags, owner, bands, key, flag, who, band, bucket, order, low, payloads
        released()

    return labelled.select("doc_id", "label", "text").mapInArrow(run, "bucket int, payload binary")


def _unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    docs, count = np.frombuffer(payload, np.int64, 2).tolist()
    at, out = 16, []
    words = _SKETCH // 128
    for kind, n in ((np.int64, docs), (np.int64, docs), (np.int32, docs), (np.uint64, docs * words), (np.uint32, count), (np.uint16, count)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    return tuple(out)


def bucket_pairs(payloads: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a, b), a < b, of documents with different labels that share a segment hash."""
    ids, labels, sizes, marks, keys, owner, flags, base = [], [], [], [], [], [], [], 0
    for payload in payloads:
        i, lab, n, mark, key, held = _unpack(payload)
        marks.append(mark.reshape(len(i), -1))
        ids.append(i)
        labels.append(lab)
        sizes.append(n)
        keys.append(key)
        owner.append((held >> 3).astype(np.int32) + base)
        flags.append((held & 7).astype(np.uint8))
        base += len(i)
    ids, labels, sizes, marks, key, owner, flag = map(np.concatenate, (ids, labels, sizes, marks, keys, owner, flags))
    sizes = sizes.astype(np.int64)
    raised = flag == _RAISED
    flag = np.where(raised, flag | _INDEX, flag)
    whole = flag & _OWN > 0  # each set's segments here, and the units probed among them
    segments = np.bincount(owner[whole], minlength=len(ids))
    units = np.bincount(owner[whole & (flag & _PROBE > 0)], minlength=len(ids)) + np.bincount(owner[raised], minlength=len(ids))
    order = np.argsort(key, kind="stable")
    key, owner, flag = key[order], owner[order], flag[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.concatenate([head, [len(key)]]))
    # Runs with a probe, an index entry and more than one label.
    label = labels[owner]
    mixed = (np.minimum.reduceat(label, head) != np.maximum.reduceat(label, head)) if len(head) else np.zeros(0, bool)
    both = np.bitwise_or.reduceat(flag, head) & (_INDEX | _PROBE) == _INDEX | _PROBE if len(head) else mixed
    found, shown = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # p << 32 | q

    def keep(p: np.ndarray, q: np.ndarray, own: np.ndarray) -> None:
        """p probes, q is indexed; own: by a segment whose band is p's own."""
        for s in range(0, len(p), _AT_ONCE):
            x, y, mine = p[s:s + _AT_ONCE], q[s:s + _AT_ONCE], own[s:s + _AT_ONCE]
            good = (labels[x] != labels[y]) & (sizes[x] <= sizes[y]) & (sizes[x] * rule.den >= sizes[y] * rule.num)
            for kind, into in ((good & ~mine, found), (good & mine, shown)):
                pair = np.unique((x[kind].astype(np.int64) << 32) | y[kind])
                i, j = pair >> 32, pair & 0xFFFFFFFF
                apart = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64)
                into.append(pair[apart <= (sizes[i] + sizes[j]) * (rule.den - rule.num) // (rule.den + rule.num)])
                if sum(map(len, into[1:])) > max(len(into[0]), 4 * _AT_ONCE):  # most pairs share many segments
                    into[:] = [np.unique(np.concatenate(into))]

    for step in range(1, _MANY):  # short runs: all at once, by distance
        at = np.repeat(head[(length > step) & (length <= _MANY) & mixed & both], 1)
        runs = length[(length > step) & (length <= _MANY) & mixed & both]
        if not len(at):
            break
        first = np.repeat(at, runs - step) + (np.arange(int((runs - step).sum())) - np.repeat(np.cumsum(runs - step) - (runs - step), runs - step))
        for x, y in ((first, first + step), (first + step, first)):
            asks = (flag[x] & _PROBE > 0) & (flag[y] & _INDEX > 0)
            keep(owner[x[asks]], owner[y[asks]], flag[x[asks]] & _OWN > 0)
    for p, q, own in _in_long_runs(owner, flag, *(x[(length > _MANY) & mixed & both] for x in (head, length))):
        keep(p, q, own)
    del label
    pairs = _both_ends(shown)
    part_of = np.zeros(len(ids), bool)
    part_of[pairs] = True
    whole = (flag & _OWN > 0) & part_of[owner]
    near = _near_here(pairs, np.sort((owner[whole].astype(np.int64) << 32) | key[whole]), segments, units)
    pairs = ids[np.unique(np.sort(np.concatenate([_both_ends(found), near]), axis=1), axis=0)]
    return pairs.min(axis=1), pairs.max(axis=1)


def _in_long_runs(owner: np.ndarray, flag: np.ndarray, head: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of p, q, own: documents that probe a run and those indexed in it, each pair once for all runs that show it.

    Large groups of near copies meet in hundreds of runs, so a document's runs are put together before anything is compared.
    """
    entry = np.repeat(head, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    run, indexed = np.repeat(np.arange(len(head)), length), flag[entry] & _INDEX > 0
    docs, place = np.unique(owner[entry[indexed]], return_inverse=True)
    held = np.split(place.astype(np.int32), np.searchsorted(run[indexed], np.arange(1, len(head))))
    asks = flag[entry] & _PROBE > 0
    asking = np.stack([owner[entry[asks]].astype(np.int64) * 2 + (flag[entry[asks]] & _OWN > 0), run[asks]], axis=1)
    asking = asking[np.argsort(asking[:, 0], kind="stable")]
    seen, batch, size = np.zeros(len(docs), bool), [], 0
    for part in np.split(asking, np.flatnonzero(np.diff(asking[:, 0])) + 1) if len(asking) else ():
        for r in part[:, 1].tolist():
            seen[held[r]] = True
        there = np.flatnonzero(seen)
        seen[there] = False
        batch.append((int(part[0, 0]), there))
        size += len(there)
        if size >= _AT_ONCE or part[-1, 0] == asking[-1, 0]:
            who = np.repeat(np.array([w for w, _ in batch]), [len(t) for _, t in batch])
            yield who >> 1, docs[np.concatenate([t for _, t in batch])], who & 1 > 0
            batch, size = [], 0


def _both_ends(packed_pairs: list[np.ndarray]) -> np.ndarray:
    """The distinct pairs as rows of two."""
    pairs = np.unique(np.concatenate(packed_pairs))
    return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)


def _near_here(pairs: np.ndarray, counted: np.ndarray, segments: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The pairs (p, q) in which fewer of p's segments in this bucket are unlike q's than p has units here.

    ``counted``: owner << 32 | key of these sets' segments, sorted.
    """
    start = np.searchsorted(counted, np.arange(len(segments), dtype=np.int64) << 32)
    out = [pairs[:0]]
    ends = np.cumsum(segments[pairs[:, 0]])
    for cut in np.split(pairs, np.flatnonzero(np.diff(ends // (2 * _AT_ONCE))) + 1):
        p, q = cut.T
        n = segments[p]
        spot = np.repeat(start[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        asked = (counted[spot] & 0xFFFFFFFF) | (np.repeat(q, n).astype(np.int64) << 32)
        there = np.minimum(np.searchsorted(counted, asked), max(0, len(counted) - 1))
        same = np.bincount(np.repeat(np.arange(len(cut)), n), counted[there] == asked, minlength=len(cut)).astype(np.int64)
        out.append(cut[n - same < units[p]])
    return np.concatenate(out)


def similar_documents(docs: DataFrame, num: int = 75, den: int = 100, size: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id."""
    rule = Rule(num, den)
    spark = docs.sparkSession
    base = docs.select("doc_id", "text").withColumn("digest", F.when(
        F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(F.col("text").cast("binary")))))
    least = base.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = written(base.select("doc_id", "digest").join(least, "digest", "left").select("doc_id", "digest", "rep"), "jaccard-members")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reps = members.filter("doc_id = rep").select("doc_id", F.col("digest").alias("_digest")).distinct()
    table, path = f"jaccard_{uuid.uuid4().hex}", new_path(spark, "jaccard-texts")
    with shuffles_dropped(spark):
        base.filter("digest IS NOT NULL").repartition(parts, "doc_id").write.option("path", path).option(
            "compression", "zstd").bucketBy(parts, "doc_id").sortBy("doc_id").saveAsTable(table)
    try:
        once = spark.table(table).join(reps, "doc_id").filter("digest = _digest").drop("_digest")
        if members.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count():
            once = once.dropDuplicates(["doc_id", "digest"])
        links, sizes = _links(once, rule, size)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        discard(spark, path)
    parts_of = components(links.union(members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return members.join(sizes, "digest", "left").join(parts_of, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _links(texts: DataFrame, rule: Rule, size: int) -> tuple[DataFrame, DataFrame]:
    """The verified links among documents with different texts, and each document's set size."""
    spark = texts.sparkSession
    found = written(profile(texts.select("doc_id", "digest", "text"), rule, size), "jaccard-profile")
    sets = found.filter("gram IS NULL")
    keyed = sets.select("doc_id", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).filter("c > 1")
    stars = keyed.join(hubs, "key").filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    first = written(verified(written(plausible(stars, sets, rule), "jaccard-stars"), texts, rule, size), "jaccard-links")
    labels = written(components(first), "jaccard-labels")
    about = sets.agg(F.coalesce(F.bit_or("short"), F.lit(0)).alias("short")).first()
    top = found.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(_HINTS).collect()
    common = np.array([r.gram for r in top], np.int64).view(U64)
    order = np.argsort(common)
    hints = spark.sparkContext.broadcast((common[order], np.array([r.n for r in top], np.int64)[order]))
    labelled = texts.join(labels, texts.doc_id == labels.node, "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("label"), "text")
    held = sets.groupBy((F.length(F.bin("n")) - 1).alias("band")).agg(F.sum("n").alias("n")).collect()  # one row per band
    first_of = first_buckets({r.band: r.n for r in held})

    def pairs_of(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = bucket_pairs(list(pdf["payload"]), rule)
        released()
        return pd.DataFrame({"a": a, "b": b})

    pairs = packed(labelled, rule, size, hints, about.short, first_of).groupBy("bucket").applyInPandas(pairs_of, "a long, b long").distinct()
    second = written(verified(written(plausible(pairs, sets, rule), "jaccard-pairs"), texts, rule, size), "jaccard-links")
    return first.union(second), sets.select("digest", "n").distinct()
