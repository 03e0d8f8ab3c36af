"""Runs of repeating words, found in an enhanced suffix array by branching tandem repeats.

A run is a stretch of words with smallest period q, at least ``least_words`` long and
``least_turns`` periods, that no neighbouring word extends. The words of a block of texts
get one suffix array, ordered by text first, so no text is ever compared with another;
doubling the compared length (1, 2, 4, ... words) keeps the rank of every suffix at every
length, and with these ranks the common prefix of any two suffixes.

The last square of a run of period q begins at two suffixes, q apart, whose common prefix
is exactly q words: they lie in different children of an interval of the LCP array with
depth q. So each interval looks up ISA[i + depth] and ISA[i - depth] of the suffixes i of
all its children but the largest: where that lies in the interval and the word behind
the second half is not the first one of it, there is a branching square. That is n log n
look-ups at most, without nodes or pointers of a tree. Rotating a square to the left as
long as the words agree gives its run; a square of several periods gives the same stretch
as that of one, and the least period stays.

Two suffixes of a run, one period apart, share at least 2/3 of it: texts without a common
prefix of that many words (16 by default) have no run and are left after as many doublings.

Words are compared by 64-bit hashes. Each text is worked on by itself, without any
shuffle, in blocks of a few megabytes; memory follows the block or the longest text.

Defined cases: null or empty text has no words and no runs; a row's other columns are kept,
null or not; repeated rows each get their runs; texts of any length are taken whole; columns
of docs that have the name of an added one, in any case, are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from twinledger.llm.scratch import without
from twinledger.llm.words import blocks, raw, word_hashes

_BYTES, _ROWS, _LOOKUPS = 2_000_000, 4096, 2_000_000


class Suffixes:
    """The suffix array of the words of several texts, with the ranks by 1, 2, 4, ... words.

    ``levels[k][i]`` is equal for two different suffixes exactly if their first 2**k words are equal
    and in one text. ``loose`` holds the places of suffixes that the last level doesn't tell apart.
    """

    def __init__(self, names: np.ndarray, at: np.ndarray, levels: int = 64):
        n = len(names)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.names = np.unique(names, return_inverse=True)[1]
        self.begin, self.end = at[text], at[text + 1]
        key = (text << 32) | self.names
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        head = np.ones(n + 1, bool)
        head[1:n] = key[1:] != key[:-1]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
        self.levels, size = [rank], 1
        self.loose = np.flatnonzero(~(head[:n] & head[1:]))
        while len(self.loose) and len(self.levels) < levels:
            i = self.order[self.loose]
            second = np.where(i + size < self.end[i], rank[np.minimum(i + size, n - 1)] + 1, 0)
            key = rank[i].astype(np.int64) << 32 | second
            turn = np.argsort(key, kind="stable")
            i, key = i[turn], key[turn]
            self.order[self.loose] = i
            head[self.loose[1:]] |= key[1:] != key[:-1]
            rank = rank.copy()
            rank[i] = np.maximum.accumulate(np.where(head[self.loose], self.loose, 0))
            self.levels.append(rank)
            size *= 2
            self.loose = self.loose[~(head[self.loose] & head[self.loose + 1])]

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes a and b share, for two different ones of one text each."""
        shared, last = np.zeros(len(a), np.int64), len(self.names) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            inside = (x < self.end[a]) & (y < self.end[b])
            x, y = np.minimum(x, last), np.minimum(y, last)
            shared += (inside & (self.levels[k][x] == self.levels[k][y])).astype(np.int64) << k
        return shared

    def turns_left(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before ``start`` equal the word one period further on."""
        shared = np.zeros(len(start), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x = start - shared - (1 << k)
            inside = x >= self.begin[start]
            x = np.maximum(x, 0)
            shared += (inside & (self.levels[k][x] == self.levels[k][x + period])).astype(np.int64) << k
        return shared


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and last place of each LCP interval, and to which one each place belongs (-1: none).

    ``lcp[j]`` is that of the suffixes at places j - 1 and j; an interval's own places are the borders of its children.
    """
    depths, firsts, lasts, owner = [], [], [], [-1] * len(lcp)
    open_ones: list[int] = []
    top = 0
    for j, depth in enumerate(lcp.tolist() + [0]):
        first = j - 1
        while top > depth:
            done = open_ones.pop()
            lasts[done], first = j - 1, firsts[done]
            top = depths[open_ones[-1]] if open_ones else 0
        if depth > top:
            open_ones.append(len(depths))
            depths.append(depth)
            firsts.append(first)
            lasts.append(0)
            top = depth
        if depth:
            owner[j] = open_ones[-1]
    return tuple(np.array(x, np.int64) for x in (depths, firsts, lasts, owner))


def branching_squares(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of all squares that the word behind them ends; some more than once."""
    order, names, n = suffixes.order, suffixes.names, len(suffixes.names)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    same = np.flatnonzero(suffixes.begin[order[1:]] == suffixes.begin[order[:-1]]) + 1
    lcp[same] = suffixes.common_prefix(order[same - 1], order[same])
    depth, first, last, owner = intervals(lcp)
    if not len(depth):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The children of all intervals, one after the other: from each border to before the next.
    borders = np.flatnonzero(owner >= 0)
    borders = borders[np.argsort(owner[borders], kind="stable")]
    counts = np.bincount(owner, minlength=len(depth)) if owner.min() >= 0 else np.bincount(owner[owner >= 0], minlength=len(depth))
    begins = np.cumsum(counts + 1) - counts - 1
    inner = np.ones(len(borders) + len(depth), bool)
    inner[begins] = False
    low = np.empty(len(inner), np.int64)
    low[begins], low[inner] = first, borders
    high = np.empty(len(inner), np.int64)
    high[begins + counts] = last
    high[np.flatnonzero(inner) - 1] = borders - 1
    parent, size = np.repeat(np.arange(len(depth)), counts + 1), high - low + 1
    largest = np.maximum.reduceat(size, begins)
    biggest = np.flatnonzero(size == largest[parent])
    small = np.ones(len(size), bool)
    small[biggest[np.unique(parent[biggest], return_index=True)[1]]] = False
    low, size, parent = low[small], size[small], parent[small]

    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(size)
    done = 0
    while done < len(size):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _LOOKUPS, "right")))
        part = slice(done, upto)
        many = size[part]
        node = np.repeat(parent[part], many)
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        i, d = order[np.repeat(low[part], many) + inside], depth[node]
        begin, end = suffixes.begin[i], suffixes.end[i]
        for start in (i, i - d):  # the suffix is the square's first half, or its second
            other = start + d if start is i else start
            known = (other >= begin) & (other < end)
            at = place[np.where(known, other, 0)]
            known &= (at >= first[node]) & (at <= last[node])
            behind = start + 2 * d
            known &= (behind >= end) | (names[np.minimum(behind, n - 1)] != names[np.clip(start + d, 0, n - 1)])
            starts.append(start[known])
            periods.append(d[known])
        done = upto
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(names: np.ndarray, at: np.ndarray, least_words: int, least_turns: int) -> tuple[np.ndarray, ...]:
    """Text, start in it, length and period of each run, in this order."""
    shared = min(max(least_words, least_turns * q) - q for q in range(1, least_words + 1))
    quick = Suffixes(names, at, shared.bit_length())
    texts = np.unique(np.searchsorted(at, quick.order[quick.loose], "right") - 1)
    if not len(texts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.diff(at)[texts]
    mine = np.concatenate([[0], np.cumsum(sizes)])
    suffixes = Suffixes(names[np.repeat(at[texts] - mine[:-1], sizes) + np.arange(mine[-1])], mine)
    start, period = branching_squares(suffixes)
    turns = suffixes.turns_left(start, period)
    start, length = start - turns, 2 * period + turns
    long = length >= np.maximum(least_words, least_turns * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(mine, start, "right") - 1
    return texts[text], start - mine[text], length, period


def _collapsed(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[int, bytes]:
    """Words, and those that no run contains behind its first period, joined by a blank."""
    words = text.split()
    if not len(start):
        return len(words), b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return len(words), b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def collapse_runs(docs: DataFrame, least_words: int = 24, least_turns: int = 3) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words, by start, then period) and collapsed_text.

    In collapsed_text each run keeps its first period; words are joined by a blank. ``least_turns`` is 2 at least.
    """
    if least_turns < 2 or least_words < 2:
        raise ValueError("a run has two periods and two words at least")
    docs = without(docs, "n_words", "runs", "collapsed_text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw(t) for t in batch.column("text").to_pylist()]
            for s in blocks(texts, _BYTES, _ROWS):
                part = texts[s]
                text, start, length, period = runs_of(*word_hashes(part), least_words, least_turns)
                bounds = np.searchsorted(text, np.arange(len(part) + 1))
                out = [_collapsed(t, start[a:b], length[a:b], period[a:b]) for t, a, b in zip(part, bounds[:-1], bounds[1:])]
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(s.start, len(part)) for c in batch.columns), pa.array([o[0] for o in out], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array([o[1] for o in out], pa.binary()).view(pa.string())],
                    [*batch.schema.names, "n_words", "runs", "collapsed_text"])

    run_type = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = StructType([*docs.schema.fields]).add("n_words", "long").add("runs", ArrayType(run_type)).add("collapsed_text", "string")
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, least_words: int = 24, least_turns: int = 3) -> DataFrame:
    """Per document: doc_id, n_runs, the run of greatest length / period, and SHA-256 of all runs and of the collapsed text."""
    found = collapse_runs(docs.select("doc_id", "text"), least_words, least_turns)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("_best", F.expr("""
        aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0),
            (best, r) -> if(r.length * best.period > best.length * r.period, r, best))""")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_run(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts, chosen by doc_id, repeat a stretch of their words up to the end.

    With h the CRC-32 of doc_id as text, g = h div 10 and n words: where h mod 10 is 0 and n is not, each word
    from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Rows without doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    made = docs.withColumns({"_words": words, "_g": F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")})
    made = made.withColumn("_a", F.when(F.size("_words") > 0, F.col("_g") % F.size("_words")))
    made = made.withColumn("_p", F.expr("1 + (size(_words) - _a) div (3 + _g % 8)"))
    text = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, get(_words, int(_a + (i - _a) % _p)))), ' ')")
    return made.withColumn("text", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text"))).drop("_words", "_g", "_a", "_p")
