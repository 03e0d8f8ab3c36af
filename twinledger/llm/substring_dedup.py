"""Removal of word sequences that occur earlier, found by recompression.

A text's words are named, and rounds of recompression replace each run of equal symbols,
then each pair of a left and a right symbol (told apart by a bit of their name), by a new
symbol. Names are 64-bit hashes of what they stand for, so equal runs and pairs get the
same name everywhere without asking. A window of ``window`` words fixes the interior of
its own parse: of each round only the first and last run, and a first right and a last
left symbol, depend on what stands outside. So equal windows hold the same interior
symbols, wherever they occur. Of its deepest non-empty interior, a window takes the
symbol with the least hash as its anchor, and with it the ten words before or from it,
whichever lie inside. Neighbouring windows mostly share their anchor: about one key in
five words leaves a text. Different starts of one sequence of words have different anchors:
neighbours that share key and anchor are one occurrence, all others are told apart.

One global round counts the keys. Only windows whose key occurs more than once are then
named themselves, by 128 bits, and a second global round finds each one's first document;
within it the first start counts. That decides exactly, whatever the keys let through.

A key or a window that very many documents share is merged within each block of documents
before any shuffle. Texts are shuffled once, by doc_id.

Defined cases: null text has no words; a row without doc_id keeps all its words and takes
none from others; rows with the same doc_id are not earlier than each other; texts of any
length are read in overlapping parts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.scratch import without, written
from twinledger.llm.words import U64, blocks, mix, raw, run_hashes, word_hashes

_ROUNDS = 2
_BYTES, _ROWS, _WORDS = 2_000_000, 4096, 1_000_000
_PAIR = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_FIRST, _SECOND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


class Parse:
    """Levels of the recompression of a sequence, and per place the interior of windows that begin or end there."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.names, self.begins = [words], [np.arange(n)]
        self.first, self.last = [np.arange(n + 1)], [np.arange(n + 1)]
        for level in range(_ROUNDS):
            self._round(level)

    def _round(self, level: int) -> None:
        names, begins, first, last = self.names[-1], self.begins[-1], self.first[-1], self.last[-1]
        # Runs: their own names, and both end runs of a window are open.
        heads = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        lengths = np.diff(np.concatenate([heads, [len(names)]]))
        run = np.repeat(np.arange(len(heads)), lengths)
        named = np.where(lengths > 1, mix(names[heads] * _PAIR[1] + lengths.astype(U64)), names[heads])
        open_end = np.concatenate([run + 1, [len(heads), len(heads)]])
        first = open_end[np.minimum(first, len(names))]
        last = np.concatenate([[0], run])[last]
        # Pairs of a left (0) and a right (1) symbol.
        right = (mix(named ^ U64(_FIRST + level)) & U64(1)).astype(bool)
        first = first + np.concatenate([right, [False]])[np.minimum(first, len(heads))]
        last = last - np.concatenate([[False], ~right])[last]
        joins = np.concatenate([~right[:-1] & right[1:], [False]])
        begin = ~np.concatenate([[False], joins[:-1]])
        places = np.flatnonzero(begin)
        symbol = np.cumsum(begin) - 1
        pair = joins[places]
        after = named[np.minimum(places + 1, len(named) - 1)]
        self.names.append(np.where(pair, mix(named[places] * _PAIR[0] + after * _PAIR[1] + U64(level)), named[places]))
        self.begins.append(begins[heads][places])
        self.first.append(np.concatenate([symbol, [len(places), len(places)]])[first])
        self.last.append(np.where(last > 0, np.concatenate([[0], symbol + 1])[last], 0))


def _least(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per range [low, high) the index of the name with the least hash, the leftmost of equals."""
    order = (mix(names) >> U64(24) << U64(24)) | np.arange(len(names), dtype=U64)
    width = high - low
    best = np.zeros(len(low), U64)
    step, table = 1, order
    while len(low) and step <= int(width.max()):
        here = np.flatnonzero((width >= step) & (width < 2 * step))
        best[here] = np.minimum(table[low[here]], table[high[here] - step])
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        step *= 2
    return (best & U64((1 << 24) - 1)).astype(np.int64)


def window_anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of every window of a sequence of words, and its anchor's place.

    Equal windows have equal keys, and their anchors as far apart as their starts.
    """
    count = len(words) - window + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    parse, half = Parse(words), window // 2
    around = run_hashes(words, half, _SECOND)
    keys, places, todo = np.zeros(count, U64), np.zeros(count, np.int64), np.arange(count)
    for level in range(_ROUNDS, -1, -1):
        low, high = parse.first[level][todo], parse.last[level][todo + window]
        told = low < high
        rows, low, high = todo[told], low[told], high[told]
        todo = todo[~told]
        spot = _least(parse.names[level], low, high)
        anchor = parse.begins[level][spot]
        before = anchor - rows >= half
        context = around[np.where(before, anchor - half, anchor)]
        keys[rows] = mix(context + parse.names[level][spot] * _PAIR[0] + before.astype(U64) + U64(2 * level))
        places[rows] = anchor
    return keys, places


def window_keys(words: np.ndarray, window: int) -> np.ndarray:
    return window_anchors(words, window)[0]


def text_anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``window_anchors`` for a text of any length, in parts that overlap by a window."""
    if len(words) <= _WORDS:
        return window_anchors(words, window)
    begins = range(0, len(words) - window + 1, _WORDS)
    keys, places = zip(*(window_anchors(words[s:s + _WORDS + window - 1], window) for s in begins))
    return np.concatenate(keys), np.concatenate([p + s for p, s in zip(places, begins)])


def text_keys(words: np.ndarray, window: int) -> np.ndarray:
    return text_anchors(words, window)[0]


def batch_keys(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of all texts of a block: text, start, key and the anchor's place."""
    if len(words) <= _WORDS:
        starts = np.arange(max(0, len(words) - window + 1))
        text = np.searchsorted(at, starts, "right") - 1
        inside = starts + window <= at[text + 1]
        keys, places = window_anchors(words, window)
        return text[inside], (starts - at[text])[inside], keys[inside], places[inside]
    keys, places = zip(*(text_anchors(words[a:b], window) for a, b in zip(at[:-1], at[1:])))
    sizes = [len(k) for k in keys]
    starts = np.concatenate([np.arange(n) for n in sizes])
    return np.repeat(np.arange(len(keys)), sizes), starts, np.concatenate(keys), np.concatenate(places)


def _block_rows(batch, names=("doc_id", "text")) -> Iterator[tuple[slice, list[bytes]]]:
    texts = [raw(t) for t in batch.column("text").to_pylist()]
    for s in blocks(texts, _BYTES, _ROWS):
        yield s, texts[s]


def repeated_keys(docs: DataFrame, window: int) -> DataFrame:
    """Per document that has some: doc_id and the keys of its windows that occur elsewhere too, or twice in it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            for s, texts in _block_rows(batch):
                words, at = word_hashes(texts)
                text, start, key, place = batch_keys(words, at, window)
                # A stretch of neighbouring windows with one key and one anchor is one occurrence.
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1])
                text, key = text[new], key[new]
                order = np.lexsort((ids[s][text], key))
                text, key = text[order], key[order]
                lead = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
                group = np.cumsum(lead) - 1
                several = np.bincount(group)[group] > 1 if len(key) else np.zeros(0, bool)
                # Keys that this block repeats are known already, once per document; of each key one row goes on to the others.
                doc = ids[s][text]
                several[1:] &= lead[1:] | (doc[1:] != doc[:-1])
                pick = np.concatenate([np.flatnonzero(several), np.flatnonzero(lead)])
                known = np.concatenate([np.ones(int(several.sum()), bool), np.zeros(int(lead.sum()), bool)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s][text[pick]]), pa.array(key[pick].view(np.int64)), pa.array(known)], ["doc_id", "key", "known"])

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, key long, known boolean")
    same = Window.partitionBy("key", F.when(F.col("known"), F.col("doc_id")))
    told = rows.withColumn("n", F.count("*").over(same)).filter("known OR n > 1")
    return told.groupBy("doc_id").agg(F.collect_set("key").alias("_keys"))


def _windows(words: np.ndarray, at: np.ndarray, keys: list[np.ndarray], window: int):
    """Text, start and two hashes of the windows whose key is among their text's ``keys``."""
    text, start, key, _ = batch_keys(words, at, window)
    counts = [len(k) for k in keys]
    if not sum(counts) or not len(key):
        return text[:0], start[:0], key[:0], key[:0]
    # Both sides as (text, key) in one sorted column: a key's text is mixed into it.
    mine = mix(key + mix(text.astype(U64) + U64(1)))
    wanted = np.sort(mix(np.concatenate(keys).view(U64) + mix(np.repeat(np.arange(len(keys)), counts).astype(U64) + U64(1))))
    spot = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
    found = wanted[spot] == mine
    text, start = text[found], start[found]
    place = at[text] + start
    return text, start, run_hashes(words, window, _FIRST)[place], run_hashes(words, window, _SECOND)[place]


def _lists(column) -> list[np.ndarray]:
    return [np.array(v or (), np.int64) for v in column.to_pylist()]


def first_documents(flagged: DataFrame, window: int) -> DataFrame:
    """Per document: the windows (their first hash) that occur in no smaller document."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = np.array(batch.column("doc_id").to_pylist(), np.int64), _lists(batch.column("_keys"))
            for s, texts in _block_rows(batch):
                words, at = word_hashes(texts)
                text, _, one, two = _windows(words, at, keys[s], window)
                order = np.lexsort((ids[s][text], two, one))
                text, one, two = text[order], one[order], two[order]
                lead = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[lead].view(np.int64)), pa.array(two[lead].view(np.int64)), pa.array(ids[s][text[lead]])],
                    ["one", "two", "doc_id"])

    rows = flagged.mapInArrow(run, "one long, two long, doc_id long")
    return rows.groupBy("one", "two").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(
        F.collect_list("one").alias("_own"))


def _kept_words(texts: list[bytes], keys: list[np.ndarray], own: list[np.ndarray], window: int) -> Iterator[tuple[int, int, bytes]]:
    """Per text: words, removed words, and the kept ones joined by a blank."""
    marked = [i for i, k in enumerate(keys) if len(k)]
    gone: dict[int, np.ndarray] = {}
    if marked:
        words, at = word_hashes([texts[i] for i in marked])
        text, start, one, _ = _windows(words, at, [keys[i] for i in marked], window)
        for t, i in enumerate(marked):
            mine = slice(*np.searchsorted(text, [t, t + 1]))
            starts, names = start[mine], one[mine]
            kept = np.zeros(len(names), bool)
            first = np.unique(names, return_index=True)[1]
            kept[first] = np.isin(names[first], own[i].view(U64))
            change = np.zeros(at[t + 1] - at[t] + 1, np.int64)
            np.add.at(change, starts[~kept], 1)
            np.add.at(change, starts[~kept] + window, -1)
            gone[i] = np.cumsum(change[:-1]) > 0
    for i, t in enumerate(texts):
        words = t.split()
        if i in gone and gone[i].any():
            kept = [words[k] for k in np.flatnonzero(~gone[i])]
            yield len(words), len(words) - len(kept), b" ".join(kept)
        else:
            yield len(words), 0, b" ".join(words)


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with kept_text (words joined by a blank), n_words and n_removed."""
    docs = without(docs, "kept_text", "n_words", "n_removed", "_keys", "_own")
    dealt = docs.repartition("doc_id")
    keys = written(repeated_keys(docs, window), "repeat-keys")
    own = first_documents(dealt.select("doc_id", "text").join(keys, "doc_id"), window)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, out = _lists(batch.column("_keys")), _lists(batch.column("_own")), []
            for s, texts in _block_rows(batch):
                out += _kept_words(texts, keys[s], own[s], window)
            rest = [n for n in batch.schema.names if n not in ("_keys", "_own")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array([o[2].decode("utf-8", "replace") for o in out], pa.string()),
                 pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())],
                [*rest, "kept_text", "n_words", "n_removed"])

    schema = docs.schema
    for name, kind in (("kept_text", "string"), ("n_words", "long"), ("n_removed", "long")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return dealt.join(keys, "doc_id", "left").join(own, "doc_id", "left").select(*docs.columns, "_keys", "_own").mapInArrow(run, schema)


def digests(docs: DataFrame, window: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of its kept words."""
    return remove_repeats(docs.select("doc_id", "text"), window).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
