"""Benchmark decontamination with a broadcast hash set of word windows.

Words are stretches of digits, letters and everything beyond ASCII, with A-Z lower-cased. A
window is ``size`` consecutive words of a benchmark item, or all words of a shorter one. The
windows' 64-bit hashes form a set in front of which stands a bit table; each document's
windows of the same lengths are looked up in it, all those found are verified word by word
against the item's own words, and every document word inside a verified window is hit.
Documents are scanned where they are, without any shuffle.

What is broadcast is bounded: items are cut into overlapping pieces of some ten kilobytes, the
pieces' bytes are counted on the cluster, and only up to ``most_bytes`` of them are held in one set.
A larger benchmark is dealt into parts by hash; each part is a scan of its own that adds to
the hits of those before, so the result is the same and only the number of scans grows.

Defined cases: null text has no words; a row without item_id hits words but is in no list of
items; rows of one item_id are one item; repeated documents each get their hits; texts of any
length are scanned whole; columns of docs that have the name of an added one, in any case, are
replaced; further columns of the benchmark are ignored; an empty benchmark hits nothing, and
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from twinledger.llm.scratch import without, written
from twinledger.llm.words import U64, blocks, raw, run_hashes, word_hashes

_BYTES, _ROWS = 2_000_000, 4096
_PIECE = 8192  # words of a benchmark item that are kept together
_ODD = 0x9FB21C651E98DF25
#: A-Z lower-cased; what is no digit, letter or beyond ASCII becomes a blank.
_FOLD = bytes(
    b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))

_KINDS = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.string()))


class Windows(NamedTuple):
    """The windows of one length, sorted by hash; where a hash has several texts, each is an entry."""

    length: int
    hashes: np.ndarray
    starts: np.ndarray  # bytes of the entry's words in ``words``
    ends: np.ndarray
    items: np.ndarray  # numbers of the entries' items, entry after entry
    bounds: np.ndarray
    table: np.ndarray  # whether a hash with these first bits may be there
    shift: int


class HashSet(NamedTuple):
    words: bytes
    item_ids: list[str]
    windows: list[Windows]


def normalised(text: str | None) -> bytes:
    return raw(text).translate(_FOLD)


def pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """The items' words in overlapping pieces of bounded length: item_id (as text) and words, joined by a blank."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("item_id").to_pylist(), []
            for i, text in zip(ids, batch.column("text").to_pylist()):
                words = normalised(text).split()
                for start in range(0, max(1, len(words) - size + 1) if words else 0, _PIECE):
                    out.append((i, b" ".join(words[start:start + _PIECE + size - 1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["item_id", "words"])

    known = benchmark.select(F.col("item_id").cast("string"), "text")
    return known.mapInArrow(run, "item_id string, words binary").distinct()


def hash_set(found: list[tuple[str | None, bytes]], size: int) -> HashSet:
    """The set of the windows of pieces of items."""
    texts = [words for _, words in found]
    item_ids = sorted({i for i, _ in found if i is not None})
    numbers = {i: k for k, i in enumerate(item_ids)}
    of_piece = np.array([numbers.get(i, -1) for i, _ in found], np.int64)
    words = b" ".join(texts)
    hashes, at = word_hashes(texts)
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    begin, end = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(words)]])
    counts, windows = np.diff(at), []
    for length in sorted({min(size, c) for c in counts.tolist()}):
        whole = np.flatnonzero(counts >= size if length == size else counts == length)
        many = counts[whole] - length + 1
        piece = np.repeat(whole, many)
        place = at[piece] + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        name, starts, ends = run_hashes(hashes, length, _ODD)[place], begin[place], end[place + length - 1]
        order = np.argsort(name, kind="stable")
        name, starts, ends, item = name[order], starts[order], ends[order], of_piece[piece][order]
        # Entries: the first window of each hash, and of equal hashes each further text.
        entry = np.cumsum(np.concatenate([[True], name[1:] != name[:-1]])) - 1
        texts_of: dict[bytes, int] = {}
        first = np.concatenate([[True], entry[1:] != entry[:-1]])
        fresh = first.copy()
        for k in np.flatnonzero(~first).tolist():
            if first[k - 1]:
                texts_of = {words[starts[k - 1]:ends[k - 1]]: k - 1}
            known = texts_of.setdefault(words[starts[k]:ends[k]], k)
            fresh[k] = known == k
            entry[k] = known
        entry[first] = np.flatnonzero(first)
        kept = np.flatnonzero(fresh)
        entry = np.searchsorted(kept, entry)
        pairs = np.unique(np.stack([entry, item], 1)[item >= 0], axis=0)
        shift = 64 - max(16, int(len(kept) * 16).bit_length())
        table = np.zeros(1 << (64 - shift), bool)
        table[name >> U64(shift)] = True
        windows.append(Windows(length, name[kept], starts[kept], ends[kept], pairs[:, 1],
                               np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1)), table, shift))
    return HashSet(words, item_ids, windows)


def _candidates(known: HashSet, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, first word in it, which of ``known.windows`` and which entry, for all windows whose hash is known."""
    texts, rows = [], []
    for kind, w in enumerate(known.windows):
        names = run_hashes(hashes, w.length, _ODD)
        place = np.flatnonzero(w.table[names >> U64(w.shift)])
        low = np.searchsorted(w.hashes, names[place], "left")
        many = np.searchsorted(w.hashes, names[place], "right") - low
        place, entry = np.repeat(place, many), np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        text = np.searchsorted(at, place, "right") - 1
        inside = place + w.length <= at[text + 1]
        text, place, entry = text[inside], place[inside], entry[inside]
        texts.append(text)
        rows.append(np.stack([text, place - at[text], np.full(len(text), kind), entry], 1))
    if rows:
        yield from np.concatenate(rows)[np.argsort(np.concatenate(texts), kind="stable")].tolist()


def hits(known: HashSet, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Per normalised text its words, which of them are hit, and the items of the windows that occur."""
    hashes, at = word_hashes(texts)
    found: dict[int, list] = {}
    for text, *window in _candidates(known, hashes, at):
        found.setdefault(text, []).append(window)
    for i, text in enumerate(texts):
        count = int(at[i + 1] - at[i])
        if i not in found:
            yield count, np.zeros(0, bool), []
            continue
        words, change, items = text.split(), np.zeros(count + 1, np.int64), set()
        for start, kind, entry in found[i]:
            w = known.windows[kind]
            if b" ".join(words[start:start + w.length]) == known.words[w.starts[entry]:w.ends[entry]]:
                change[start] += 1
                change[start + w.length] -= 1
                items.add((kind, entry))
        numbers = {n for kind, e in items for n in known.windows[kind].items[known.windows[kind].bounds[e]:known.windows[kind].bounds[e + 1]].tolist()}
        yield count, np.cumsum(change[:-1]) > 0, sorted(known.item_ids[n] for n in numbers)


def _spans(hit: np.ndarray, before: list[dict]) -> list[dict]:
    """The stretches of hit words, with those of earlier scans."""
    if before:
        hit = np.concatenate([hit, np.zeros(max(0, before[-1]["start"] + before[-1]["length"] - len(hit)), bool)])
        for span in before:
            hit[span["start"]:span["start"] + span["length"]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8)))
    return [{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a normalised text begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], np.frombuffer(text, np.uint8) == 32, [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` with n_words, hit_spans (start and length in words) and items (item_ids as text, sorted)."""
    docs = without(docs, "n_words", "hit_spans", "items")
    spark, names = docs.sparkSession, docs.columns
    cut = written(pieces(benchmark, size), "benchmark")
    total = cut.agg(F.sum(F.octet_length("words") + F.length(F.coalesce("item_id", F.lit(""))))).first()[0] or 0
    parts = 1 if total <= most_bytes else -(-2 * total // most_bytes)
    span = StructType().add("start", "long").add("length", "long")
    schema = StructType([*docs.schema.fields]).add("n_words", "long").add("hit_spans", ArrayType(span)).add("items", ArrayType(StringType()))
    part = F.pmod(F.xxhash64("item_id", "words"), F.lit(parts))
    for p in range(parts):
        rows = cut.filter(part == p).toArrow()  # at most ``most_bytes``, half of it if there are several parts
        known = spark.sparkContext.broadcast(hash_set(list(zip(rows["item_id"].to_pylist(), rows["words"].to_pylist())), size))

        def run(batches, known=known, again=p > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [normalised(t) for t in batch.column("text").to_pylist()]
                before = zip(batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist()) if again else None
                for s in blocks(texts, _BYTES, _ROWS):
                    out = []
                    for count, hit, items in hits(known.value, texts[s]):
                        spans, others = next(before) if before else ([], [])
                        out.append((count, _spans(hit, spans), sorted({*items, *others}) if others else items))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(n).slice(s.start, s.stop - s.start) for n in names),
                         *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(_KINDS))],
                        [*names, "n_words", "hit_spans", "items"])

        docs = docs.mapInArrow(run, schema)
        if p + 1 < parts:
            docs = written(docs, "decontamination")
    return docs



def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "spans") -> DataFrame:
    """``docs`` without the hit spans (``remove="spans"``) or without documents that have any (``"documents"``).

    A span goes from its first word's first byte to its last word's last; all else stays as it was, but for
    columns with the names that ``scan`` adds, which go.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    docs = without(docs, "n_words", "hit_spans", "items")
    found, schema = scan(docs, benchmark, size), docs.schema
    if remove == "documents":
        return found.filter(F.size("hit_spans") == 0).select(*schema.names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("hit_spans").to_pylist()):
                if spans:
                    whole, at, left = raw(texts[i]), 0, []
                    begin, end = _places(normalised(texts[i]))
                    for span in spans:
                        left.append(whole[at:begin[span["start"]]])
                        at = end[span["start"] + span["length"] - 1]
                    texts[i] = b"".join([*left, whole[at:]]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in schema.names], schema.names)

    return found.mapInArrow(run, schema)


def digests(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, SHA-256 of the items joined by commas, and whether any word is hit."""
    found = scan(docs.select("doc_id", "text"), benchmark, size)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))
