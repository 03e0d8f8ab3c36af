"""Packing of token ids into sequences by minimum bin slack.

Documents are cut into pieces of a full sequence and one remainder. How many
remainders there are of each length is all that the packing depends on: at most
``capacity - 1`` counts, however many documents. For each window in turn, the longest
length left is set, and a subset-sum table over the other lengths left, as a bitset
with multiplicities, gives the multiset of lengths that comes closest to the capacity;
the counts are found by going back through the table. A window's pattern is repeated
as often as the counts allow, so there are about as many patterns as lengths. Where
nothing fits exactly, a remainder is cut to fill the window and its tail goes back to
the counts. The very last tokens are laid into windows of powers of two.

The plan is a table of ranges: the n-th to m-th remainders of a length go to such
sequences at such offset. Remainders get their numbers from running counts per part of
the tokenised table, and find their range by a join with the plan.

Defined cases: null or empty text is a document of the closing id alone; repeated rows
are documents of their own; a very long text is encoded whole, in a block of its own, and cut
like any other; columns other than doc_id and text are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.scratch import written
from twinledger.llm.tokens import encoder, in_blocks

_BLOCK = 2_000_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes closest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, before = min(counts[length], room // length), reach
        part = 1
        while left:  # counts in binary: 1, 2, 4, ... and the rest
            part = min(part, left)
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            used[length] = n
    return used


class Plan:
    """Ranges of numbered remainders and where they go.

    Rows: length, first, last (numbers), start (in the remainder), size, copies (pieces of this kind
    per sequence), sequence (of the first piece), offset (of the first piece in a sequence).
    """

    def __init__(self, counts: dict[int, int], capacity: int, first_sequence: int = 0):
        self.capacity = capacity
        self.rows: list[tuple[int, ...]] = []
        #: By present length: (remainder's length, first number, last number, start in it).
        self.stock = {n: deque([(n, 0, c - 1, 0)]) for n, c in counts.items() if c}
        self.counts = {n: c for n, c in counts.items() if c}
        self.sequence = first_sequence
        self._size = self._room = 0  # of the last windows
        while self.counts:
            self._window()

    def _take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        queue = self.stock[length]
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
        while n:
            origin, first, last, start = queue.popleft()
            if last - first + 1 > n:
                queue.appendleft((origin, first + n, last, start))
                last = first + n - 1
            n -= last - first + 1
            yield origin, first, last, start

    def _place(self, length: int, per: int, times: int, offset: int, size: int | None = None) -> None:
        """``times`` sequences get ``per`` pieces each; of longer ones the first ``size`` ids, the rest goes back."""
        size = length if size is None else size
        done = 0
        for origin, first, last, start in self._take(length, per * times):
            self.rows.append((origin, first, last, start, size, per, self.sequence * per + done, offset))
            done += last - first + 1
            if size < length:
                self.stock.setdefault(length - size, deque()).append((origin, first, last, start + size))
                self.counts[length - size] = self.counts.get(length - size, 0) + last - first + 1

    def _window(self) -> None:
        seed = max(self.counts)
        left = dict(self.counts)
        left[seed] -= 1
        used = best_fill(left, self.capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        slack = self.capacity - sum(n * k for n, k in used.items())
        rest = {n: c - used.get(n, 0) for n, c in self.counts.items()}
        cut = max((n for n, c in rest.items() if c and n > slack), default=0) if slack else 0
        if slack and not cut and not any(rest.values()):
            return self._last(used)
        times = min([self.counts[n] // (k + (n == cut)) for n, k in used.items()] + ([self.counts[cut]] if cut and cut not in used else []))
        offset = 0
        for n in sorted(used, reverse=True):
            self._place(n, used[n], times, offset)
            offset += n * used[n]
        if cut:
            self._place(cut, 1, times, offset, slack)
        self.sequence += times

    def _last(self, used: dict[int, int]) -> None:
        """What does not fill a window: windows of powers of two, the largest first, so none is padded."""
        total = sum(n * k for n, k in used.items())
        for n in sorted(used, reverse=True):
            for origin, first, last, start in list(self._take(n, used[n])):
                for number in range(first, last + 1):
                    at = 0
                    while at < n:
                        if not self._room:
                            self._room = self._size = 1 << (total.bit_length() - 1)
                        size = min(n - at, self._room)
                        self.rows.append((origin, number, number, start + at, size, 1, self.sequence, self._size - self._room))
                        at, total, self._room = at + size, total - size, self._room - size
                        if not self._room:
                            self.sequence += 1


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Per document: part, place (number in its part), doc_id and ids (little-endian unsigned 16-bit), written once."""
    closing = end.to_bytes(2, "little")

    def run(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        encode = encoder(path, True).encode
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for s in in_blocks(texts, _BLOCK):
                ids = [np.frombuffer(raw, "<u4").astype("<u2").tobytes() + closing for raw in encode(texts[s])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(ids), pa.int32()), pa.array(range(place, place + len(ids)), pa.int64()),
                    batch.column("doc_id")[s], pa.array(ids, pa.binary()), pa.array([len(i) // 2 for i in ids], pa.int64()),
                ], ["part", "place", "doc_id", "ids", "n"])
                place += len(ids)

    return written(
        docs.select("doc_id", "text").mapInArrow(run, "part int, place long, doc_id long, ids binary, n long"), "pack-ids")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (16-bit).

    Vocabularies of up to 65,536 ids.
    """
    spark = docs.sparkSession
    table = tokenised(docs, path or public_tokenizers.path("byte_bpe_50k.json"), end)
    slim = table.select("part", "place", "n", (F.col("n") % capacity).alias("rest"), F.floor(F.col("n") / capacity).alias("full"))
    # Per part: how many remainders of each length, and full pieces, stand in the parts before.
    sums = written(slim.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum("full").alias("full")), "pack-counts")
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).select("part", "rest", "before")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fulls = sums.groupBy("part").agg(F.sum("full").alias("f")).select(
        "part", F.coalesce(F.sum("f").over(by_part), F.lit(0)).alias("full_before"))
    counted = sums.groupBy("rest").agg(F.sum("c").alias("c"), F.sum("full").alias("full")).collect()  # one row per length
    plan = Plan({r.rest: r.c for r in counted if r.rest}, capacity, sum(r.full for r in counted))
    ranges = spark.createDataFrame(
        plan.rows, "rest long, first long, last long, at long, size long, copies long, slot long, offset long")
    in_order = Window.partitionBy("part", "rest").orderBy("place")
    run_full = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("number", F.row_number().over(in_order) - 1).withColumn(
        "full_first", F.coalesce(F.sum("full").over(run_full), F.lit(0)))
    placed = placed.join(ahead, ["part", "rest"]).join(fulls, "part")
    placed = placed.withColumn("number", F.col("number") + F.col("before")).withColumn(
        "full_first", F.col("full_first") + F.col("full_before"))
    whole = placed.filter("full > 0").select("part", "place", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("full") - 1),
        lambda i: F.struct((i * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
                           (F.col("full_first") + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))).alias("piece"))
    tails = placed.filter("rest > 0").join(F.broadcast(ranges), "rest").filter("number BETWEEN first AND last")
    slot = F.col("slot") + F.col("number") - F.col("first")
    tails = tails.select("part", "place", F.struct(
        (F.col("full") * capacity + F.col("at")).alias("start"), F.col("size").alias("length"),
        F.floor(slot / F.col("copies")).alias("sequence_id"),
        (F.col("offset") + slot % F.col("copies") * F.col("size")).alias("offset")).alias("piece"))
    pieces = whole.unionByName(tails).groupBy("part", "place").agg(F.collect_list("piece").alias("pieces"))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("pieces")
            flat = found.flatten()
            doc = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            ids, out, sums, held = batch.column("ids"), [], [], -1
            for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist()):
                if d != held:
                    held, raw = d, np.frombuffer(ids[d].as_buffer(), "<u2")
                    wide = raw.astype("<u4")
                out.append(raw[a:a + n].tobytes())
                sums.append(zlib.crc32(wide[a:a + n]))
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(at), flat.field("start"), flat.field("length"), pa.array(sums, pa.int64()),
                batch.column("n").take(at), flat.field("sequence_id"), flat.field("offset"), pa.array(out, pa.binary())], names)

    return table.join(pieces, ["part", "place"]).select("doc_id", "ids", "n", "pieces").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
