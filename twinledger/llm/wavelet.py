"""Token ids in files of wavelet matrices.

Documents are put in ascending order of doc_id by range partitioning, encoded, and laid
end to end into shards of about ``shard_tokens`` ids (a document is never split). A
shard is one self-contained blob: an index of its documents, and one bit-plane per bit
of an id, highest first. Ids are moved behind each other plane by plane, those with a 0
before those with a 1, so rank on the planes gives an id (access), the number of its
occurrences before a place (rank) and, going back up, the place of its k-th occurrence
(select). Planes are cut into blocks of 65,536 bits, compressed one by one, with the
number of ones before each block: a look-up opens one block per plane. A table file
holds one row per shard, so readers fetch whole shards or none.

Defined cases: null or empty text is the closing id alone; null doc_ids come first; repeated rows are documents
of their own, in any order among themselves; a very long text makes one large shard; columns other than
doc_id and text are not read, whatever their names; an empty table gives an empty file table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.scratch import new_path, written
from twinledger.llm.tokens import encoder, in_blocks

_BLOCK = 2_000_000
_BITS = 16
_PLANE_BYTES = 1 << 13  # of a block
_MAGIC = b"WMX1"
_NO_ID = -(1 << 63)  # stands for a null doc_id


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The blob of a shard: ids below 65,536, with the ids and lengths of its documents."""
    pack = zstandard.ZstdCompressor(level=1)
    index = pack.compress(np.concatenate([doc_ids.astype("<i8"), lengths.astype("<i8")]).tobytes())
    head, body = [], []
    values = ids.astype(np.uint16)
    for shift in range(_BITS - 1, -1, -1):
        ones = (values >> shift & 1).astype(bool)
        plane = np.packbits(ones)
        values = np.concatenate([values[~ones], values[ones]])
        starts = range(0, len(plane), _PLANE_BYTES)
        blocks = [pack.compress(plane[s:s + _PLANE_BYTES].tobytes()) for s in starts]
        held = [int(np.count_nonzero(ones[8 * s:8 * (s + _PLANE_BYTES)])) for s in starts]
        head.append(np.array([(len(b), n) for b, n in zip(blocks, held)], "<u4").reshape(-1, 2))
        body += blocks
    heads = b"".join(h.tobytes() for h in head)
    return _MAGIC + struct.pack("<qqq", len(ids), len(doc_ids), len(index)) + index + heads + b"".join(body)


class Shard:
    """Reads a blob; blocks are opened on demand."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        self.size, docs, index = struct.unpack_from("<qqq", blob, 4)
        self._blob, self._open = blob, zstandard.ZstdDecompressor()
        both = np.frombuffer(self._open.decompress(blob[28:28 + index]), "<i8")
        self.doc_ids, self.lengths = both[:docs], both[docs:]
        self._blocks = -(-(-(-self.size // 8)) // _PLANE_BYTES)
        table = np.frombuffer(blob, "<u4", 2 * _BITS * self._blocks, 28 + index).reshape(_BITS, self._blocks, 2).astype(np.int64)
        begin = 28 + index + 8 * _BITS * self._blocks
        ends = begin + np.cumsum(table[:, :, 0].ravel())
        self._at = np.concatenate([[begin], ends])
        self._ones = np.concatenate([np.zeros((_BITS, 1), np.int64), np.cumsum(table[:, :, 1], axis=1)], axis=1)

    def _bits(self, plane: int, block: int) -> np.ndarray:
        k = plane * self._blocks + block
        raw = self._open.decompress(self._blob[self._at[k]:self._at[k + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8))

    def _plane(self, plane: int) -> np.ndarray:
        held = [self._bits(plane, b) for b in range(self._blocks)]
        return np.concatenate([np.zeros(0, np.uint8), *held])[:self.size].astype(bool)

    def _zeros(self, plane: int) -> int:
        return self.size - int(self._ones[plane, -1])

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, 8 * _PLANE_BYTES)
        inside = int(np.count_nonzero(self._bits(plane, block)[:rest])) if rest else 0
        return int(self._ones[plane, block]) + inside

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for plane in range(_BITS):
            block, rest = divmod(i, 8 * _PLANE_BYTES)
            bit = int(self._bits(plane, block)[rest])
            ones = self._rank1(plane, i)
            i = self._zeros(plane) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` stands before place ``i``."""
        first, last = 0, i
        for plane in range(_BITS):
            a, b = self._rank1(plane, first), self._rank1(plane, last)
            if value >> (_BITS - 1 - plane) & 1:
                first, last = self._zeros(plane) + a, self._zeros(plane) + b
            else:
                first, last = first - a, last - b
        return last - first

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the plane's k-th (from 0) ``bit``."""
        before = self._ones[plane] if bit else np.minimum(
            np.arange(self._blocks + 1) * 8 * _PLANE_BYTES, self.size) - self._ones[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * 8 * _PLANE_BYTES + int(np.flatnonzero(self._bits(plane, block) == bit)[k - before[block]])

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        first = 0
        for plane in range(_BITS):
            ones = self._rank1(plane, first)
            first = self._zeros(plane) + ones if value >> (_BITS - 1 - plane) & 1 else first - ones
        place = first + k
        for plane in range(_BITS - 1, -1, -1):
            bit = value >> (_BITS - 1 - plane) & 1
            place = self._select(plane, bit, place - self._zeros(plane) * bit)
        return place

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """All ids in order, rebuilt from the lowest plane up."""
        values = np.zeros(self.size, np.uint16)
        for plane in range(_BITS - 1, -1, -1):
            ones, z = self._plane(plane), self._zeros(plane)
            above = np.empty_like(values)
            above[~ones] = values[:z]
            above[ones] = values[z:] | np.uint16(1 << (_BITS - 1 - plane))
            values = above
        return values


def write(
    docs: DataFrame, file: str, path: str | None = None, end: int = 1, shard_tokens: int = 1 << 20,
) -> None:
    """Writes the shards of all documents to the table file: part, shard, n_tokens, n_docs, blob."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    closing = np.array([end], "<u4").tobytes()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("blob", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encode = encoder(path, False).encode
        ids, names, held = [], [], 0

        def shards(least: int):
            nonlocal shard, ids, names, held
            if held > least:
                blob = build(np.concatenate(ids), np.array(names, np.int64), np.array([len(i) for i in ids]))
                yield pa.RecordBatch.from_pydict(
                    {"part": [part], "shard": [shard], "n_tokens": [held], "n_docs": [len(ids)], "blob": [blob]}, schema)
                shard, ids, names, held = shard + 1, [], [], 0

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            all_names = [_NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            for s in in_blocks(texts, _BLOCK):
                for name, raw in zip(all_names[s], encode(texts[s])):
                    ids.append(np.frombuffer(raw + closing, "<u4").astype(np.uint16))
                    names.append(name)
                    held += len(ids[-1])
                    yield from shards(shard_tokens - 1)
        yield from shards(0)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, "part int, shard int, n_tokens long, n_docs long, blob binary").write.option(
        "compression", "none").parquet(file)


def read(spark, file: str) -> DataFrame:
    """Per document of a table file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    table = spark.read.parquet(file)
    in_order = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    bases = table.select("part", "shard", "n_tokens").join(parts, "part").select(
        "part", "shard", (F.col("first") + F.coalesce(F.sum("n_tokens").over(in_order), F.lit(0))).alias("base"))
    bases = written(bases, "wavelet-bases")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("blob")):
                shard = Shard(blob.as_py())
                wide = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                each = [wide[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.doc_ids == _NO_ID), pa.array(base + starts), pa.array(shard.lengths),
                     pa.array([zlib.crc32(i) for i in each], pa.int64()), pa.array(each, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return table.join(bases, ["part", "shard"]).select("base", "blob").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` to a new table file in the shared folder and reads it back."""
    file = new_path(docs.sparkSession, "wavelet")
    write(docs, file, **options)
    return read(docs.sparkSession, file)
