"""Fill-in-the-middle texts by way of a piece table.

A document is a list of descriptors (buffer, begin, end) over two buffers that never
change: its own UTF-8 bytes, as they stand in the Arrow batch, and the sentinels. Cutting
splits a descriptor in two, an arrangement is a permutation of the six descriptors of
prefix, middle, suffix and the three sentinels, and hashes and outputs read the buffers
through the descriptors in their order. To restore, an output becomes a piece table of its
own: it is cut where its sentinels stand, the inverse permutation is applied, and the
sentinels are left out. No text is held more often than once beside its output.

A text that already holds a sentinel stays plain, so an output's sentinels are its only
ones: they start with the only "<" and end with the only ">" of theirs, so none can arise
across a border of two pieces.

The cuts follow from the seed and doc_id alone: the first four 8-digit groups of the hex
SHA-256 of "seed:doc_id" are two cuts, the choice of plain and the choice of arrangement.

Each row is worked on by itself, without any shuffle. Lengths and cuts are code points.

Defined cases: null text is empty; an empty text is plain; a null doc_id reads as an empty
one; equal rows give equal rows; texts of any length are cut whole, their code points
counted in parts of a few megabytes; columns of docs that have the name of an added one, in any
case, are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from twinledger.llm.scratch import without

Piece = tuple[int, int, int]  # buffer, begin, end

_PART = 1 << 22
_TEXT, _MARKS = 0, 1
_SENTINELS = b"<P><S><M>"
_SENTINEL = re.compile(b"<[PSM]>")
#: prefix, middle, suffix, <P>, <S>, <M> by number, in the order of the output.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


class PieceTable:
    """A sequence of descriptors over buffers that never change."""

    def __init__(self, buffers: list, pieces: list[Piece]):
        self.buffers, self.pieces = buffers, pieces

    def cut(self, *places: int) -> PieceTable:
        """The same bytes with a border at each of the ascending ``places``; empty pieces stay."""
        out, at, todo = [], 0, list(places)
        for buffer, begin, end in self.pieces:
            while todo and todo[0] <= at + end - begin:
                middle = begin + todo.pop(0) - at
                out.append((buffer, begin, middle))
                at, begin = at + out[-1][2] - out[-1][1], middle
            out.append((buffer, begin, end))
            at += end - begin
        return PieceTable(self.buffers, out)

    def arranged(self, order: Iterable[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def stream(self) -> Iterator[memoryview]:
        for buffer, begin, end in self.pieces:
            yield self.buffers[buffer][begin:end]

    def sha256(self) -> str:
        found = hashlib.sha256()
        for part in self.stream():
            found.update(part)
        return found.hexdigest()


def _leads(text: memoryview, begin: int, end: int) -> np.ndarray:
    """Which bytes begin a code point."""
    return (np.frombuffer(text, np.uint8, end - begin, begin) & 0xC0) != 0x80


def code_points(text: memoryview) -> int:
    return sum(int(np.count_nonzero(_leads(text, s, min(s + _PART, len(text))))) for s in range(0, len(text), _PART))


def byte_places(text: memoryview, n: int, places: list[int]) -> list[int]:
    """Where the code points of these ascending numbers begin, in a text of ``n``."""
    if n == len(text):
        return places
    out, before = [], 0
    for start in range(0, len(text), _PART):
        leads = _leads(text, start, min(start + _PART, len(text)))
        count, where = int(np.count_nonzero(leads)), None
        while len(out) < len(places) and places[len(out)] < before + count:
            where = np.flatnonzero(leads) if where is None else where
            out.append(start + int(where[places[len(out)] - before]))
        before += count
    return out + [len(text)] * (len(places) - len(out))


def arrange(text: memoryview, key: str, seed: int, share: int, spm_share: int) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Code points, form, those of prefix and middle, and the output of one document."""
    table = PieceTable([text, memoryview(_SENTINELS)], [(_TEXT, 0, len(text))])
    n = code_points(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not n or h3 % 100 >= share or _SENTINEL.search(text):
        return n, "plain", None, None, table
    form = "spm" if h4 % 100 < spm_share else "psm"
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    table = table.cut(*byte_places(text, n, [low, high]))
    table.pieces += [(_MARKS, 0, 3), (_MARKS, 3, 6), (_MARKS, 6, 9)]
    return n, form, low, high - low, table.arranged(ARRANGEMENTS[form])


def restored(output: memoryview, form: str) -> PieceTable:
    """The text from an output and its form alone."""
    table = PieceTable([output], [(0, 0, len(output))])
    if form not in ARRANGEMENTS:
        return table
    order = ARRANGEMENTS[form]
    borders = sorted(x for found in _SENTINEL.finditer(output) for x in found.span())
    pieces = table.cut(*borders[1:])  # the output begins with a sentinel: its five inner borders
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return pieces.arranged(inverse[:3])


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text, where they stand; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.view(kind):
        yield memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def _rows(
    docs: DataFrame, schema: StructType, each: Callable[[memoryview, str], tuple], keep: list[str]
) -> DataFrame:
    """Per row of ``docs`` the columns ``keep`` and what ``each`` gives for its text and its key."""
    kinds = [pa.int64() if isinstance(f.dataType, LongType) else pa.string() for f in schema.fields[len(keep):]]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = held = 0
            rows: list[tuple] = []

            def flush(end: int) -> pa.RecordBatch:
                made = [pa.array([r[k] for r in rows], pa.binary()).view(pa.string()) if kind == pa.string() else pa.array([r[k] for r in rows], kind)
                        for k, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*(batch.column(n).slice(done, end - done) for n in keep), *made], schema.names)

            for i, (text, key) in enumerate(zip(_views(batch.column("text")), batch.column("_key").to_pylist())):
                rows.append(each(text, key))
                held += len(text)
                if held > _PART:
                    yield flush(i + 1)
                    done, held, rows = i + 1, 0, []
            yield flush(batch.num_rows)

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumn("_key", key).mapInArrow(run, schema)


def _with(docs: DataFrame, **columns) -> StructType:
    schema = StructType([*docs.schema.fields])
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


def fill_in_middle(docs: DataFrame, seed: int = 1, share: int = 90, spm_share: int = 20) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output, the rearranged text.

    ``share`` percent of the documents are rearranged, ``spm_share`` percent of these suffix first.
    """
    docs = without(docs, "n", "form", "prefix_chars", "middle_chars", "output", "_key")

    def each(text: memoryview, key: str) -> tuple:
        n, form, prefix, middle, table = arrange(text, key, seed, share, spm_share)
        return n, form.encode(), prefix, middle, b"".join(table.stream())

    schema = _with(docs, n=LongType(), form=StringType(), prefix_chars=LongType(), middle_chars=LongType(), output=StringType())
    return _rows(docs, schema, each, docs.columns)


def restore(arranged: DataFrame) -> DataFrame:
    """Frames of form and output with restored, the text they were made from."""
    arranged = without(arranged, "restored", "_key")
    schema = _with(arranged, restored=StringType())

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("form").to_pylist()
            texts = [b"".join(restored(text, form or "plain").stream()) for text, form in zip(_views(batch.column("output")), forms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).view(pa.string())], schema.names)

    return arranged.mapInArrow(run, schema)


def digests(docs: DataFrame, seed: int = 1, share: int = 90, spm_share: int = 20) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, SHA-256 of the output and of the text restored from it."""
    docs = docs.select("doc_id", "text")

    def each(text: memoryview, key: str) -> tuple:
        n, form, prefix, middle, table = arrange(text, key, seed, share, spm_share)
        again = restored(memoryview(b"".join(table.stream())), form)
        return n, form.encode(), prefix, middle, table.sha256().encode(), again.sha256().encode()

    schema = _with(docs.select("doc_id"), n=LongType(), form=StringType(), prefix_chars=LongType(), middle_chars=LongType(),
                   output_sha256=StringType(), restored_sha256=StringType())
    return _rows(docs, schema, each, ["doc_id"])
