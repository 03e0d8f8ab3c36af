"""CSV records whose quoted cells hold line breaks, read by blocks of a file.

A line leaves a cell open or not, depending only on whether it began inside one. So every
file block is first reduced to one pair: the state behind it if it begins outside of a
cell, and if it begins inside. Chaining the pairs of a file tells where each block begins;
then all blocks are cut into records at once. A record that crosses blocks comes as one
fragment per block, and the fragments, at most two a block, are put together. Files stay
splittable: no task reads more than its own block.

Quotes count where a cell begins with one; elsewhere they are ordinary characters, and a
doubled quote inside such a cell is one quote. A line break inside a cell reads as LF,
however the file spells it. A cell that is still open at the end of the file ends there.

What passes through the driver is one row per file, and the blocks that begin inside a
cell: at most one entry for each block of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TO_CLOSING_QUOTE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_WHOLE, _HEAD, _REST = 0, 1, 2


class File(NamedTuple):
    path: str
    header: str
    broken: bool  # whether a cell may hold a line break


def lines_of(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The lines of files with path and block start; within a block, in order."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def has_lone_quote(line: Column) -> Column:
    """Whether the quotes of a line do not all pair up around whole cells."""
    single = F.replace(line, F.lit('""'), F.lit(""))
    left = F.regexp_replace(single, r'(?<![^,])"[^"]*"(?![^,])', "")
    return F.contains(line, F.lit('"')) & F.contains(left, F.lit('"'))


def files_of(spark: SparkSession, paths: str | Sequence[str]) -> list[File]:
    """Every file that has a line: its first one, and whether any line has a lone quote. One pass over the text.

    A set tells of lone quotes, since Spark would sort all lines by file for the first one beside a plain flag.
    """
    lines = lines_of(spark, paths).withColumn("id", F.monotonically_increasing_id())
    place = F.when(F.trim("value") != "", F.struct("block", "id", "value"))
    lone = F.collect_set(F.when(has_lone_quote(F.col("value")), F.lit(True)))
    found = lines.groupBy("path").agg(F.min(place).alias("first"), lone.alias("lone"))
    rows = found.select("path", F.col("first.value").alias("header"), (F.size("lone") > 0).alias("broken")).where("header IS NOT NULL").collect()
    return sorted(File(*r) for r in rows)


def open_after(line: str, inside: bool) -> bool:
    """Whether a cell is open behind a line that begins outside or ``inside`` of one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            found = _TO_CLOSING_QUOTE.match(line, at if inside else at + 1)
            if not found:
                return True
            at, inside = found.end(), False
        at = line.find(",", at) + 1
        if not at:
            return False


def is_open(text: str) -> bool:
    """Whether a record's text leaves a cell open."""
    inside = False
    for line in text.split("\n"):
        inside = open_after(line, inside)
    return inside


def first_record(lines: Sequence[str]) -> str:
    """The first record of lines that begin outside of a cell; all of them, if it doesn't end there."""
    parts, inside = [], False
    for line in lines:
        if parts or line.strip():
            parts.append(line)
            inside = open_after(line, inside)
            if not inside:
                break
    return "\n".join(parts)


def _runs(batches) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()), batch.column("value").to_pylist())


def transitions(lines: DataFrame) -> DataFrame:
    """Per block: whether a cell is open behind it, if it begins outside and if inside."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for key, line in _runs(batches):
            state = found.setdefault(key, [False, True])
            if '"' in line:
                state[0], state[1] = open_after(line, state[0]), open_after(line, state[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
             pa.array([v[0] for v in found.values()], pa.bool_()), pa.array([v[1] for v in found.values()], pa.bool_())],
            ["path", "block", "after_outside", "after_inside"])

    return lines.mapInArrow(run, "path string, block long, after_outside boolean, after_inside boolean")


def open_blocks(pairs: DataFrame) -> DataFrame:
    """The blocks (path, block) that begin inside a cell.

    A pair either keeps the state, turns it, or sets it. The state behind a block is that of the
    last setting one (outside at the file's begin), turned as often as there are turning ones since.
    """
    sets = F.col("after_outside") == F.col("after_inside")
    turns = F.when(~sets & F.col("after_outside"), 1).otherwise(0)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = pairs.withColumn("turned", F.sum(turns).over(upto) % 2)
    # What a setting block's state would have been at the file's begin, turned by all turning blocks up to it.
    base = F.last(F.when(sets, (F.col("after_outside").cast("int") + F.col("turned")) % 2), ignorenulls=True).over(upto)
    after = (F.coalesce(base, F.lit(0)) + F.col("turned")) % 2
    before = F.lag("after", 1, 0).over(Window.partitionBy("path").orderBy("block"))
    return turned.withColumn("after", after).withColumn("begins", before).where("begins = 1").select("path", "block")


def records_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All records of files but blank ones: value, path, block and nth, the record's number in the block it begins in.

    The header is one of them: the record 0 of block 0.
    """
    lines = lines_of(spark, paths)
    inside = {(r.path, r.block) for r in open_blocks(transitions(lines)).toLocalIterator()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block, parts, is_open, nth, kind = None, [], False, 0, _WHOLE

        def close(ended: bool) -> None:
            nonlocal parts, nth
            if parts:
                out.append(("\n".join(parts), *block, nth, kind if kind == _REST else _WHOLE if ended else _HEAD))
                nth += kind != _REST
                parts = []

        for key, line in _runs(batches):
            if key != block:
                close(False)
                block, nth, is_open = key, 0, key in inside
                kind = _REST if is_open else _WHOLE
            if not parts and not is_open and not line.strip():
                continue
            parts.append(line)
            is_open = open_after(line, is_open)
            if not is_open:
                close(True)
                kind = _WHOLE
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        close(False)
        yield _batch(out)

    cut = lines.mapInArrow(run, "value string, path string, block long, nth long, kind int")
    if not inside:  # a head without a rest is a cell that the file leaves open
        return cut.drop("kind")
    order = Window.partitionBy("path").orderBy("block", F.col("kind").desc())
    heads = cut.where(f"kind <> {_WHOLE}").withColumn("head", F.sum(F.when(F.col("kind") == _HEAD, 1).otherwise(0)).over(order))
    whole = heads.groupBy("path", "head").agg(
        F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"), F.min("block").alias("block"),
        F.max(F.when(F.col("kind") == _HEAD, F.col("nth"))).alias("nth"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")
    return cut.where(f"kind = {_WHOLE}").drop("kind").unionByName(whole.select(joined, "path", "block", "nth"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["value", "path", "block", "nth", "kind"])
