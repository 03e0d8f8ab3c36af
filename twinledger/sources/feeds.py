"""Delimited feed scans."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as tx
from ..operators.ordinals import PLACE, block_offsets, with_row_numbers
from ..options import DEFAULTS, Options
from . import records


class UnknownSource(ValueError):
    pass


def detect_source(path: str) -> str:
    """Source kind of one file, by the start of its name."""
    name = os.path.basename(path).upper()
    for prefix, kind in fixed.FILE_PREFIXES:
        if name.startswith(prefix):
            return kind
    raise UnknownSource(f"Unable to detect source type for {name}")


def source_kind(file_name: Column) -> Column:
    """Source kind of a file name held as data, NULL when unknown."""
    name = F.upper(file_name)
    kind = F.lit(None).cast("string")
    for prefix, value in reversed(fixed.FILE_PREFIXES):
        kind = F.when(name.startswith(prefix), value).otherwise(kind)
    return kind


def folder_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with their source kind, from the listing alone: no file is opened."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )
    return files.withColumn("source_type", source_kind(F.col("file_name")))


def scan_places(spark: SparkSession, path: str | Sequence[str], options: Options = DEFAULTS) -> DataFrame:
    """All columns as text, with file name and the place each row was read at.

    Header text is cleaned; short rows are filled with blanks and surplus fields dropped. Files
    with other columns, or the same in another order, are read apart and united by name;
    missing columns are blank. One pass over the text finds every file's header and whether
    a quoted cell may hold a line break; such files are cut into records by ``records``, all
    others by line. Either way a file is read block by block.
    """
    files = records.files_of(spark, path)
    if not files:
        raise ValueError(f"No header line in {path}")
    groups: dict[tuple, list[records.File]] = {}
    for file in files:
        broken = file.broken or options.multi_line
        groups.setdefault((_header(spark, file), broken), []).append(file)
    scans, spelling = [], {}
    for (names, broken), members in groups.items():
        repeated = sorted({n for n in names if [x.lower() for x in names].count(n.lower()) > 1})
        if repeated:
            raise ValueError(f"Repeated column names: {', '.join(repeated)}")
        names = [spelling.setdefault(n.lower(), n) for n in names]
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        whole = path if len(groups) == 1 else [_literal(f.path) for f in members]
        if broken:
            cut = records.records_of(spark, whole).where("block <> 0 OR nth <> 0")
            cells = F.from_csv("value", schema, {"escape": '"', "multiLine": "true"})
            scan = cut.select(cells.alias("c"), F.substring_index("path", "/", -1).alias("_file"), F.struct("path", "block", "nth").alias(PLACE))
            scan = scan.select("c.*", "_file", PLACE)
        else:
            reader = spark.read.schema(schema).option("header", True).option("escape", '"')
            scan = reader.csv(whole).select("*", F.col("_metadata.file_name").alias("_file"), F.struct(
                F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("nth")).alias(PLACE))
        scans.append(scan.select(*[F.coalesce(f"c{i}", F.lit("")).alias(n) for i, n in enumerate(names)], "_file", PLACE))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    cells = [c for c in rows.columns if c not in ("_file", PLACE)]
    return rows.select(*[(tx.cell(rows, c) if len(scans) > 1 else tx.column(rows, c)).alias(c) for c in cells], _spelt("_file").alias("_file"), PLACE)


def _spelt(name: str) -> Column:
    """A file's name from the form that Spark gives it, which is that of a URL."""
    return F.when(F.contains(name, F.lit("%")), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(F.col(name))


def with_file_name(df: DataFrame) -> DataFrame:
    """Rows with the name of the file they were read from, as their place tells it."""
    return df.withColumn("_file", F.substring_index(f"{PLACE}.path", "/", -1)).withColumn("_file", _spelt("_file"))


def scan_csv(spark: SparkSession, path: str | Sequence[str], options: Options = DEFAULTS) -> DataFrame:
    """``scan_places`` with the row's number in its file; rows that don't show it are not joined for it."""
    rows = scan_places(spark, path, options)
    names = [c for c in rows.columns if c not in ("_file", PLACE)]
    return with_row_numbers(rows, block_offsets(rows)).select(*[tx.column(rows, n) for n in names], "_row", "_file")


def _header(spark: SparkSession, file: records.File) -> tuple[str, ...]:
    """The column names of a file. A header of several lines is read on until its last cell closes."""
    text, many = file.header, 16
    while file.broken and records.is_open(text) and many < 1 << 20:
        lines = records.lines_of(spark, _literal(file.path)).where("block = 0").limit(many).collect()
        text, many = records.first_record([r.value for r in lines]), many * 4
    return tuple(tidy_header(n) for n in next(csv.reader(io.StringIO(text, newline=""))))


def _literal(path: str) -> str:
    """A file's path as the readers take it: decoded, its pattern characters taken as they are."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(path))


def tidy_header(name: str) -> str:
    kept = "".join(c for c in name if c in "\r\n\t" or (c.isprintable() or c.isspace()))
    return kept.strip()


def scan_kind(spark: SparkSession, folder: str, kind: str, options: Options = DEFAULTS) -> DataFrame:
    """All files of one source kind in a folder; kinds differ in their headers, so each is its own read."""
    prefix = next(p for p, k in fixed.FILE_PREFIXES if k == kind)
    either = "".join(f"[{c.lower()}{c}]" if c.isalpha() else c for c in prefix)
    return scan_csv(spark, os.path.join(folder, f"{either}*"), options)
