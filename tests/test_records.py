"""Feeds with quoted line breaks, read in small blocks, against a plain reader."""

import csv
import io
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from twinledger import Options
from twinledger.sources import feeds, records


@contextmanager
def small_blocks(spark, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def cells(rng, breaks):
    some = ["a", "", "x, y", 'say "no"', '"', '""', " pad ", "é日", "1.50", 'end"', '"start', "'", "x" * 40]
    return some + (["two\nlines", "\n", "a\n\n\nb", 'q"\n"r', "\n,\n", '"\n', "long\n" * 60, ",\"\n\",\n"] if breaks else [])


def expected(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r and not (len(r) == 1 and not r[0].strip())]
    return [[c.replace("\r\n", "\n").replace("\r", "\n") for c in r] for r in rows]


@pytest.mark.parametrize("seed, ending, size", [(1, "\n", 64), (2, "\r\n", 300), (3, "\n", 1000), (4, "\n", 1 << 20), (5, "\r\n", 37)])
def test_against_plain_reader(spark, tmp_path, seed, ending, size):
    rng, want = random.Random(seed), {}
    for k, share in enumerate((0.0, 0.05, 0.6, 1.0)):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=ending)
        writer.writerow(["n", "one", "two"])
        for n in range(40):
            writer.writerow([n, *rng.choices(cells(rng, rng.random() < share), k=2)])
            if rng.random() < 0.1:
                out.write(ending)
        (tmp_path / f"f {k}+[x].csv").write_text(out.getvalue(), newline="")
        want[f"f {k}+[x].csv"] = expected(out.getvalue())[1:]
    with small_blocks(spark, size):
        scan = feeds.scan_csv(spark, str(tmp_path))
        assert scan.columns == ["n", "one", "two", "_row", "_file"]
        found = scan.collect()
    got = {name: [] for name in want}
    for r in sorted(found, key=lambda r: r["_row"]):
        got[r["_file"]].append([r["n"], r["one"], r["two"]])
    assert got == want
    assert sorted(r["_row"] for r in found) == sorted(list(range(1, 41)) * 4)


def test_lines_that_leave_a_cell_open(spark):
    lines = {
        "a,b": (False, True), '"a",b': (False, False), '"a,b': (True, False), 'a",b': (False, False), 'a,"b""': (True, False),
        'x"y,"z': (True, True), '5","open': (True, True), 'close",5"': (False, False), '"': (True, False), '""': (False, True),
        '"""': (True, False), "": (False, True), 'a,"': (True, False), '","': (False, True), 'in","next","': (True, True),
    }
    for line, (outside, inside) in lines.items():
        assert (records.open_after(line, False), records.open_after(line, True)) == (outside, inside), line
    found = spark.createDataFrame([(x,) for x in lines], "value string").select("value", records.has_lone_quote(F.col("value")).alias("lone"))
    lone = {r.value: r.lone for r in found.collect()}
    # A line that leaves a cell open is never taken for a plain one.
    assert all(lone[line] for line, (outside, _) in lines.items() if outside)
    assert not lone["a,b"] and not lone['"a",b'] and not lone[""]


def test_unlike_headers(spark, tmp_path):
    (tmp_path / "g01.csv").write_text("A,B,C\n1,2,3\n")
    (tmp_path / "g02.csv").write_text("c, b ,D\n6,5,7\n")
    (tmp_path / "g03.csv").write_text('A,B,C\n"8\n8",9,10\n')
    (tmp_path / "g04.csv").write_text("")
    rows = feeds.scan_kind(spark, str(tmp_path), "Microsoft")
    assert rows.columns == ["A", "B", "C", "D", "_row", "_file"]
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("", "5", "6", "7", 1, "g02.csv"), ("1", "2", "3", "", 1, "g01.csv"), ("8\n8", "9", "10", "", 1, "g03.csv")]
    with pytest.raises(ValueError, match="No header"):
        feeds.scan_csv(spark, str(tmp_path / "g04.csv"))


def test_header_with_line_break_and_open_end(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('"A\nB",C\n1,"2\n3"\n4,"open\nto the end\n')
    rows = feeds.scan_csv(spark, str(path))
    assert rows.columns == ["A\nB", "C", "_row", "_file"]
    assert sorted((r["_row"], r[0], r["C"]) for r in rows.collect()) == [(1, "1", "2\n3"), (2, "4", "open\nto the end")]
    plain = tmp_path / "y.csv"
    plain.write_text("A,B\n1,2\n")
    assert feeds.scan_csv(spark, str(plain), Options(multi_line=True)).collect() == feeds.scan_csv(spark, str(plain)).collect()


def test_rows_that_show_no_number_are_not_joined(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B\n1,2\n3,4\n")
    rows = feeds.scan_csv(spark, str(tmp_path / "x.csv"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(rows.select("A")) and "Aggregate" not in plan(rows.select("A", "_file"))
    assert "Join" in plan(rows.select("A", "_row"))
