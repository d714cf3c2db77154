"""CSV grids: quoted cells in files of many blocks, against a reader of whole files."""

import csv
import io
import random

import pytest

from supplylens.sources import csvgrid, readers


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _grid(spark, path):
    cells, columns = readers.read_csv_grid(spark, str(path))
    return [[r[c] for c in columns if r[c] is not None] for r in cells.orderBy("source_file", "source_row").collect()]


@pytest.mark.parametrize("seed", range(2))
def test_quotes_over_many_blocks(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    parts = ["a", "", 'say ""', "x;y", "two\nlines", "ą", '5" pipe', "line\n\n\nline", "z" * 90, '"', "\n" * 5]
    rows = [[rng.choice(parts) for _ in range(rng.randrange(1, 5))] for _ in range(600)]
    rows[50 + seed] = ["long\n" * 900, "b"]  # one cell over several blocks
    out = io.StringIO(newline="")
    for row in rows:
        cells = [c if not any(m in c for m in ';\n') and not c.startswith('"') and rng.random() < 0.8 else '"' + c.replace('"', '""') + '"' for c in row]
        out.write(";".join(cells) + rng.choice(["\n", "\r\n"]))
    (tmp_path / "t.csv").write_bytes(("﻿" + out.getvalue()).encode())
    assert _grid(spark, tmp_path / "t.csv") == rows
    assert rows == [r or [""] for r in csv.reader(io.StringIO(out.getvalue(), newline=""), delimiter=";")]
    found = csvgrid.csv_records(spark, str(tmp_path / "t.csv")).select("source_row").collect()
    assert sorted(r.source_row for r in found) == list(range(1, 601))


def test_several_files_and_open_ends(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("a;b\n" * 300 + '"open;c\nd')
    (tmp_path / "b.csv").write_text('"x\ny";z')
    (tmp_path / "c.csv").write_text("")
    rows = [
        r for c in "abc" for r in _grid(spark, tmp_path / f"{c}.csv")]
    assert rows == [["a", "b"]] * 300 + [["open;c\nd"], ["x\ny", "z"]]
    records = csvgrid.csv_records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert records.count() == 302


def test_a_forgotten_quote_is_named(spark, tmp_path, small_blocks):
    (tmp_path / "t.csv").write_text("a;b\n" * 20 + '"a;b\n' + "a;b\n" * 2000)
    with pytest.raises(ValueError, match="t.csv"):
        csvgrid.csv_records(spark, str(tmp_path / "t.csv"))


def test_cells():
    assert csvgrid.cells_of('a;"b;""c""";d"e;"f"g;', ";") == ["a", 'b;"c"', 'd"e', "fg", ""]
    assert csvgrid.cells_of("", ";") == [""]
    assert csvgrid.cells_of('"open', ";") == ["open"]
    assert [csvgrid.open_after(x, ";", False) for x in ('a;"b', '"a";b', 'a"b', '""', '"""', '"";"')] == [True, False, False, False, True, True]
    assert [csvgrid.open_after(x, ";", True) for x in ("a", 'a"', 'a";"b', '""', 'a";b"')] == [True, False, True, True, False]
