"""Records over several lines, whatever the splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from answergrid.sources import read_export, read_grid, write_grid
from answergrid.sources.records import Quotes, Records, lines_of


@pytest.fixture
def split_bytes(spark):
    """Splits of so many bytes."""

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"'


def a_cell(rng):
    text = "".join(rng.choice(['a', 'é', '"', ",", "\n", " ", "bc", '""', "\r\n"]) for _ in range(rng.randint(0, 6)))
    needs = any(c in text for c in ',"\n\r')
    return text, quoted(text) if needs or rng.random() < 0.3 else text


def grid_text(rng, rows, end="\n"):
    cells = [[a_cell(rng) for _ in range(3)] for _ in range(rows)]
    # A first cell that is never empty: blank lines are another matter.
    cells = [[(f"r{i}", f"r{i}"), *row] for i, row in enumerate(cells)]
    return [[c[0] for c in row] for row in cells], end.join(",".join(c[1] for c in row) for row in cells) + end


@pytest.mark.parametrize("size", [17, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_those_of_the_whole_file(spark, tmp_path, split_bytes, size, end):
    rng = random.Random(size)
    wanted = {}
    for name in ("a.csv", "b.csv", "c.csv"):
        rows, text = grid_text(rng, 60, end)
        (tmp_path / name).write_bytes(text.encode())
        assert list(csv.reader(io.StringIO(text, newline=""))) == rows
        wanted |= {(name, i): row for i, row in enumerate(rows)}
    split_bytes(size)
    got = read_grid(spark, str(tmp_path), width=4).collect()
    plain = lambda c: (c or "").replace("\r\n", "\n")
    assert {(r["row_no"]["file"].rsplit("/", 1)[-1], r["row_no"]["number"]): [plain(c) for c in r["cells"]] for r in got} == {
        k: [plain(c) for c in row] for k, row in wanted.items()
    }
    assert len(got) == len(wanted)


def test_numbers_do_not_depend_on_splits(spark, tmp_path, split_bytes):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(grid_text(random.Random(name), 300)[1], encoding="utf-8", newline="")
    seen = set()
    for size in (40, 700, 1 << 20):
        split_bytes(size)
        grid = read_grid(spark, str(tmp_path), width=4)
        split_bytes(1 << 20)  # what was split before stays so
        seen.add(tuple(sorted((r["row_no"], tuple(r["cells"])) for r in grid.collect())))
    assert len(seen) == 1
    assert len(seen.pop()) == 600


def test_all_splits_of_one_file_are_read_apart(spark, tmp_path, split_bytes):
    (tmp_path / "one.csv").write_text("".join(f'{i},"x\ny"\n' for i in range(2000)), encoding="utf-8")
    split_bytes(1000)
    records = Records(lines_of(spark, str(tmp_path)))
    assert records.pieces.count() > 15
    assert records.rows.count() == 2000
    tasks = records.rows.groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 15


def test_a_record_over_many_splits(spark, tmp_path, split_bytes):
    cell = "\n".join(f"line {i}" for i in range(500))
    (tmp_path / "g.csv").write_text(f'1,"{cell}",z\n2,b,"c"\n', encoding="utf-8")
    split_bytes(64)
    rows = read_grid(spark, str(tmp_path), width=3).orderBy("row_no").collect()
    assert [r["cells"] for r in rows] == [["1", cell, "z"], ["2", "b", "c"]]


def test_a_quote_inside_a_cell_opens_nothing(spark, tmp_path):
    (tmp_path / "g.csv").write_text('5" pipe,6" pipe\n7",8\n"a"b,c\n', encoding="utf-8")
    rows = read_grid(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r["cells"][:2] for r in rows][:2] == [['5" pipe', '6" pipe'], ['7"', "8"]]
    assert len(rows) == 3


def test_ends_of_lines():
    quotes = Quotes(",")
    open_ = {"": False, "a,b": False, '"a': True, '"a"': False, '"a""': True, '"a"""': False, 'a"b': False, 'a,"': True, '"",""': False, '"a"b,"c': True, ',"': True}
    assert {line: quotes.after(line.encode(), False) for line in open_} == open_
    still = {"": True, "a": True, 'a"': False, 'a""': True, 'a"""': False, '"': False, '","': True, '",""': False, 'x"y,z': False, '""': True}
    assert {line: quotes.after(line.encode(), True) for line in still} == still
    assert [quotes.cells(r) for r in (b"", b"a", b"a,", b'"a,b",c', b'"x', b'a,"b,c', b'5" a,6" b')] == [1, 1, 2, 2, 1, 2, 2]
    assert Quotes("||").cells(b'a|b||"c||d"||') == 3


def test_written_texts_come_back(spark, tmp_path, split_bytes):
    rng = random.Random(7)
    rows = [(i, a_cell(rng)[0].replace("\r\n", "\n"), None if i % 5 else "") for i in range(400)]
    df = spark.createDataFrame(rows, "n LONG, t STRING, e STRING")
    write_grid(df, str(tmp_path / "out"))
    split_bytes(200)
    back = read_export(spark, str(tmp_path / "out"), df.columns).collect()
    assert sorted(map(tuple, back)) == sorted((str(n), t, "") for n, t, _ in rows)


def test_no_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    assert read_grid(spark, str(tmp_path)).count() == 0
    assert read_grid(spark, str(tmp_path), width=2).count() == 0
