"""Grids, headers, packing, histories."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from answergrid import (
    HeaderNotFound,
    find_header,
    import_grid,
    latest_fields,
    latest_per_entity,
    pack_rows,
    strip,
)
from answergrid.sources import (
    HISTORY_SCHEMA,
    HistoryMismatch,
    Run,
    append_history,
    ensure_history,
    import_files,
    jdbc_options,
    parse_range,
    read_export,
    read_grid,
    shared_dir,
    spread,
    write_grid,
)

AT = datetime(2024, 1, 15, 10, 30)


def grid(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "row_no LONG, cells ARRAY<STRING>")


def packed(df):
    rows = sorted((r["entity_id"], r["data"]) for r in df.collect())
    return [(entity, json.loads(data)) for entity, data in rows]


def test_header_below_title_rows(spark):
    g = grid(spark, ["Report"], [], ["x", " Candidate_Email ", "Status", "status"], ["1", "a@b", "s", "t"])
    header = find_header(g, "candidate_email", ["STATUS", "gone"])
    assert header.row_no == 2
    assert header.columns == {"candidate_email": 1, "STATUS": 2}
    assert header.missing == ["gone"]


def test_no_header(spark):
    with pytest.raises(HeaderNotFound):
        find_header(grid(spark, ["a"], ["b"]), "id", [])
    with pytest.raises(HeaderNotFound):
        find_header(grid(spark), "id", [])


def test_packing(spark):
    g = grid(
        spark,
        ["junk"],
        ["id", "Status", "Notes"],
        ["a", " x  ", "n"],
        ["b"],
        [],
        ["", "no id"],
        [" \t", " "],
        [None, "null id", None],
        ["a", "y", ""],
        ["id", "Status", "Notes"],
    )
    rows, header = import_grid(g, "ID", ["status", "gone", "Notes"], loaded_at=AT)
    assert header.missing == ["gone"]
    assert packed(rows) == [
        ("a", {"status": "x", "gone": "", "Notes": "n"}),
        ("a", {"status": "y", "gone": "", "Notes": ""}),
        ("b", {"status": "", "gone": "", "Notes": ""}),
        ("id", {"status": "Status", "gone": "", "Notes": "Notes"}),
    ]
    assert list(json.loads(rows.first()["data"])) == ["status", "gone", "Notes"]
    assert {r["loaded_at_utc"] for r in rows.collect()} == {AT}
    assert [f.dataType for f in rows.schema] == [f.dataType for f in HISTORY_SCHEMA]
    now, _ = import_grid(g, "id", ["status"])
    assert len({r["loaded_at_utc"] for r in now.collect()}) == 1


def test_repeated_headers(spark):
    g = grid(spark, ["id", "Status"], ["a", "x"], [" ID ", "status"], ["id", "y"])
    rows, _ = import_grid(g, "id", ["status"], repeated_headers=True)
    assert packed(rows) == [("a", {"status": "x"}), ("id", {"status": "y"})]


def test_load_time_without_a_zone_is_utc(spark):
    g = grid(spark, ["id"], ["a"])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows, _ = import_grid(g, "id", ["id"], loaded_at=AT)
        assert rows.selectExpr("unix_seconds(loaded_at_utc)").first()[0] == 1705314600
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_kind_of_white_space_is_stripped(spark):
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    texts = [f"{s}a{s}b{s}{s}" for s in spaces] + ["\u200bx\u200b", "\ufeffy", "", "   "]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(strip(F.col("t")))
    assert [r[0] for r in df.collect()] == [t.strip() for t in texts]


def test_renaming(spark):
    g = grid(spark, ["id", "position"], ["a", "p"])
    rows, _ = import_grid(g, "id", ["position", "id"], rename={"position": "job"})
    assert rows.first()["data"] == '{"job":"p","id":"a"}'


@pytest.mark.parametrize(
    "text, expected",
    [
        ("A1:Z1000", (0, 26, 0, 1000)),
        ("Some Name!B2:AA3", (1, 27, 1, 3)),
        ("A:C", (0, 3, 0, None)),
        ("ZZZ9", (18277, 18278, 8, 9)),
        ("$B$2:$C$2", (1, 3, 1, 2)),
    ],
)
def test_ranges(text, expected):
    r = parse_range(text)
    assert (r.first_column, r.end_column, r.first_row, r.end_row) == expected


def test_bad_range():
    with pytest.raises(ValueError):
        parse_range("1A:2B")


def test_grid_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"quoted ""text"", here"\n\n1, padded \n2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("3,x,y,z\n4,\n", encoding="utf-8")
    path = str(tmp_path)
    rows = [r["cells"] for r in read_grid(spark, path).orderBy("row_no").collect()]
    assert rows == [
        ["id", 'quoted "text", here', None, None], [None] * 4, ["1", " padded ", None, None],
        ["2", None, None, None], ["3", "x", "y", "z"], ["4", None, None, None],
    ]
    part = read_grid(spark, path, cell_range="B3:C5").orderBy("row_no").collect()
    assert [r["cells"] for r in part] == [[" padded ", None], [None, None], ["x", "y"]]
    assert read_grid(spark, path, cell_range="A7:A9").count() == 0
    assert read_grid(spark, path, cell_range="A1:B1000").count() == 6
    for area in (None, "A:B", "A1:B100"):
        imported, header = import_files(spark, path, "ID", ["id", "gone"], cell_range=area)
        assert [e for e, _ in packed(imported)] == ["1", "2", "3", "4"]
        assert header.missing == ["gone"]


@pytest.mark.parametrize("header_file", ["a.csv", "c.csv"])
def test_header_in_a_small_file_among_large_ones(spark, tmp_path, header_file):
    (tmp_path / header_file).write_text("title\nid,v\n0,x\n", encoding="utf-8")
    for name in {"a.csv", "b.csv", "c.csv", "d.csv"} - {header_file}:
        lines = (f"{name}{i},v{i}\n" for i in range(300))
        (tmp_path / name).write_text("".join(lines), encoding="utf-8")
    rows, _ = import_files(spark, str(tmp_path), "ID", ["v"])
    got = [e for e, _ in packed(rows)]
    below = ["b.csv", "c.csv", "d.csv"] if header_file == "a.csv" else ["d.csv"]
    assert got == sorted(["0", *[f"{name}{i}" for name in below for i in range(300)]])
    with pytest.raises(HeaderNotFound):
        import_files(spark, str(tmp_path), "absent", ["v"])


def test_range_rows_over_many_blocks(spark, tmp_path):
    spark.range(0, 5000, 1, 7).selectExpr("concat(id, ',', id * 2)").write.text(str(tmp_path / "g"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_grid(spark, str(tmp_path / "g"), cell_range="A1001:A3007").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(int(r["cells"][0]) for r in got) == list(range(1000, 3007))


@pytest.mark.parametrize("before, after", [("1", "64"), ("64", "1")])
def test_row_order_holds_when_files_are_split_anew(spark, tmp_path, before, after):
    rows = spark.range(0, 2000, 1, 1).selectExpr("concat('r', id, ',', id) AS value")
    path = str(tmp_path / "g")
    head = spark.createDataFrame([("title",), ("id,v",)], "value STRING").coalesce(1)
    head.union(rows).coalesce(1).write.text(path)
    expected = sorted(f"r{i}" for i in range(2000))
    options = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": before}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        g = read_grid(spark, path)
        header = find_header(g, "id", ["v"])
        imported, _ = import_files(spark, path, "id", ["v"])
        part = read_grid(spark, path, cell_range="A3:B1502")
        spark.conf.set("spark.sql.files.minPartitionNum", after)
        assert [e for e, _ in packed(pack_rows(g, header, "id", ["v"]))] == expected
        assert [e for e, _ in packed(imported)] == expected
        assert sorted(int(r["cells"][1]) for r in part.collect()) == list(range(1500))
    finally:
        for key in options:
            spark.conf.unset(key)


def test_a_range_reads_only_the_files_it_needs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,a\n2,b\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("3,c\n4,d\n", encoding="utf-8")
    (tmp_path / "z.csv").write_text('5,"open\n', encoding="utf-8")
    part = read_grid(spark, str(tmp_path), cell_range="A2:B3").orderBy("row_no").collect()
    assert [r["cells"] for r in part] == [["2", "b"], ["3", "c"]]
    # A quote that never closes holds the rest of its file.
    assert read_grid(spark, str(tmp_path)).count() == 5


def test_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,t\n1,"two\nlines"\n', encoding="utf-8")
    g = read_grid(spark, str(tmp_path), width=2)
    assert [r["cells"] for r in g.orderBy("row_no").collect()] == [["id", "t"], ["1", "two\nlines"]]
    (tmp_path / "n.csv").write_text('2," more\n\nlines ",extra\n', encoding="utf-8")
    rows, _ = import_files(spark, str(tmp_path), "id", ["t"], width=3)
    assert packed(rows) == [("1", {"t": "two\nlines"}), ("2", {"t": "more\n\nlines"})]
    rows = read_grid(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r["cells"] for r in rows][2] == ["2", " more\n\nlines ", "extra"]


def test_history_table(spark, tmp_path):
    name = ensure_history(spark, "imports", "updates")
    assert ensure_history(spark, "imports", "updates") == name
    rows, _ = import_grid(grid(spark, ["id", "s"], ["a", "1"], ["b", "2"]), "id", ["s"], loaded_at=AT)
    append_history(rows, name)
    later, _ = import_grid(grid(spark, ["id", "s"], ["a", "3"]), "id", ["s"], loaded_at=datetime(2024, 2, 1))
    append_history(later, name)
    assert spark.table(name).count() == 3
    latest = latest_fields(spark.table(name), ["s", "gone"]).drop("loaded_at_utc")
    assert sorted(map(tuple, latest.collect())) == [("a", "3", None), ("b", "2", None)]
    spark.sql("CREATE TABLE imports.other (x INT) USING parquet")
    with pytest.raises(HistoryMismatch):
        ensure_history(spark, "imports", "other")
    ensure_history(spark, "imports", "other", replace=True)
    assert spark.table("imports.other").columns == HISTORY_SCHEMA.names
    for bad in ("drop table", "1x", "", "a;b"):
        with pytest.raises(ValueError):
            ensure_history(spark, "imports", bad)


def test_latest_breaks_ties_and_puts_nulls_last(spark):
    rows = [("a", "x", AT), ("a", "y", AT), ("b", "z", None), ("b", "w", AT), ("c", "n", None)]
    df = spark.createDataFrame(rows, "entity_id STRING, data STRING, loaded_at_utc TIMESTAMP")
    for method in ("window", "aggregate"):
        got = latest_per_entity(df, method=method)
        assert got.columns == df.columns
        assert {(r[0], r[1]) for r in got.collect()} == {("a", "y"), ("b", "w"), ("c", "n")}
    with pytest.raises(ValueError):
        latest_per_entity(df, method="other")


def test_written_grid_reads_back(spark, tmp_path):
    rows = [(1, ' a "quoted", text ', True), (2, "", False), (3, None, None), (4, "two\nlines", True)]
    df = spark.createDataFrame(rows, "n INT, t STRING, b BOOLEAN")
    path = str(tmp_path / "out")
    write_grid(df, path)
    write_grid(df, path)
    back = {tuple(r) for r in read_export(spark, path, df.columns).collect()}
    assert back == {
        ("1", ' a "quoted", text ', "True"), ("2", "", "False"), ("3", "", ""), ("4", "two\nlines", "True"),
    }
    write_grid(spark.range(25).repartition(1), path, include_headers=False, batch_rows=10)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 3
    write_grid(spark.range(25), path, include_headers=False, row_limit=7)
    assert read_grid(spark, path).count() == 7


def test_metrics_of_a_run(spark, tmp_path):
    g = grid(spark, ["id", "s"], ["a", ""], ["b", "x"])
    rows, header = import_grid(g, "id", ["s", "gone"])
    run = Run()
    run.watch(rows, ["entity_id"]).write.parquet(str(tmp_path / "w"))
    report = run.report(header)
    assert (report["rows"], report["empty_entity_id"], report["missing_fields"]) == (2, 0, ["gone"])
    assert report["duration_ms"] >= 0


def test_documents_that_are_not_json_are_counted(spark, tmp_path):
    df = spark.createDataFrame([('{"a":1}',), ("{bad",), ("",), (None,), ("null",)], "j STRING")
    run = Run("json")
    run.watch(df, json_in=["j"]).write.parquet(str(tmp_path / "w"))
    report = run.report()
    assert (report["rows"], report["not_json_j"]) == (5, 2)


def test_jdbc_options():
    assert "numPartitions" not in jdbc_options("jdbc:x", "t")
    options = jdbc_options("jdbc:x", "t", partition_column="id", lower=0, upper=9, partitions=3)
    assert (options["partitionColumn"], options["numPartitions"], options["queryTimeout"]) == ("id", "3", "60")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id")


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_warehouse_on_one_machine_is_no_shared_folder(spark):
    class Cluster:
        """The session as it would be on a cluster, without a folder named."""

        def __init__(self, master):
            self.sparkContext = self
            self._jvm, self._jsc, self.master = spark._jvm, spark.sparkContext._jsc, master
            self.conf, self.made = self, {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}

        def get(self, key, default=None):
            return self.made.get(key, default)

        def set(self, key, value):
            self.made[key] = value

    assert shared_dir(Cluster("local[8]")) == "file:/tmp/warehouse/_shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Cluster(master))


def test_spread_only_adds_a_shuffle_for_few_splits(spark):
    assert spread(spark.range(0, 10, 1, 1), 4).rdd.getNumPartitions() == 4
    many = spark.range(0, 10, 1, 6)
    assert spread(many, 4) is many
