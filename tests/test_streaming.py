"""Streams of files, and going on after a restart."""

from datetime import datetime

from answergrid import fields_as_columns, pack_rows, project_fields
from answergrid.sources import read_history_files
from answergrid.streaming import append_stream, known_header, stream_files, stream_grid


def test_fields_of_a_stream_after_a_restart(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def add(first):
        rows = [(i, '{"list":[{"title":"Age","value":%d}]}' % i) for i in range(first, first + 10)]
        spark.createDataFrame(rows, "id INT, j STRING").write.mode("append").parquet(source)

    def run():
        stream = stream_files(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        wide = fields_as_columns(stream, "j", ["age"]).select("id", "age")
        append_stream(wide, sink, f"ages-{tmp_path.name}").awaitTermination()

    add(0)
    run()
    add(10)
    run()
    run()
    rows = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert rows == [(i, str(i)) for i in range(20)]


def test_grid_stream_into_a_history(spark, tmp_path):
    source = tmp_path / "grids"
    source.mkdir()
    (source / "a.csv").write_text('a, x ,"n, 1"\n\nb\n,no id\n', encoding="utf-8")
    header = known_header({"id": 0, "status": 1}, ["gone"])
    rows = pack_rows(stream_grid(spark, str(source), 3), header, "id", ["status", "gone"], loaded_at=datetime(2024, 1, 1))
    sink = str(tmp_path / "history")
    append_stream(rows, sink, f"grids-{tmp_path.name}").awaitTermination()
    got = project_fields(read_history_files(spark, sink), ["status", "gone"]).drop("loaded_at_utc")
    assert sorted(map(tuple, got.collect())) == [("a", "x", ""), ("b", "", "")]
