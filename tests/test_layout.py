from pyspark.sql import functions as F

from tessera.operators import area, cluster, scan
from tessera.plans import layout
from tessera.sources import tables

WORDS = "page long, ord long, text string, cx double, cy double, x0 double, y0 double, x1 double, y1 double"


def words(spark, items, page=1):
    return spark.createDataFrame([(page, i, t, float(x), float(y), x - 10.0, y - 5.0, x + 10.0, y + 5.0) for i, (t, x, y) in enumerate(items)], WORDS)


def test_running_mean_differs_from_chain(spark):
    drift = words(spark, [("a", 10, 0), ("b", 10, 15), ("c", 10, 30), ("d", 10, 45)])
    assert [r.row for r in layout.rows_by_mean(drift, 20.0).orderBy("ord").collect()] == [0, 0, 1, 1]
    chain = cluster.chain_cluster(drift, ["page"], "cy", 20.0)
    assert {r.cluster for r in chain.collect()} == {0}


def test_segments_split_at_gaps(spark):
    found = layout.segments(words(spark, [("左", 10, 5), ("右", 25, 6), ("遠", 200, 5), ("下", 10, 90)])).orderBy("row", "part").collect()
    assert [r.text for r in found] == ["左右", "遠", "下"]


def test_greedy_propagation(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 10.0, "A1"), (1, 1, 0.0, 50.0, "A2"), (1, 2, 30.0, 11.0, ""), (1, 3, 30.0, 49.0, ""), (1, 4, 60.0, 48.0, ""), (1, 5, 500.0, 10.0, "")], "page long, ord long, y double, x double, code string")
    found = cluster.greedy_propagate(rows, "page").orderBy("ord").collect()
    assert [r.code for r in found] == ["A1", "A2", "A1", "A2", "A2", ""]


def test_header_paths_and_rooms(spark):
    assert scan.header_paths(["動力", "", "", "台数"], ["電圧", "消費", "", ""]) == ["動力_電圧", "動力_消費", "動力", "台数"]
    rooms = spark.createDataFrame([("居間", "", "2x3", None, "detailed"), ("寝室", "9", "", None, "detailed"), ("納戸", "-", "", "4", "simple"), ("", "-", "x", "", "simple")], "room_name string, area_m2 string, calculation string, tatami string, diagram_type string")
    assert [(r.room_name, r.warning) for r in area.room_warnings(rooms).collect()] == [("居間", "calculation"), ("寝室", None), ("納戸", "tatami")]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'a"b', "x,y"), (1, "c", "")], "ord long, `名称` string, v string")
    tables.write_csv(rows, f"{tmp_path}/out", ["ord"])
    found = tables.read_csv(spark, f"{tmp_path}/out")
    assert found.columns == ["ord", "名称", "v"]
    assert [(r["名称"], r.v) for r in found.orderBy("ord").collect()] == [("c", ""), ('a"b', "x,y")]
    ragged = spark.createDataFrame([(["a", 'b"c', "d,e"],), (["f"],)], "cells array<string>")
    tables.ragged_lines(ragged).coalesce(1).write.text(f"{tmp_path}/ragged")
    assert sorted(r.cells for r in tables.read_ragged(spark, f"{tmp_path}/ragged").collect()) == [["a", 'b"c', "d,e"], ["f"]]
    assert tables.manifest(spark, "1", "raster", "x.pdf", {"kind": "vector"}).first().kind == "vector"


def test_stream(spark, tmp_path):
    from tessera.streaming import ingest

    declared = spark.createDataFrame([(0, "A", "a", "1", "2", "")], "ord long, id string, name string, capacity_text string, qty string, drawing_no string")
    spark.createDataFrame([(0, "A", "a", "", "1", ""), (1, "A", "a", "", "1", "")], ingest.OBSERVED).coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest.reconcile_stream(declared, ingest.observed_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert [r.overall for r in found.filter(F.col("segment") == 0).collect()] == ["◯"]
