"""Sources, sinks and streams."""

from __future__ import annotations

from ledgerline.sources import delimited, sinks
from ledgerline.streaming.alerts import critical_events, ingest


def test_detection():
    assert delimited.detect_separator(['a;b;"c;d"', "1;2;3", "x"]) == ";"
    assert delimited.detect_separator(["a,b", "1,2"]) == "," and delimited.detect_separator([]) == ","
    assert delimited.header_row([["Report", None, None], ["Date", "Libellé", "Montant"], ["2024-01-01", "x", "3"]]) == 1
    assert delimited.unique_names(["a", "", "a", None]) == ["a", "col_2", "a_2", "col_4"]
    assert delimited.is_data_dictionary(["Champ", "Description"]) and not delimited.is_data_dictionary(["Date", "Amount"])


def test_read_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿Journal;;\nDate;Libellé;Montant\n01/02/2024;a;1 000,50\n;;\n02/02/2024;b;2\n", encoding="utf-8")
    df = delimited.read_delimited(spark, f"file://{tmp_path}/x.csv")
    assert df.columns == ["Date", "Libellé", "Montant"]
    assert sorted(tuple(r) for r in df.collect()) == [("01/02/2024", "a", "1 000,50"), ("02/02/2024", "b", "2")]


def test_read_delimited_wide_rows_and_broken_lines(spark, tmp_path):
    lines = ["Rapport des ventes", "Date;Libellé;Montant"] + [f"{i:02}/02/2024;a;{i}" for i in range(1, 25)] + ['Date;Libellé;Montant', '25/02/2024;"deux\nlignes; ""x""";7;extra;more']
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = delimited.read_delimited(spark, f"file://{tmp_path}/w.csv")
    assert df.columns == ["Date", "Libellé", "Montant", "col_4", "col_5"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == 26 and ("Date", "Libellé", "Montant", None, None) in rows  # a later row that looks like the header stays
    assert ("25/02/2024", 'deux\nlignes; "x"', "7", "extra", "more") in rows


def test_observations_unknown_sheets_and_purge(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, "5", None, None), (2, " ", "x", "MISSING_DATE"), (3, "y", "2.5", None)], "n int, a string, b string, reason string")
    for i in ("one", "two"):
        sinks.write_import(rows, path, i)
        sinks.write_observations(rows, path, i, "n", ["a", "b"])
    got = sorted((r.entity_id, r.concept, r.value, r.text) for r in sinks.read_import(spark, path, "observations").filter("import_id = 'one'").collect())
    assert got == [(1, "a", 5.0, "5"), (3, "a", None, "y"), (3, "b", 2.5, "2.5")]  # row 2 was not taken in
    sinks.write_unknown(spark.createDataFrame([("p", "q")] * 3, "x string, y string"), path, "raw")
    assert {r.reason for r in sinks.read_import(spark, path, "quarantine").filter("import_id = 'raw'").collect()} == {"UNKNOWN_CONCEPT"}
    sinks.delete_import(spark, path, "one")
    assert {r.import_id for n in ("rows", "observations") for r in sinks.read_import(spark, path, n).collect()} == {"two"}
    sinks.purge(spark, [path], keep=("rows",))
    assert (tmp_path / "store/rows").exists() and not (tmp_path / "store/quarantine").exists()


def test_import_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "MISSING_DATE"), (3, None)], "n int, reason string")
    path = f"file://{tmp_path}/t"
    for i in ("a", "b", "a"):
        sinks.write_import(df, path, i)
    assert sinks.read_import(spark, path).count() == 4 and sinks.read_import(spark, path, "quarantine").count() == 2
    sinks.delete_import(spark, path, "a")
    assert {r.import_id for r in sinks.read_import(spark, path).collect()} == {"b"}
    sinks.export_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 3
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "csv").glob("part-*"))


def test_streams(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS ts, id % 14 AS user_id, 'error' AS event_type, 50.0 + id AS value FROM range(100)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = critical_events(stream).writeStream.format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("alerts").count() == 7
    for i in range(2):
        ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ck{i}", ["event_id"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100


def test_ingestion_by_partition(spark, tmp_path):
    spark.sql("SELECT id AS event_id, CAST(id % 3 AS INT) AS day, id * 1.0 AS value FROM range(30)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for i in range(2):
        ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ck{i}", ["event_id"], "day").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 30 and got.select("day").distinct().count() == 3
