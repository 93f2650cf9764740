import json

from pyspark.sql import functions as F

from leafmill.session import scratch
from leafmill.sources import csvfiles, files, records


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


def test_encodings_are_found_and_decoded(spark, tmp_path):
    header, rows = "名,n", ["中文,1", "数据,2"]
    latin = ["nom,n", "\xc9t\xe9\xff,1"]
    text = "\n".join([header, *rows]) + "\n"
    write(tmp_path / "a", "u.csv", text.encode("utf-8"))
    write(tmp_path / "a", "g.csv", text.encode("gbk"))
    write(tmp_path / "b", "l.csv", "\n".join(latin).encode("latin1"))
    for folder, name, want in (("a", "u.csv", "utf-8"), ("a", "g.csv", "gbk"), ("b", "l.csv", "latin1")):
        lines = csvfiles.read_lines(spark, str(tmp_path / folder / name))
        found = csvfiles.detect_encodings(lines).first().encoding
        assert found == want
        assert {r.line for r in csvfiles.decode_lines(lines, csvfiles.detect_encodings(lines)).collect()} == set(
            (tmp_path / folder / name).read_bytes().decode(want).split("\n")
        ) - {""}
    both = csvfiles.read_csv_any_encoding(spark, str(tmp_path / "a"))
    assert both.columns == ["名", "n"]
    assert sorted(tuple(r) for r in both.collect()) == sorted([("中文", "1"), ("数据", "2")] * 2)


def test_csv_quotes_nulls_and_line_breaks(spark, tmp_path):
    write(tmp_path / "c", "q.csv", b'a,b\n"x, ""y""",NULL\n"two\nlines",nan\n')
    got = csvfiles.read_csv(spark, str(tmp_path / "c"), multi_line=True).collect()
    assert [tuple(r) for r in got] == [('x, "y"', None), ("two\nlines", None)]


def test_files(spark, tmp_path):
    write(tmp_path / "d", "One.CSV", b"12345")
    write(tmp_path / "d", "two.csv", b"1")
    write(tmp_path / "d", "three.txt", b"")
    folder = str(tmp_path / "d")
    assert {r.name for r in files.file_facts(files.scan_directory(spark, folder)).collect()} == {"two.csv"}
    facts = {r.name: r for r in files.file_facts(files.list_files(spark, folder), with_hash=True).collect()}
    assert (facts["One.CSV"].extension, facts["One.CSV"].size) == (".csv", 5)
    assert facts["two.csv"].hash == "c4ca4238a0b923820dcc509a6f75849b"
    plan = files.file_facts(files.list_files(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan  # facts alone never read the bytes


def test_gate_and_ledger(spark):
    inputs = spark.createDataFrame([(1, ".pdf", 10), (2, ".doc", 10), (3, ".csv", 3 * 2**20), (4, ".xls", 1)], "f int, ext string, size long")
    checked = files.check_files(inputs, F.col("ext"), F.col("size"), max_mb=2)
    chunks = spark.createDataFrame([(1,), (1,), (3,)], "f int")
    got = {r.f: (r.chunks_count, r.success, r.error_message) for r in files.ingest_ledger(checked, chunks, "f").collect()}
    assert got == {
        1: (2, True, None), 2: (0, False, "unsupported format"), 3: (0, False, "file too large"), 4: (0, False, "empty result")}


def test_retention_and_usage(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-31")], "i int, d string").withColumn("d", F.col("d").cast("timestamp"))
    now = F.lit("2024-02-01").cast("timestamp")
    assert [r.i for r in files.retain(rows, "d", now, 10).collect()] == [2]
    assert files.count_expired(rows, "d", now, 10) == 1
    sizes = spark.createDataFrame([("a", 2**20), ("a", 2**19)], "folder string, size long")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r.name: r.size_mb for r in files.storage_usage(sizes, "folder", "size", names).collect()} == {"a": 1.5, "b": 0.0}


def test_records(spark):
    sheet = [["id", "名", "class"], ["1", "甲", "A(2)"], ["2", "乙"], ["3", "x", "y", "tail"]]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(sheet[1:])], "i int, cells array<string>")
    got = [json.loads(r.record) for r in records.rows_to_records(rows, sheet[0]).orderBy("i").collect()]
    assert got == [dict(zip(sheet[0], r, strict=False)) for r in sheet[1:]]
    assert records.rows_to_records(rows.where("false"), sheet[0]).count() == 0


def test_export_import(spark):
    store = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0])], "id string, text string, embedding array<float>")
    path = scratch(spark, "t-export")
    envelope = records.export_json(store, path, "c", F.lit("2024-01-01").cast("timestamp")).first()
    assert (envelope.total_documents, envelope.collection_name) == (2, "c")
    back = records.read_export(spark, path, store.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, store.collect()))
    assert [r.id for r in records.import_rows(back, store.where("id = 'a'")).collect()] == ["b"]
    assert records.import_rows(back, store, skip_duplicates=False).count() == 2


def test_processed_and_metadata(spark):
    docs = spark.createDataFrame([("a.pdf", "one\ntwo"), ("b.tar.gz", "x")], "name string, text string")
    folder = records.write_processed(docs, scratch(spark, "t-processed"), "name", "text", "json")
    found = files.list_files(spark, f"{folder}/file=*_processed.*", "part-*").select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("f"))
    assert {r.f for r in found.collect()} == {"a_processed.json", "b.tar_processed.json"}
    path = scratch(spark, "t-metadata")
    for day, v in (("2024-01-01", 1), ("2024-01-02", 2)):
        records.save_metadata(spark.createDataFrame([("k", v)], "file_id string, v int"), path, F.lit(day).cast("timestamp"))
    table = spark.read.parquet(path)
    assert records.load_metadata(table, "file_id", "k", "saved_time").first().v == 2
    assert records.load_metadata(table, "file_id", "none", "saved_time").count() == 0
