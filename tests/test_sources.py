import json
import zipfile

import pytest
from pyspark.sql import functions as F
from tallyscope.functions import vocab
from tallyscope.sources import catalog, database, files, landing


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path, "people.csv", "id, name ,age,city,signup_date\n1,Ann,31,Oslo,2024-01-02\n2,Bo,22,Rome,2024-01-03\n\n3,Cy,45,Nice,2024-01-04\n")
    df = files.read_delimited(spark, path)
    assert df.columns == ["id", "name", "age", "city", "signup_date"] and df.count() == 3
    assert df.schema["age"].dataType.simpleString() == "int"


@pytest.mark.parametrize("name, content, columns", [
    ("t.tsv", "a\tb\tc\n1\t2\t3\n4\t5\t6\n", ["a", "b", "c"]), ("s.csv", "a;b;c\n1;2;3\n4;5;6\n", ["a", "b", "c"]),
    ("p.csv", "a|b\n1|2\n", ["a", "b"]), ("h.csv", "1,2,3\n4,5,6\n7,8,9\n", ["col_0", "col_1", "col_2"]), ("dup.csv", "x,x\n1,2\n", ["x", "x_1"]),
])
def test_delimiters_and_headers(spark, tmp_path, name, content, columns):
    df = files.read_delimited(spark, write(tmp_path, name, content))
    got = [c if c != "x0" else "x" for c in df.columns]
    assert got == columns or (name == "dup.csv" and len(set(got)) == 2)


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    path = write(tmp_path, "bad.csv", "n,m\n1,2\nx,3\n4,5\n")
    schema = "n int, m int, _corrupt_record string"
    from pyspark.sql.types import _parse_datatype_string

    df = files.read_delimited(spark, path, delimiter=",", has_header=True, schema=_parse_datatype_string(schema)).cache()
    assert files.bad_lines(df).count() == 1 and df.where("_corrupt_record IS NULL").count() == 2


@pytest.mark.parametrize("payload, shape, columns, rows", [
    ([{"id": 1, "name": "a"}, {"id": 2, "name": "b"}], "array_of_objects", ["id", "name"], 2),
    ([{"id": 1, "profile": {"city": "x", "age": 3}}], "array_of_objects", ["id", "profile.age", "profile.city"], 1),
    ({"results": [{"a": 1}, {"a": 2}, {"a": 3}], "count": 3}, "object_wrapping_array", ["a"], 3),
    ({"foo": 1, "bar": "x"}, "single_object", ["bar", "foo"], 1),
    ([1, 2, 3], "array_of_scalars", ["value"], 3), ([], "empty_array", ["value"], 0), (5, "scalar", ["value"], 1),
])
def test_json_shapes(spark, tmp_path, payload, shape, columns, rows):
    df, found = files.read_json_document(spark, write(tmp_path, "d.json", json.dumps(payload)))
    assert found == shape and sorted(df.columns) == columns and df.count() == rows


def test_invalid_json(spark, tmp_path):
    with pytest.raises(files.UnreadableFile):
        files.read_json_document(spark, write(tmp_path, "d.json", '{"a": [1,'))


def test_json_lines(spark, tmp_path):
    good, rejected = files.read_json_lines(spark, write(tmp_path, "g.jsonl", '{"event":"a","n":1}\n{"event":"b","n":2}\n\n{"event":"c","n":{"x":3}}\n'))
    assert good.count() == 3 and rejected.count() == 0
    good, rejected = files.read_json_lines(spark, write(tmp_path, "b.jsonl", '{"event":"a","n":1}\n{"event": broken\n{"event":"c","n":3}\n7\n'))
    assert [r.line for r in rejected.collect()] == ['{"event": broken']
    assert good.where("event IS NOT NULL").count() == 2 and good.where("value = '7'").count() == 1


def test_parquet_projection_reaches_the_scan(spark):
    df = files.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_quantity"]).where("l_quantity > 10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan and "GreaterThan(l_quantity,10.0)" in plan


def make_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)


@pytest.fixture()
def folder(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n")
    write(tmp_path, "b.txt", "x\ty\n1\t2\n")
    write(tmp_path, "c.json", '{"a": [1, 2]}')
    write(tmp_path, "d.dat", '{"a": 1}\n{"a": 2}\n')
    write(tmp_path, "e.jsonl", '{"a": 1}\n')
    write(tmp_path, "f.bin", b"SQLite format 3\x00" + b"\x00" * 40)
    write(tmp_path, "g.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\x00" * 40)
    write(tmp_path, "h.weird", "nothing here")
    write(tmp_path, "i.csv", "")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "pq"))
    make_zip(tmp_path / "one.zip", {"data/people.csv": "id,name\n1,Ann\n" * 50, "data/records.json": "[]", "readme.txt": "hi", "../evil.csv": "x", "run.exe": "x"})
    make_zip(tmp_path / "none.zip", {"readme.md": "x", "run.exe": "x"})
    make_zip(tmp_path / "book.xlsx", {"[Content_Types].xml": "x", "xl/workbook.xml": "x"})
    make_zip(tmp_path / "bomb.zip", {"big.csv": "0" * 3_000_000})
    write(tmp_path, "broken.zip", b"PK\x03\x04broken")
    return str(tmp_path)


def named(df, *columns):
    return {r.path.rsplit("/", 1)[-1]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_formats(spark, folder):
    found = named(landing.detect_formats(landing.list_files(spark, folder)), "format")
    expected = {"a.csv": "csv", "b.txt": "tsv", "c.json": "json", "d.dat": "jsonl", "e.jsonl": "jsonl", "f.bin": "sqlite", "g.xls": "xls", "h.weird": None,
                "one.zip": "zip", "book.xlsx": "xlsx"}
    assert {k: found[k] for k in expected} == expected
    assert [v for k, v in found.items() if k.startswith("part-") and k.endswith("parquet")] == ["parquet"]


def test_file_checks(spark, folder):
    listed = landing.list_files(spark, folder).select("path", "length").union(spark.createDataFrame([("file:/x/i.csv", 0)], "path string, length long"))
    found = named(landing.check_files(listed, max_bytes=10_000), "error", "warning")
    assert found["i.csv"][0] == "File is empty" and found["a.csv"] == (None, None) and found["h.weird"][1] == "Unrecognised extension .weird"


def test_archives(spark, folder, tmp_path_factory):
    zips = landing.list_files(spark, folder).where("path LIKE '%.zip'")
    members = landing.archive_members(zips)
    kinds = {r.member: r.verdict for r in members.where("path LIKE '%/one.zip'").collect()}
    assert kinds == {"data/people.csv": "supported", "data/records.json": "supported", "readme.txt": "supported", "../evil.csv": "unsafe_path", "run.exe": "executable"}
    unlimited = {r.path.rsplit("/", 1)[-1]: r.rejected for r in landing.archive_verdicts(members).collect()}
    assert unlimited["bomb.zip"] is None and unlimited["broken.zip"] == "not a valid ZIP archive"
    verdicts = landing.archive_verdicts(members, **vocab.ARCHIVE_LIMITS)
    assert {r.member for r in landing.choose_members(verdicts, members, every=True).collect()} >= {"data/people.csv", "data/records.json"}
    found = named(verdicts, "rejected", "chosen")
    assert found["one.zip"] == (None, "data/people.csv") and found["none.zip"][0] == "no supported datasets"
    assert found["broken.zip"][0] == "not a valid ZIP archive" and found["bomb.zip"][0] == "suspicious compression ratio"
    target = tmp_path_factory.mktemp("out")
    chosen = landing.choose_members(verdicts, members)
    out = landing.extract_members(chosen, target.as_uri()).collect()
    assert [r.member for r in out] == ["data/people.csv"]
    assert files.read_delimited(spark, out[0].extracted).count() == 99  # 50 repeats, repeated headers are rows
    assert landing.choose_members(verdicts, members, "data/records.json").first().member == "data/records.json"


def test_jdbc_options():
    o = database.jdbc_options("jdbc:x", query="SELECT 1; ", row_limit=5)
    assert o["query"] == "SELECT * FROM (SELECT 1) AS _sub LIMIT 5"
    assert database.jdbc_options("jdbc:x", table="t") == {"url": "jdbc:x", "dbtable": "t"}
    assert "LIMIT 3" in database.jdbc_options("jdbc:x", table="t", row_limit=3)["query"]
    assert "secret" not in database.masked("cannot reach db password=secret host")
    with pytest.raises(ValueError):
        database.jdbc_options("jdbc:x")


def test_catalog(spark, tmp_path):
    rows = [(i, i % 2, f"2024-01-{i + 1:02d}", "validated" if i % 3 else "failed") for i in range(8)]
    cat = spark.createDataFrame(rows, "dataset_id long, user_id long, created_at string, status string")
    assert [r.dataset_id for r in catalog.list_datasets(cat, 2, 1, user_id=1).collect()] == [5, 3]
    assert catalog.get_dataset(cat, 3, user_id=0).count() == 0 and catalog.get_dataset(cat, 3, user_id=1).count() == 1
    assert catalog.without(cat, spark.createDataFrame([(3,), (3,)], "dataset_id long")).count() == 7
    log = str(tmp_path / "log")
    for i, s in enumerate(["uploaded", "detecting", "processing", "validated"]):
        catalog.append_status(log, spark.createDataFrame([("d", s, i, i)], "dataset_id string, status string, at long, seq long"))
    assert catalog.current_status(spark.read.parquet(log)).first().status == "validated"
    with pytest.raises(Exception, match="unknown status"):
        catalog.append_status(log, spark.createDataFrame([("d", "odd", 9, 9)], "dataset_id string, status string, at long, seq long"))
    path = str(tmp_path / "profiles")
    catalog.save_profile(spark.range(2), path, "d1")
    catalog.save_profile(spark.range(3), path, "d1")
    catalog.save_profile(spark.range(5), path, "d2")
    assert catalog.load_profile(spark, path, "d1").count() == 3


def test_whole_messages_without_secrets():
    text = database.masked("jdbc:x://bob:hunter2@host/db failed, password=abc; mail a@b.org")
    assert "hunter2" not in text and "abc" not in text and "host/db failed" in text and "a@b.org" in text


def test_doubled_quotes_are_one(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,t\n1,"a ""b"" c"\n2,d\n')
    assert [r.t for r in files.read_delimited(spark, str(path)).orderBy("id").collect()] == ['a "b" c', "d"]


def test_line_breaks_in_quotes_and_surplus_fields(spark, tmp_path):
    path = write(tmp_path, "m.csv", 'id,t,u\n1,"a ""b"" c","line1\nline2"\n3,p,q,EXTRA\n4,r\n5,s,t\n')
    df = files.read_delimited(spark, path).cache()
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {1, 3, 4, 5} and (rows[1].t, rows[1].u) == ('a "b" c', "line1\nline2")
    assert {r.id: "EXTRA" in r._corrupt_record for r in files.bad_lines(df).collect()} == {3: True, 4: False}
    plain = write(tmp_path, "n.csv", "7,8,9\n1,2,3,4\n")
    got = files.read_delimited(spark, plain, delimiter=",", has_header=False, multi_line=False).cache()
    assert got.columns == ["col_0", "col_1", "col_2", "_corrupt_record"] or got.columns == ["col_0", "col_1", "col_2", "col_3", "_corrupt_record"]
    assert got.count() == 2 and files.bad_lines(got).count() == 1


def test_bad_lines_are_numbered_over_splits(spark, tmp_path):
    folder = tmp_path / "numbered"
    folder.mkdir()
    want = {}
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 700)):
        lines = ["" if i % 11 == 5 else '{"x": ' if i % 97 == 3 else json.dumps({"x": i, "t": "é" * (i % 40)}) for i in range(n)]
        want[name] = [i + 1 for i, line in enumerate(lines) if line == '{"x": ']
        (folder / name).write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        rows, rejected = files.read_json_lines(spark, str(folder))
        got = {}
        for r in rejected.collect():
            got.setdefault(r.file.rsplit("/", 1)[-1], []).append(r.line_number)
        assert {k: sorted(v) for k, v in got.items()} == want and spark.read.text(str(folder)).rdd.getNumPartitions() > 5
        report = {r.file.rsplit("/", 1)[-1]: (r.bad_line_count, r.first_bad_line) for r in files.bad_line_report(rejected).collect()}
        assert report == {k: (len(v), v[0]) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_scalars_lose_quotes_and_escapes(spark, tmp_path):
    lines = [json.dumps('s"t\n\\é'), "null", "1.5", "true", '[1, {"a": 2}]', '  "x"  ', "\t"]
    rows, rejected = files.read_json_lines(spark, write(tmp_path, "s.jsonl", "\n".join(lines)))
    assert sorted(r.value or "" for r in rows.collect()) == sorted(['s"t\n\\é', "", "1.5", "true", '[1,{"a":2}]', "x"]) and rejected.count() == 0
    with pytest.raises(files.UnreadableFile):
        files.read_json_lines(spark, write(tmp_path, "none.jsonl", "{\n[\n"))
    rows, _ = files.read_json_document(spark, write(tmp_path, "s.json", json.dumps('a"b\tc')))
    assert rows.first().value == 'a"b\tc'


def test_documents_of_several_shapes(spark, tmp_path):
    folder = tmp_path / "shapes"
    folder.mkdir()
    for name, payload in {"a": [{"k": 1}, {"k": 2, "o": {"p": "x"}}], "b": {"k": 3}, "c": [4, None], "d": {"n": 1, "all": [{"k": 5}]}, "e": [], "f": {"one": [{"k": 1}], "two": [{"k": 1}]}, "g": [{"k": 1}, 2]}.items():
        (folder / f"{name}.json").write_text(json.dumps(payload, indent=1))
    rows, shape = files.read_json_document(spark, str(folder))
    shapes = {r.file.rsplit("/", 1)[-1][0]: (r.shape, r.unwrap_key) for r in files.json_shapes(spark, str(folder)).collect()}
    assert shape == "mixed" and shapes == {"a": ("array_of_objects", None), "b": ("single_object", None), "c": ("array_of_scalars", None), "d": ("object_wrapping_array", "all"), "e": ("empty_array", None), "f": ("single_object", None), "g": ("array_of_scalars", None)}
    assert sorted(str(r.k) for r in rows.collect()) == sorted(["1", "2", "3", "5"] + ["None"] * 5) and "o.p" in rows.columns
    assert sorted(r.value for r in rows.where("value IS NOT NULL").collect()) == ["2", "4", '{"k":1}']


def test_files_of_a_folder_have_their_own_layouts(spark, tmp_path):
    folder = tmp_path / "layouts"
    folder.mkdir()
    (folder / "a.csv").write_text('id,name,n\n1,"x, y\nz",3\n2,w,4\n')
    (folder / "b.csv").write_text("id;name;n\n3;a,b;5\n4;c;6\n")
    (folder / "c.tsv").write_text("n\tid\n7\t5\n8\tsix\n")
    layouts = {r.file.rsplit("/", 1)[-1]: (r.delimiter, r.has_header, r.breaks) for r in files.file_layouts(spark, str(folder)).collect()}
    assert layouts == {"a.csv": (",", True, True), "b.csv": (";", True, False), "c.tsv": ("\t", True, False)}
    rows = files.read_delimited(spark, str(folder)).collect()
    assert sorted((r.id, r.name, r.n) for r in rows) == sorted([("1", "x, y\nz", 3), ("2", "w", 4), ("3", "a,b", 5), ("4", "c", 6), ("5", None, 7), ("six", None, 8)])


def test_zero_byte_files_are_listed(spark, tmp_path):
    folder = tmp_path / "landing zone"
    (folder / "deep").mkdir(parents=True)
    (folder / "deep" / "no thing.csv").write_text("")
    (folder / "a.csv").write_text("x,y\n1,2\n")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.error) for r in landing.check_files(landing.list_files(spark, str(folder))).collect()}
    assert got == {"no thing.csv": (0, "File is empty"), "a.csv": (8, None)}


def test_long_lines_do_not_hide_json_lines(spark, tmp_path):
    folder = tmp_path / "long"
    folder.mkdir()
    one = json.dumps({"t": 'a"}\\ {' * 2000, "l": [1, {"x": "]"}]})
    (folder / "lines.dat").write_text(one + "\n\n" + one)
    (folder / "single.dat").write_text(one + "\n")
    (folder / "list.dat").write_text("[" + one + ",\n" + one + "]")
    got = {r.path.rsplit("/", 1)[-1]: r.format for r in landing.detect_formats(landing.list_files(spark, str(folder))).collect()}
    assert got == {"lines.dat": "jsonl", "single.dat": "json", "list.dat": "json"}
    for block in (1, 3, 7):
        assert landing._more_values(open(folder / "lines.dat", "rb"), block) and not landing._more_values(open(folder / "list.dat", "rb"), block)


def test_metadata_keeps_the_latest_change(spark, tmp_path):
    from tallyscope.sources import catalog

    path, schema = str(tmp_path / "log"), "dataset_id string, name string, value string, at timestamp_ntz, seq long"
    rows = [("a", "owner", "x", 1), ("a", "owner", "y", 3), ("a", "rows", "5", 2), ("b", "owner", "z", 1), ("b", "owner", None, 2)]
    for part in (rows[1:2], rows[:1] + rows[2:]):
        catalog.update_metadata(path, spark.createDataFrame([(d, n, v, None, q) for d, n, v, q in part], schema))
    for table in (spark.read.parquet(path), catalog.compact_metadata(spark, path, str(tmp_path / "new"))):
        got = {r.dataset_id: r.metadata for r in catalog.metadata_map(catalog.current_metadata(table)).collect()}
        assert got == {"a": {"owner": "y", "rows": "5"}}
    size = files.bytes_of(spark.read.parquet(path)).first()
    assert size.files >= 2 and size.bytes > 0


def test_parquet_footers(spark, tmp_path):
    folder = str(tmp_path / "p")
    rows = spark.range(0, 950, 1, 1).selectExpr("id", "IF(id % 5 = 0, NULL, concat('t', id)) AS name", "named_struct('x', id) AS s")
    rows.write.option("parquet.block.row.count.limit", 200).parquet(folder)
    rows.limit(0).write.mode("append").parquet(folder)
    (tmp_path / "p" / "broken.parquet").write_bytes(b"no parquet at all")
    (tmp_path / "p" / "empty.parquet").write_bytes(b"")
    footers = files.parquet_footers(spark, folder)
    found = sorted((r.rows, r.row_groups, r.leaves) for r in files.parquet_files(footers).collect())
    assert found == [(0, 0, 0), (950, 5, 3)]
    leaves = {r.leaf: (r.leaf_types, r.rows, r.nulls) for r in files.parquet_leaves(footers).collect()}
    assert leaves == {"id": (["INT64"], 950, 0), "name": (["BYTE_ARRAY"], 950, 190), "s.x": (["INT64"], 950, 0)}
    assert sorted(r.file.rsplit("/", 1)[1] for r in footers.where("error IS NOT NULL").collect()) == ["broken.parquet", "empty.parquet"]


def test_a_large_language_is_dealt_out_over_slices(spark):
    from workload import readers

    docs = spark.createDataFrame([("en", i, f"text {i}") for i in range(200)] + [("de", 1, "a"), ("de", 2, None)], "lang string, doc_id long, text string")
    dealt = readers._in_slices(docs, 20)
    assert dealt.columns == docs.columns and sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    parts = dealt.withColumn("p", F.spark_partition_id()).groupBy("lang").agg(F.count_distinct("p").alias("n")).collect()
    counts = {r.lang: r.n for r in parts}
    assert counts["de"] == 1
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "slice" in plan


def test_files_by_bucket_are_written_by_several_tasks(spark, tmp_path):
    from workload import readers

    rows = spark.range(40).selectExpr("id AS bucket", "id AS doc_id", "CAST(id AS STRING) AS line")
    path = readers._texts_by_group(spark, rows, "small")
    names = [r.file.rsplit("/", 1)[1] for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).collect()]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 1
