from pyspark.sql import DataFrameWriter

from ledgerlake.sources import tables
from ledgerlake.streaming.ingest import ingest


def test_text_tree_and_latest_csv(spark, tmp_path):
    for entity, stem, data in (("AAA", "BCTC_Hop_nhat", b"hello"), ("BBB", "r-me", b"a\xff\xfeb"), ("CCC", "x", b" ")):
        p = tmp_path / "raw" / entity / "2020" / stem
        p.mkdir(parents=True)
        (p / "x.txt").write_bytes(data)
    rows = {r.entity: r for r in tables.text_tree(spark, str(tmp_path / "raw")).collect()}
    assert (rows["AAA"].year, rows["AAA"].text, rows["AAA"].name_scope, rows["AAA"].stem) == (2020, "hello", "consolidated", "BCTC_Hop_nhat")
    assert rows["BBB"].text == "a��b" and rows["BBB"].name_scope == "parent" and rows["CCC"].name_scope == "unknown"
    assert rows["AAA"].sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert [r.entity for r in tables.text_tree(spark, str(tmp_path / "raw"), limit=2).collect()] == ["AAA", "BBB"]
    (tmp_path / "p1.csv").write_text("a\n1\n")
    (tmp_path / "p2.csv").write_text("a\n2\n")
    assert tables.latest_csv(spark, str(tmp_path), "p*.csv", "a int").first().a == 2
    assert tables.latest_csv(spark, str(tmp_path), "q*.csv", "a int").count() == 0


def test_json(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "a", "pages": [1, 2]}\n{"id": "b", "more": 1}\nbad\n')
    got = [(r.id, r.pages) for r in tables.json_lines(spark, str(tmp_path / "q.jsonl"), "id string, pages array<int>").collect()]
    assert got == [("a", [1, 2]), ("b", None), (None, None)]
    (tmp_path / "m.json").write_text('{\n "interval": {"coverage": 0.8},\n "features": ["x"]\n}')
    (m,) = tables.json_file(spark, str(tmp_path / "m.json"), "interval struct<coverage: double>, features array<string>").collect()
    assert m.interval.coverage == 0.8 and m.features == ["x"]


def test_tables_are_rebuilt_and_counted(spark, tmp_path):
    x = spark.createDataFrame([(1, 2020, float("nan"), "f"), (2, 2021, 1.0, "g")], "id int, year int, v double, file string")
    for _ in range(2):
        assert tables.rebuilt({"one": x, "none": x.limit(0)}, str(tmp_path)) == {"one": 2, "none": 0}
    assert {r.v for r in spark.read.parquet(str(tmp_path / "one")).collect()} == {None, 1.0}
    tables.built(x.where("id = 1"), x, x.select("file", "v"), x, x, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "facts")).count() == 1 and spark.read.parquet(str(tmp_path / "out" / "reports")).where("year = 2021").count() == 1


def test_artifacts(spark, tmp_path):
    x = spark.createDataFrame([("r1", "# A\n\n- b"), ("r2", "# C")], "report string, markdown string")
    tables.to_csv(x.select("report"), str(tmp_path / "csv"))
    tables.to_json(x, str(tmp_path / "json"))
    tables.to_markdown(x, str(tmp_path / "md"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2 and spark.read.json(str(tmp_path / "json")).where("report = 'r1'").first().markdown == "# A\n\n- b"
    assert [p.read_text() for p in (tmp_path / "md" / "report=r1").glob("part-*")] == ["# A\n\n- b\n"]


def test_a_table_is_stored_once(spark):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert [tables.stored(spark, "src", "t", build).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_ingest_replaces_partitions(spark, tmp_path):
    schema = "entity string, year int, text string"
    for k, text in enumerate(("old", "new")):
        spark.createDataFrame([("A", 2020, text)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [text]


def test_query_takes_parameters(spark):
    assert tables.query(spark, "SELECT :a + 1 AS x", a=2).first().x == 3


def test_stored_tables_are_written_by_methods_that_the_jvm_compiles(spark, monkeypatch):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before, seen = spark.conf.get(limit), []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(limit))), write(self, *a, **k))[1])
    assert tables.saved(spark.range(3)).count() == 3
    assert tables.stored(spark, "small methods", "t", lambda: spark.range(4)).count() == 4
    assert seen == [8000, 8000] and spark.conf.get(limit) == before
