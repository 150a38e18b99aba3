import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ingest, tables
from tidemark.streaming import ingest as stream


def test_rejections(spark):
    spec = ingest.EntitySpec("song", {"title": ingest.Attribute("string"), "tempo": ingest.Attribute("int", low=0, high=300, optional=True), "vec": ingest.Attribute("vector", dim=2, optional=True), "at": ingest.Attribute("timestamp", optional=True), "place": ingest.Attribute("geo", optional=True), "tags": ingest.Attribute("set", optional=True), "both": ingest.Attribute("float", computed="tempo * 2")})
    cases = [
        ({"title": '"a"', "tags": '["b","a","b"]'}, None), ({"title": "1"}, "title"), ({}, "missing"), ({"title": '"a"', "tempo": "1.5"}, "tempo"), ({"title": '"a"', "tempo": "301"}, "tempo"), ({"title": '"a"', "vec": "[1]"}, "vec"),
        ({"title": '"a"', "vec": "[1,2]"}, None), ({"title": '"a"', "at": '"yesterday"'}, "at"), ({"title": '"a"', "at": '"2024-01-01T00:00:00Z"'}, None), ({"title": '"a"', "place": '{"lat":91,"lon":0}'}, "place"), ({"title": '"a"', "place": '{"lat":1,"lon":2}'}, None),
        ({"title": '"a"', "both": "3"}, "computed"), ({"title": '"a"', "zip": "1"}, "zip"), ({"title": "null"}, "missing"),
    ]
    rows = spark.createDataFrame([("song", str(k), c) for k, (c, _) in enumerate(cases)] + [("song", "", {"title": '"a"'}), ("song", "x" * 201, {"title": '"a"'}), ("book", "1", {}), (None, None, None)], "entity string, id string, attrs map<string,string>")
    good, bad = ingest.validate_entities(rows, spec)
    assert {r.id for r in good.collect()} == {str(k) for k, (_, why) in enumerate(cases) if why is None}
    why = {r.id: r.reject_reason for r in bad.where("entity = 'song'").collect()}
    assert all(w in why[str(k)] for k, (_, w) in enumerate(cases) if w)
    assert good.where("id = '0'").first().tags == ["a", "b"]
    assert bad.count() == sum(w is not None for _, w in cases) + 4


def test_interactions(spark):
    rows = spark.createDataFrame([("u", "play", "s", "1.5", "2024-01-01T00:00:00Z", {"n": "3", "q": '"x"'}), ("u", "play", "s", None, None, None), ("u", "play", "s", "x", None, None), ("", "play", "s", None, None, None), ("u", "hum", "s", None, None, None), ("u", "play", "s", None, "never", None), ("u", "play", "s", None, None, {"n": '"3"'}), ("u", "play", "s", None, None, {"z": "1"})], "user string, type string, target string, value string, ts string, fields map<string,string>")
    good, bad = ingest.validate_interactions(rows, {"play": {"n": "int", "q": "string"}}, F.lit("2030-01-01").cast("timestamp"))
    assert good.count() == 2 and bad.count() == 6
    assert good.where("value = 1.5").first().fields == {"n": "3", "q": "x"}
    assert good.where("value is null").first().ts.year == 2030


def test_json_lines(spark, tmp_path):
    rows = ['{"id": "1", "n": 2}', "", "{oops", '{"id": "2", "q": 1}', '{"id": "3"}', ' \t\r', '{"id":"b","n":"oops"}', '{"id":"c","n":[1]}', '{"id":"e"} trailing', "[1]", '{"id":"f","n":2.5,"tags":["x"]}', '{"id":4}', '{"id":"g","n":null,"tags":"x"}', '{"id":"h","tags":["x"],"n":7}\r', '{"id":"1"}] x', '{"id":"1"}} x', '{"id":"1"},{"id":"2"}']
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    good, bad = ingest.json_lines(spark, str(tmp_path), "id string, n int, tags array<string>", ["id", "n", "tags"])
    assert sorted((r.line, r.id, r.n) for r in good.collect()) == [(1, "1", 2), (5, "3", None), (14, "h", 7)]
    no = "line is not a JSON object"
    assert {r.line: r.reject_reason for r in bad.collect()} == {3: no, 4: "unknown key", 7: "n is not a int", 8: "n is not a int", 9: no, 10: no, 11: "n is not a int", 12: "id is not a string", 13: "tags is not a array<string>", 15: no, 16: no, 17: no}


def test_line_numbers_of_split_files(spark, tmp_path):
    """Several files, each read in many blocks."""
    for name, n in (("a", 700), ("b", 300)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} line {k}\n" if k % 7 else "\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = ingest.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 1000 and all(r.value in ("", f"{r.file[-5]} line {r.line}") for r in rows)
    assert sorted((r.file[-5], r.line) for r in rows) == [("a", k) for k in range(1, 701)] + [("b", k) for k in range(1, 301)]


def test_models(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        tables.load_model(spark, root, "m")
    assert tables.save_model(spark.range(3), root, "m") == 1 and tables.save_model(spark.range(5), root, "m") == 2
    assert tables.load_model(spark, root, "m").count() == 5


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    assert sorted((r.id, r.v) for r in tables.upsert_entities(old, new, ["id"], "at").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    ev = spark.createDataFrame([("u", 1.0, 1), ("u", 3.0, 5), ("u", 2.0, 3)], "user string, value double, seq int")
    assert [tuple(r) for r in tables.upsert_interactions(ev, ["user"]).select("seq", "value").collect()] == [(1, 3.0)]


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("u", "play", "s", "2024-01-01 00:00:00"), ("u", "play", "s", "2024-01-01 00:00:00"), ("u", "play", "t", "2024-01-01 00:10:00")], "user string, type string, target string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    rows = spark.readStream.schema("user string, type string, target string, ts timestamp").parquet(src)
    stream.append(stream.deduplicated(rows, ["user", "type", "target", "ts"]), out, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    assert stream.windowed_counts(rows).isStreaming and stream.sessions(rows).isStreaming
