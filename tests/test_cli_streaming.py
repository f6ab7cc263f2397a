import json

from pyspark.sql import functions as F

from loamdex.cli import run
from loamdex.index import Index
from loamdex.schema import Schema
from loamdex.streaming.ingest import deduplicated, ingest, windowed_counts


def test_commands(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def cli(*argv):
        return run(spark, list(argv), folder)

    assert cli("index", "create", "n", "--field", "title:text", "--field", "tags:keyword:multi", "--field", "p:number")[0] == 0
    lines = tmp_path / "docs.jsonl"
    lines.write_text("".join(json.dumps({"path": f"/d{i}", "title": f"note {i}", "tags": ["a", f"t{i % 2}"], "p": i}) + "\n\n" for i in range(5)))
    assert cli("put", "n", "--import", str(lines)) == (0, "wrote 5 documents\n")
    assert cli("put", "n", "/x", "--set", "title=a b", "--set", "p=7", "--set", "tags=one,two")[0] == 0
    assert json.loads(cli("get", "n", "/x")[1]) == {"title": "a b", "p": "7", "tags": "one,two", "path": "/x"}
    assert cli("search", "n", "tags:t1", "--format", "paths", "--rank", "field:p")[1] == "/d3\n/d1\n"
    page = json.loads(cli("search", "n", "tags:a", "--limit", "2", "--format", "json", "--show", "p")[1])
    assert page["has_more"] and page["next_cursor"].startswith("c:")
    assert json.loads(cli("search", "n", "tags:a", "--after", page["next_cursor"], "--format", "json")[1])["items"]
    assert cli("discover", "values", "n", "tags", "--where", "p<5", "--top", "1")[1] == "a\t5\n"
    assert cli("discover", "fields", "n")[1].startswith("p\tNumber\t6")
    assert json.loads(cli("stats", "n", "p")[1])["max"] == 7.0
    assert cli("delete", "n", "--where", "p>3")[1] == "deleted 2\n" and cli("delete", "n")[0] == 0
    assert cli("index", "list")[1] == "n.idx\n" and json.loads(cli("index", "stats", "n")[1])["items"] == 4
    wider = tmp_path / "s.json"
    wider.write_text(Schema.from_spec("title:text,tags:keyword:multi,p:number,q:number").to_json())
    assert cli("index", "apply-schema", "n", "--schema", str(wider))[1] == "added q\n"
    assert cli("index", "migrate", "n", "--schema", str(wider), "--to", "m")[0] == 0
    code, text = cli("search", "n", "nope:1")
    assert code == 1 and "UnknownField" in text
    assert cli("index", "drop", "m")[0] == 0
    root = tmp_path / "bundle"
    root.mkdir()
    (root / "a.md").write_text("---\ntype: A\n---\nx\n")
    assert cli("okf", "validate", str(root)) == (0, "1 concepts, 0 errors, 0 warnings\n")
    assert "added: 1" in cli("okf", "sync", str(root), "kb", "--dry-run")[1] and "kb.idx" not in cli("index", "list")[1]
    assert json.loads(cli("okf", "sync", str(root), "kb", "--format", "json")[1])["added"] == 1
    (root / "b.md").write_text("bad\n")
    assert cli("okf", "sync", str(root), "kb")[0] == 1 and cli("okf", "validate", str(root))[0] == 1


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    docs = events.withColumn("path", F.concat(F.lit("/e/"), F.col("event_id").cast("string")))
    docs = docs.select("ts", "path", "event_type", F.to_json(F.struct("path", "event_type")).alias("data_json"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    index = Index.create(spark, str(tmp_path / "s.idx"), Schema.from_spec("event_type:keyword"))
    ingest(deduplicated(stream), index, str(tmp_path / "c1"), once=True).awaitTermination()
    assert index.items.count() == docs.count()
    query = windowed_counts(stream, "event_type", size="1 day").writeStream.format("memory").queryName("facets").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = docs.groupBy(F.date_trunc("day", "ts").alias("start"), F.col("event_type").alias("value")).count()
    assert sorted(map(str, spark.table("facets").collect())) == sorted(map(str, want.collect()))
