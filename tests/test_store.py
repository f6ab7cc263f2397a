"""The parts of a stored index: changes beside a base, totals, the inverted table, locks, imports and stream batches."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loamdex.errors import NotFound, StorageError
from loamdex.index import Batch, Index, SearchOptions
from loamdex.schema import Schema
from loamdex.sources.files import Files
from loamdex.sources.jsonl import read_jsonl
from loamdex.sources.store import Lock, list_indexes
from loamdex.streaming.ingest import ingest

SPEC = "title:text,tag:keyword,n:number"


def made(spark, path, n=0):
    index = Index.create(spark, str(path), Schema.from_spec(SPEC), lambda: 1000)
    if n:
        index.put_lines([json.dumps({"path": f"/d/{i:05d}", "title": f"note number {i}", "tag": f"t{i % 7}", "n": i}) for i in range(n)])
    return index


def recount(index):
    row = index.items.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return tuple(row)


def test_small_writes_cost_what_they_change(spark, tmp_path):
    index = made(spark, tmp_path / "a.idx", 4000)
    base = index._meta.base
    assert index._meta.delta is None and (index._meta.rows, index._meta.length) == recount(index) == (4000, 12_000)
    index.put_json({"path": "/d/00007", "title": "another one", "tag": "new"})
    index.delete("/d/00009")
    index.put_json({"path": "/x", "title": "x y z w"})
    assert index._meta.base == base and index._meta.delta_rows == 3
    assert Files(spark).bytes(index.store.at(index._meta.delta)) < Files(spark).bytes(index.store.at(base)) / 5
    assert (index._meta.rows, index._meta.length) == recount(index) == (4000, 12_000 - 3 - 3 + 2 + 4)
    assert index.get("/d/00007")["doc"]["title"] == "another one" and index.count("tag:new") == 1
    with pytest.raises(NotFound):
        index.get("/d/00009")
    ids = {r.path: r.item_id for r in index.items.filter("path IN ('/d/00007', '/x')").collect()}
    assert ids == {"/d/00007": 8, "/x": 4002}
    again = Index.open(spark, index.store.root)
    assert sorted(r.path for r in again.items.collect()) == sorted(r.path for r in index.items.collect())
    assert index.delete_where("n<100") == 98 and index._meta.base == base and recount(index) == (index._meta.rows, index._meta.length)
    # many changes are merged into a new base, which holds the same
    index.put_lines([json.dumps({"path": f"/d/{i:05d}", "title": "again"}) for i in range(50, 2000)])
    assert index._meta.base != base and index._meta.delta is None and recount(index) == (index._meta.rows, index._meta.length) == (3952, index._meta.length)
    assert {r.value for r in index.discover_values("tag").collect()} == {"new", *(f"t{i}" for i in range(7))}


def test_random_batches_against_a_dict(spark, tmp_path):
    rng, index, want, born = random.Random(2), made(spark, tmp_path / "r.idx"), {}, {}
    for step in range(5):
        batch = Batch()
        for _ in range(rng.randint(1, 60)):
            path = f"/p{rng.randrange(40)}"
            if rng.random() < 0.3:
                batch.delete(path)
                want.pop(path, None)
                born.pop(path, None)
            else:
                doc = {"path": path, "title": f"w{rng.randrange(9)} v", "n": rng.randrange(100)}
                batch.put(doc)
                want[path] = doc
                born.setdefault(path, (step, len(batch.ops)))
        index.batch(batch)
        if step == 2:
            index.optimize()
        rows = index.items.orderBy("item_id").collect()
        assert {r.path: json.loads(r.data_json) for r in rows} == want
        # ids follow the order in which the items came to be
        assert [r.path for r in rows] == sorted(born, key=born.get) and len({r.item_id for r in rows}) == len(rows)
        assert recount(index) == (index._meta.rows, index._meta.length)


def test_ids_follow_the_first_put(spark, tmp_path):
    index = made(spark, tmp_path / "i.idx")
    batch = Batch()
    for op, path in (("put", "/a"), ("put", "/b"), ("put", "/a"), ("put", "/c"), ("delete", "/c"), ("put", "/d"), ("put", "/c")):
        batch.put({"path": path}) if op == "put" else batch.delete(path)
    index.batch(batch)
    assert [r.path for r in index.items.orderBy("item_id").collect()] == ["/a", "/b", "/d", "/c"]


def test_the_inverted_table_names_what_a_scan_finds(spark, tmp_path):
    index = made(spark, tmp_path / "t.idx", 3000)
    index.put_json({"path": "/d/needle", "title": "needle unique xyz 12345", "tag": "needle"})
    queries = ("needle", '"unique xyz"', "title:needle AND tag:needle", "note AND n:17", '"number 17"', "absent", "needle OR n:3", "NOT needle AND n:3", '"note needle"')
    before = {q: (sorted(r.path for r in index.matching(q).collect()), index.search(q, SearchOptions(limit=5)).items) for q in queries if "NOT" not in q}
    assert index.store.terms(index._meta, "needle") is None
    index.optimize()
    assert index._meta.terms and {tuple(r) for r in index.store.terms(index._meta, "needle").collect()} == {("title", "/d/needle")}
    after = {q: (sorted(r.path for r in index.matching(q).collect()), index.search(q, SearchOptions(limit=5)).items) for q in before}
    assert before == after and before["needle"][0] == ["/d/needle"] and len(before["note AND n:17"][0]) == 1
    plan = index.matching("needle")._jdf.queryExecution().toString()
    assert "path" in plan.split("PushedFilters: [")[1].split("]")[0]
    # while there are changes beside the base it is not asked
    index.put_json({"path": "/other", "title": "needle too"})
    assert sorted(r.path for r in index.matching("needle").collect()) == ["/d/needle", "/other"]


def test_locks_of_the_dead_are_given_up(spark, tmp_path):
    index = made(spark, tmp_path / "l.idx")
    gone = subprocess.run([sys.executable, "-c", "import os; print(os.getpid())"], capture_output=True, text=True).stdout
    lock = Lock(index.store.files, index.store.at("lock"))
    held = json.loads(lock.token)
    for owner, free in ((held | {"pid": int(gone)}, True), (held | {"pid": os.getppid()}, False), (held | {"host": "elsewhere"}, False), (held | {"host": "elsewhere", "at": 0}, True), ({"odd": 1}, False)):
        index.store.files.write(index.store.at("lock"), json.dumps(owner))
        if free:
            index.put_json({"path": "/a"})
            assert not index.store.files.exists(index.store.at("lock"))
        else:
            with pytest.raises(StorageError, match="another writer"):
                index.put_json({"path": "/a"})
    index.store.files.delete(index.store.at("lock"))


def test_paths_with_a_scheme(spark, tmp_path):
    root = f"file://{tmp_path}/s.idx"
    index = made(spark, root, 5)
    index.put_json({"path": "/new", "title": "here"})
    page = index.search("n>=0", SearchOptions(limit=2, cursor_mode="short"))
    assert page.next_cursor.startswith("c:") and Index.open(spark, root, lambda: 1000).search("n>=0", SearchOptions(limit=2, after=page.next_cursor)).items
    assert Index.open(spark, root).count("here") == 1 and list_indexes(spark, f"file://{tmp_path}") == ["s.idx"]
    index.store.drop()
    assert list_indexes(spark, str(tmp_path)) == []


def test_files_are_imported_in_order_of_name_and_line(spark, tmp_path):
    sizes = {"a.jsonl": 1, "b.jsonl": 51, "c.jsonl": 1, "d.jsonl": 300}
    want = []
    for name, n in sizes.items():
        lines = [json.dumps({"path": f"/{name}/{i}", "title": "x" * (i % 40)}) for i in range(n)]
        want += [json.loads(x)["path"] for x in lines]
        (tmp_path / name).write_text("\n\n".join(lines) + "\n")
    rows = read_jsonl(spark, str(tmp_path)).orderBy("seq").collect()
    assert [json.loads(r.data_json)["path"] for r in rows] == want and len({r.seq for r in rows}) == len(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert [json.loads(r.data_json)["path"] for r in read_jsonl(spark, str(tmp_path)).orderBy("seq").collect()] == want
        one = [json.loads(r.data_json)["path"] for r in read_jsonl(spark, str(tmp_path / "d.jsonl")).orderBy("seq").collect()]
        assert one == want[-300:]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    index = made(spark, tmp_path / "f.idx")
    index.import_jsonl(str(tmp_path / "*.jsonl"))
    assert [r.path for r in index.items.orderBy("item_id").collect()] == want


def test_stream_batches_are_applied_once_and_in_order_of_time(spark, tmp_path):
    index = made(spark, tmp_path / "s.idx")
    rows = [(i, "/a", json.dumps({"path": "/a", "n": i})) for i in (3, 9, 5)] + [(1, "/b", json.dumps({"path": "/b"}))]
    spark.createDataFrame(rows, "at long, path string, data_json string").withColumn("ts", F.timestamp_seconds("at")).drop("at").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, data_json string, ts timestamp").parquet(str(tmp_path / "in"))
    ingest(stream, index, str(tmp_path / "c"), once=True).awaitTermination()
    assert index.get("/a")["doc"]["n"] == 9 and index._meta.streams == {str(tmp_path / "c"): 0}
    ops = spark.createDataFrame([(1, "put", "/a", '{"path": "/a", "n": 1}')], "seq long, op string, path string, data_json string")
    assert index.write_ops(ops, stream=(str(tmp_path / "c"), 0)) == 0 and index.get("/a")["doc"]["n"] == 9
    assert index.write_ops(ops, stream=(str(tmp_path / "c"), 1)) == 1 and index.get("/a")["doc"]["n"] == 1


def test_phrases_of_several_fields_count_each_row_once(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "p.idx"), Schema.from_spec("a:text,b:text"), lambda: 1)
    index.put_lines([json.dumps({"path": f"/{i}", "a": "word" if i < 3 else "x", "b": "word" if 2 <= i < 6 else "y"}) for i in range(40)])
    from loamdex.operators.ranking import Corpus

    phrases = {("word",): ["a", "b"], ("x", "y"): ["a"]}
    assert Corpus(index.items, index.schema, phrases).holding == {("word",): 6, ("x", "y"): 0}
    index.optimize()
    assert index._holding(("word",), ["a", "b"]) == 6 and index._holding(("word",), ["a"]) == 3 and index._holding(("x", "y"), ["a"]) is None
