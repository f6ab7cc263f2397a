"""Scenarios over a stored index."""

import json

import pytest
from pyspark.sql import functions as F

from loamdex.errors import CursorError, InvalidArgument, JsonError, NotFound, SchemaError, StorageError, TypeMismatch
from loamdex.index import Batch, Index, SearchOptions
from loamdex.operators.output import Page, render
from loamdex.plans import catalogue
from loamdex.schema import Field, Schema
from loamdex.sources.store import list_indexes, resolve

WIDE = Schema({
    "title": Field("text", weight=2.0), "body": Field("text", weight=1.0), "tags": Field("keyword", True), "category": Field("keyword"), "priority": Field("number"),
    "score": Field("number"), "due": Field("date"), "published": Field("date", True), "active": Field("bool"),
})
DOCS = [
    {"path": "/docs/rust-guide", "title": "Rust programming guide", "body": "Systems programming in depth", "tags": ["rust", "programming", "progress"], "category": "technical", "priority": 10, "score": 95.5, "due": "2024-03-01", "published": ["2024-01-15", "2024-02-01T10:00:00Z"], "active": True},
    {"path": "/docs/python-intro", "title": "Python introduction", "body": "Programming for beginners", "tags": ["python", "programming"], "category": "technical", "priority": 5, "score": 80, "due": "2024-06-01", "active": True},
    {"path": "/notes/meeting", "title": "Meeting notes", "body": "Nothing of note", "tags": ["meeting"], "category": "notes", "priority": 1, "active": False},
    {"path": "/notes/ideas", "title": "Ideas", "body": "memory allocation tricks", "tags": [], "category": "notes", "score": 12.25, "active": True, "unknown": {"kept": [1, None]}},
    {"path": "/blog/post", "title": "Café notes", "body": "of the day of the week", "tags": "memory", "category": "blog", "priority": "7", "active": "false"},
]


class Clock:
    def __init__(self):
        self.now = 1_700_000_000_000

    def __call__(self):
        self.now += 1000
        return self.now


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = Index.create(spark, str(tmp_path_factory.mktemp("indexes") / "wide.idx"), WIDE, Clock())
    assert made.put_lines([json.dumps(d) for d in DOCS] + ["", "  "]) == 5
    return made


def found(index, query, **options):
    return [i["path"] for i in index.search(query, SearchOptions(**options)).items]


@pytest.mark.parametrize(
    ("query", "paths"),
    [
        ("programming", {"/docs/rust-guide", "/docs/python-intro"}),
        ("tags:rust", {"/docs/rust-guide"}),
        ("tags:prog*", {"/docs/rust-guide", "/docs/python-intro"}),
        ("tags:PROG*", {"/docs/rust-guide", "/docs/python-intro"}),
        ("programming AND active:true", {"/docs/rust-guide", "/docs/python-intro"}),
        ("tags:rust OR tags:python", {"/docs/rust-guide", "/docs/python-intro"}),
        ("category:notes AND NOT active:false", {"/notes/ideas"}),
        ("category:notes AND NOT has:tags", {"/notes/ideas"}),
        ("category:notes AND has:score", {"/notes/ideas"}),
        ('path:"/docs/*"', {"/docs/rust-guide", "/docs/python-intro"}),
        ("priority>=5 AND priority<10", {"/docs/python-intro", "/blog/post"}),
        ("published:2024-02-01..2024-02-02", {"/docs/rust-guide"}),
        ("cafe", {"/blog/post"}),
        ('"of the week"', {"/blog/post"}),
        ('"the of"', set()),
        ('"!!!" OR tags:memory', {"/blog/post"}),
        ("category:blog AND active:false", {"/blog/post"}),
        ("title:notes AND NOT body:note", {"/blog/post"}),
    ],
)
def test_queries(index, query, paths):
    assert set(found(index, query)) == paths
    assert index.count(query) == len(paths)


def test_shapes_and_point_reads(index):
    page = index.search("tags:memory", SearchOptions(show=["title", "nope"], explain=True))
    assert page.items == [{"path": "/blog/post", "title": "Café notes"}]
    assert page.explain_steps and "Filter" in page.explain_plan
    assert index.search("category:notes AND score>1", SearchOptions(show="all")).items[0]["unknown"] == {"kept": [1, None]}
    got = index.get("/blog/post")
    assert got["doc"]["title"] == "Café notes" and got["created_at"] == got["updated_at"]
    assert index.peek("/notes/meeting")["category"] == "notes"
    with pytest.raises(NotFound):
        index.get("/nowhere")


@pytest.mark.parametrize("rank", ["default", "recency", "none", "field:score", "fts_id"])
@pytest.mark.parametrize("mode", ["full", "short"])
def test_pages_join_to_the_whole(index, rank, mode):
    query = "notes OR programming OR category:notes"
    whole = found(index, query, rank=rank, limit=100)
    seen, after = [], None
    while True:
        page = index.search(query, SearchOptions(rank=rank, limit=1, after=after, cursor_mode=mode))
        seen += [i["path"] for i in page.items]
        after = page.next_cursor
        if not page.has_more:
            break
    assert seen == whole and after is None
    assert len(whole) == (3 if rank == "field:score" else 5)


@pytest.mark.parametrize("rank,query", [("recency", "active:true OR category:notes OR category:blog"), ("none", "active:true OR category:notes OR category:blog"), ("field:score", "active:true OR category:notes OR category:blog"), ("default", "notes OR programming")])
def test_all_pages_at_once_are_those_one_by_one(index, rank, query):
    """Also from a cursor on; each page's cursor leads search to the next page."""
    for limit, after in ((1, None), (2, None), (100, None), (1, "first")):
        one = lambda at: index.search(query, SearchOptions(rank=rank, limit=limit, after=at))  # noqa: E731, B023
        at = one(None).next_cursor if after else None
        want, cursor = [one(at)], {}
        while want[-1].has_more:
            want.append(one(want[-1].next_cursor))
        got = index.pages(query, SearchOptions(rank=rank, limit=limit, after=at)).orderBy("page", "place").collect()
        assert [(r.page, r.place, r.path) for r in got] == [(p, i, x["path"]) for p, page in enumerate(want) for i, x in enumerate(page.items)]
        cursor = {r.page: r.next_cursor for r in got if r.next_cursor}
        assert set(cursor) == set(range(len(want) - 1))
        for p, token in cursor.items():
            assert one(token).items == want[p + 1].items
    assert index.pages("score>1000").collect() == []
    with pytest.raises(InvalidArgument):
        index.pages(query, SearchOptions(limit=0))


def test_cursor_pages_takes_fewer_jobs_than_pages(spark):
    """Every page took a job or more."""
    spark.sparkContext.setJobGroup("cursor-pages", "")
    pages = 1 + catalogue.queries()["cursor_pages"](spark, "/root/testdata/sf0.01").agg(F.max("page")).first()[0]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert pages == 52 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("cursor-pages")) < 26


def test_rank_by_field_and_weight(index):
    assert found(index, "category:technical", rank="field:score")[0] == "/docs/rust-guide"
    assert found(index, "notes")[0] in ("/notes/meeting", "/blog/post")


def test_cursors_belong_to_their_query(index):
    token = index.search("category:notes", SearchOptions(limit=1)).next_cursor
    with pytest.raises(CursorError):
        index.search("category:blog", SearchOptions(after=token))
    with pytest.raises(CursorError):
        index.search("category:notes", SearchOptions(after=token, rank="none"))
    for bad in ("!!", "c:000000000000000000000000", "e30"):
        with pytest.raises(CursorError):
            index.search("category:notes", SearchOptions(after=bad))
    with pytest.raises(InvalidArgument):
        index.search("category:notes", SearchOptions(rank="bm25 * 2"))
    assert index.search("category:notes", SearchOptions(limit=0)).next_cursor is None


def test_discovery_and_statistics(index):
    assert [tuple(r) for r in index.discover_values("tags", "category:technical").collect()] == [("programming", 2), ("progress", 1), ("python", 1), ("rust", 1)]
    fields = {r.field: (r.type, r.doc_count) for r in index.discover_fields().collect()}
    assert fields["tags"] == ("Keyword", 4) and fields["score"] == ("Number", 3) and len(fields) == 9
    assert index.stats("score", "active:true").first()["count"] == 3
    published = index.stats("published", "", median=True).first()
    assert published["count"] == 2 and published["median"] is not None
    with pytest.raises(TypeMismatch):
        index.stats("tags")
    with pytest.raises(TypeMismatch):
        index.discover_values("score")


def test_upserts_keep_identity(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "a.idx"), Schema.from_spec("title:text,priority:number"), Clock())
    index.put_json({"path": "/test", "title": "one", "priority": 1})
    before = index.get("/test")
    index.put_fields("/test", {"title": "two"})
    after = index.get("/test")
    assert after["created_at"] == before["created_at"] and after["updated_at"] > before["updated_at"]
    assert after["doc"] == {"title": "two", "path": "/test"} and index.items.count() == 1
    assert index.count("title:one OR priority>0") == 0
    assert index.delete("/test") is True and index.delete("/test") is False
    with pytest.raises(NotFound):
        index.get("/test")


def test_batches_are_ordered_and_atomic(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "b.idx"), Schema.from_spec("tags:keyword:multi"), Clock())
    index.put_json({"path": "/x", "tags": ["old"]})
    batch = Batch()
    batch.put({"path": "/x", "tags": ["a"]})
    batch.put({"path": "/x", "tags": ["b"]})
    batch.delete("/x2")
    batch.put({"path": "/y", "tags": ["b", "b"]})
    batch.delete("/y")
    assert index.batch(batch) == 4
    assert [tuple(r) for r in index.discover_values("tags").collect()] == [("b", 1), ("a", 0), ("old", 0)]
    assert index.batch(Batch()) == 0

    def swallow(b):
        b.put({"path": "/z", "tags": ["z"]})
        with pytest.raises(JsonError):
            b.put({"tags": ["no path"]})

    with pytest.raises(JsonError):
        index.write_batch(swallow)
    with pytest.raises(TypeMismatch):
        index.write_batch(lambda b: (b.put({"path": "/ok", "tags": ["k"]}), b.put({"path": "/bad", "tags": [1]})))
    assert index.items.count() == 1


@pytest.mark.parametrize(
    ("field", "value", "ok"),
    [("t:text", "", True), ("t:text", 5, False), ("k:keyword", 5, True), ("k:keyword", True, True), ("k:keyword", ["a"], True), ("k:keyword", ["a", "b"], False), ("k:keyword", None, False), ("k:keyword:multi", ["a", 1], False), ("k:keyword:multi", [], True), ("k:keyword", {"a": 1}, False), ("n:number", "2.5", True), ("n:number:multi", ["1", 2, 2], True), ("n:number", "x", False), ("n:number", [1, 2], False), ("n:number", True, False), ("d:date", "2024-01-15", True), ("d:date", "2024-01-15T10:00:00.5+02:00", True), ("d:date", "2024-1", False), ("d:date", 5, False), ("b:bool", "true", True), ("b:bool", 1, False), ("b:bool", "yes", False)],
)
def test_coercion(spark, tmp_path, field, value, ok):
    index = Index.create(spark, str(tmp_path / "c.idx"), Schema.from_spec(field), Clock())
    name = field.split(":")[0]
    if not ok:
        with pytest.raises(TypeMismatch):
            index.put_json({"path": "/p", name: value})
        return
    index.put_json({"path": "/p", name: value})
    row = index.items.first()[f"f_{name}"]
    want = {"k5": "5", "kTrue": "true", "kfalse": "false", "n2.5": 2.5, "bfalse": False, "btrue": True, "d2024-01-15": 1705276800000, "d2024-01-15T10:00:00.5+02:00": 1705305600500, "k['a']": "a", "k[]": None, "n['1', 2, 2]": [1.0, 2.0], "t": ""}
    assert row == want[f"{name}{value}"]


def test_schema_rules():
    for bad in ({}, {"1a": Field("text")}, {"path": Field("text")}, {"a": Field("float")}, {"a": Field("number", weight=1.0)}, {"a": Field("text", weight=0.0)}):
        with pytest.raises(SchemaError):
            Schema(bad)
    assert Schema.from_json(WIDE.to_json()) == WIDE
    with pytest.raises(SchemaError):
        Schema.from_spec("a:text:single")


def test_schema_changes_and_rebuild(spark, tmp_path):
    old = Schema.from_spec("title:text,n:number")
    index = Index.create(spark, str(tmp_path / "d.idx"), old, Clock())
    index.put_lines([json.dumps({"path": f"/p{i}", "title": "words here", "n": i, "abstract": f"more text {i}", "tag": "x"}) for i in range(5)])
    assert index.apply_schema(Schema.from_spec("title:text,n:number,abstract:text,tag:keyword")) == ["abstract", "tag"]
    assert index.count('abstract:"text 3"') == 1 and index.count("tag:x") == 5
    with pytest.raises(SchemaError):
        index.apply_schema(Schema.from_spec("title:text,n:keyword,abstract:text,tag:keyword"))
    other = index.migrate_rebuild(str(tmp_path / "e.idx"), Schema.from_spec("tag:keyword,n:keyword"))
    assert [(r.path, r.created_at, r.f_n) for r in other.items.orderBy("item_id").collect()] == [(r.path, r.created_at, str(int(r.f_n))) for r in index.items.orderBy("item_id").collect()]
    index.optimize()
    assert index.items.count() == 5
    assert list_indexes(spark, str(tmp_path)) == ["d.idx", "e.idx"]
    index.store.drop()
    assert list_indexes(spark, str(tmp_path)) == ["e.idx"]
    with pytest.raises(NotFound):
        Index.open(spark, str(tmp_path / "d.idx"))


def test_scan_is_literal_and_in_byte_order(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "f.idx"), Schema.from_spec("marker:keyword"), Clock())
    index.put_lines([json.dumps({"path": p, "marker": "m"}) for p in ("/z", "/a_", "/aa", "/a%", "/a", "/Ω", "/é")])
    assert list(index.scan_paths("/a")) == ["/a", "/a%", "/a_", "/aa"]
    assert list(index.scan_paths("")) == sorted(("/z", "/a_", "/aa", "/a%", "/a", "/Ω", "/é"), key=str.encode)
    assert set(found(index, "path:/a_*")) == {"/a_", "/aa", "/a%"}


def test_delete_where_and_locks(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "g.idx"), WIDE, Clock())
    index.put_lines([json.dumps(d) for d in DOCS])
    assert index.delete_where("active:false") == 2 and index.delete_where("active:false") == 0
    assert [tuple(r) for r in index.discover_values("category").collect()][-1] == ("blog", 0)
    with index.store.lock(), pytest.raises(StorageError):
        index.put_json({"path": "/w"})
    with pytest.raises(StorageError):
        Index.create(spark, str(tmp_path / "g.idx"), WIDE)


def test_dataframes_as_documents(spark):
    df = spark.createDataFrame([("/a", "x", 1.5, ["p", "q"]), ("/b", None, None, [])], "path string, lang string, n double, tags array<string>")
    index = Index.from_dataframe(df, Schema.from_spec("lang:keyword,n:number,tags:keyword:multi"))
    assert found(index, "n>1") == ["/a"] and found(index, "tags:q") == ["/a"]


def test_formats():
    page = Page([{"path": "/a", "n": 1, "t": "x"}, {"t": ["y"]}], has_more=True)
    assert render(page) == "Found 2 items\n- /a\n  n: 1\n  t: x\n- (no path)\n  t: [\"y\"]\n\nMore results available\n"
    assert render(page, "PATHS") == "/a\n"
    assert json.loads(render(page, "json")) == {"items": page.items, "has_more": True}
    assert render(Page([{"path": "/a"}], "tok", True), "", 12) == "Found 1 item in 12ms\n- /a\n\nNext cursor: tok\n"
    with pytest.raises(InvalidArgument):
        render(page, "xml")


def test_names():
    assert resolve("notes") == "./notes.idx" and resolve("a/b") == "a/b" and resolve("x.idx") == "x.idx"
