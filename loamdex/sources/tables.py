"""Indexes over the star-schema, event and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.index import Index
from loamdex.schema import Field, Schema
from loamdex.sources.shared import new_path

NOW_MS = 1_706_745_600_000
START_MS, MINUTE_MS = 1_704_067_200_000, 60_000

DOCS = Schema({"body": Field("text", weight=1.0), "lang": Field("keyword"), "source": Field("keyword"), "n_chars": Field("number"), "quality": Field("bool"), "toxic": Field("bool")})
EVENTS = Schema({"event_type": Field("keyword"), "user": Field("keyword"), "value": Field("number"), "k": Field("number"), "ts": Field("date")})
ORDERS = Schema({
    "status": Field("keyword"), "priority": Field("keyword"), "total": Field("number"), "orderdate": Field("date"),
    "flags": Field("keyword", True), "qty": Field("number", True), "shipdates": Field("date", True),
})
PAGES = Schema({"url": Field("keyword"), "html": Field("text", weight=1.0), "title": Field("text", weight=3.0)})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: Column) -> Column:
    """Epoch milliseconds of a timestamp with or without zone, taken as UTC."""
    return F.floor((F.unix_micros(column.cast("timestamp"))) / 1000).cast("long")


def _timed(rows: DataFrame, key: str) -> DataFrame:
    at = F.lit(START_MS) + F.lit(MINUTE_MS) * F.col(key)
    return rows.withColumns({"item_id": F.col(key), "created_at": at, "updated_at": at})


def _index(rows: DataFrame, schema: Schema) -> Index:
    return Index.from_typed(rows, schema, now_ms=lambda: NOW_MS)


_STORED: dict[tuple[str, str, str], Index] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> Index:
    """An index of this name, stored once for each session and folder: by path, with its tokens and the inverted table."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = fresh(spark, sf_dir, name, terms=True)
    return _STORED[key]


def fresh(spark: SparkSession, sf_dir: str, name: str, terms: bool = False) -> Index:
    """A stored copy of its own, to be written to."""
    return globals()[name](spark, sf_dir).saved(f"{new_path(spark, name)}.idx", terms)


def docs(spark: SparkSession, sf_dir: str) -> Index:
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    rows = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    rows = rows.withColumns({"path": F.concat(F.lit("/docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string")), "body": F.col("text")})
    return _index(_timed(rows, "doc_id"), DOCS)


def events(spark: SparkSession, sf_dir: str) -> Index:
    rows = read(spark, sf_dir, "events").withColumns({
        "path": F.concat(F.lit("/events/"), F.col("event_id").cast("string")),
        "user": F.col("user_id").cast("string"),
        "k": F.get_json_object("props", "$.k").cast("double"),
        "ts": millis(F.col("ts")),
    })
    return _index(_timed(rows, "event_id"), EVENTS)


def orders(spark: SparkSession, sf_dir: str) -> Index:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("flags"),
        F.array_sort(F.collect_set("l_quantity")).alias("qty"),
        F.array_sort(F.collect_set(millis(F.col("l_shipdate")))).alias("shipdates"),
    )
    rows = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumns({
        "path": F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")),
        "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "total": F.col("o_totalprice"), "orderdate": millis(F.col("o_orderdate")),
    })
    return _index(_timed(rows, "o_orderkey"), ORDERS)


def pages(spark: SparkSession, sf_dir: str) -> Index:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    rows = read(spark, sf_dir, "pages").withColumns({
        "path": F.concat(F.lit("/pages/"), F.col("page_id").cast("string")),
        "title": F.when(F.regexp_like("html", F.lit(r"(?is)<title[^>]*>.*?</title>")), title),
    })
    return _index(_timed(rows, "page_id"), PAGES)
