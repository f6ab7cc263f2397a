"""Ordered puts and deletes as changes to the items: one shuffle of the batch by path, one join with what stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators.ingest import typed
from loamdex.schema import Schema


def typed_ops(ops: DataFrame, schema: Schema) -> DataFrame:
    """Puts as typed rows with their errors, deletes as rows that only have a path."""
    puts = typed(ops.filter("op = 'put'").drop("path"), schema)
    return puts.unionByName(ops.filter("op = 'delete'").select("seq", "op", "path"), allowMissingColumns=True)


def last_ops(ops: DataFrame) -> DataFrame:
    """The last operation of each path; whether a delete before it made the path new (fresh); and, as born, its first put since."""
    last, every = Window.partitionBy("path").orderBy(F.desc("seq")), Window.partitionBy("path")
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(every)
    rows = ops.withColumns({"_n": F.row_number().over(last), "_gone": gone})
    born = F.min(F.when((F.col("op") == "put") & (F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))), F.col("seq"))).over(every)
    return rows.withColumns({"born": born, "fresh": F.col("_gone").isNotNull()}).filter("_n = 1").drop("_n", "_gone")


def changes(items: DataFrame, ops: DataFrame, schema: Schema, now_ms: int, next_id: int) -> DataFrame:
    """What a batch changes, a row for each path: the item as it is now, or gone; and was, old_length of what stood before.

    ops: typed_ops without errors. A put of a known path keeps its item_id and created_at and replaces the rest; one after
    a delete in the same batch is a new item. New ids follow the order in which the items came to be: by the first put of
    a path that no later delete undid, whatever put comes last.
    """
    old = items.select("path", F.col("item_id").alias("_old_id"), F.col("created_at").alias("_old_created"), F.col("length").alias("old_length"))
    joined = last_ops(ops).join(old, "path", "left").withColumns({"was": F.col("_old_id").isNotNull(), "gone": F.col("op") == "delete"})
    keeps = F.col("was") & ~F.col("fresh")
    # ids of new rows: a rank within ranges of seq, on top of the ranges before, so no task sees all rows
    new = joined.filter(~F.col("gone") & ~keeps).withColumn("_range", F.floor(F.col("born") / (1 << 16)))
    totals = new.groupBy("_range").agg(F.count(F.lit(1)).alias("_m"))
    before = totals.select("_range", (F.sum("_m").over(Window.orderBy("_range")) - F.col("_m")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("born", "path"))
    new = new.withColumn("_rank", rank).join(before, "_range").withColumn("item_id", (F.lit(next_id - 1) + F.col("_before") + F.col("_rank")).cast("long"))
    kept = joined.filter(~F.col("gone") & keeps).withColumns({"item_id": F.col("_old_id"), "created_at": F.coalesce("created_at", "_old_created")})
    names = [*schema.struct().fieldNames(), "gone", "was", "old_length"]
    # a delete of what never stood changes nothing
    dead = joined.filter(F.col("gone") & F.col("was")).withColumn("item_id", F.col("_old_id"))
    live = new.select(*names).unionByName(kept.select(*names))
    live = live.withColumns({"created_at": F.coalesce("created_at", F.lit(now_ms)), "updated_at": F.coalesce("updated_at", F.lit(now_ms))})
    return live.unionByName(dead.select(*names))
