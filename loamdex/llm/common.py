"""What several operators share: the word rule, the shared folder and the dealing of rows in doc_id order."""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.sources.shared import new_path, shared_dir

__all__ = ["cut", "give_back", "in_shards", "let", "new_path", "order_key", "shared_dir", "words_in"]

#: A word of a text, as a Java, RE2 or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Order key of rows whose doc_id is null: before all others.
NULL_KEY = -(1 << 63)


def give_back() -> None:
    """Return what a worker has freed to the system; workers live on, and the next operator needs the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder so that later steps don't compute them again."""
    context, folder = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def order_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_KEY))


def in_shards(docs: DataFrame, key: str, tie: str, rows_per_shard: int = 4096, most: int = 65536) -> tuple[DataFrame, list[tuple[int, int]]]:
    """docs with a column _shard, so that shards are ranges of (key, tie) in ascending order, and each shard's bound.

    tie: a 64-bit hash of what tells rows of one key apart. The bounds are quantiles of the key alone (one pass that reads
    no other column), whose number is at most ``most``, which bounds what the driver holds. A key that is several quantiles
    holds many rows and has as many shards, equal ranges of tie; any other bound is the first key of its shard.
    """
    keys = docs.select(F.col(key).alias("k"))
    rows, first = keys.agg(F.count(F.lit(1)), F.min("k")).first()
    if not rows:
        return docs.withColumn("_shard", F.lit(0)), []
    n = max(1, min(most, -(-rows // rows_per_shard)))
    # percentile_approx keeps longs exact; approxQuantile would pass them through doubles
    cuts = keys.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    times = Counter([first, *map(int, cuts)])
    bounds = [(k, NULL_KEY + i * (1 << 64) // times[k]) for k in sorted(times) for i in range(times[k])]
    if len(bounds) == 1:
        return docs.withColumn("_shard", F.lit(0)), bounds
    at, ties = (F.lit([b[i] for b in bounds[1:]]) for i in range(2))
    steps = F.sequence(F.lit(1), F.lit((len(bounds) - 1).bit_length()))
    # binary search: how many bounds are at or below the row
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"))

    def halve(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = (F.get(at, mid) < F.col(key)) | ((F.get(at, mid) == F.col(key)) & (F.get(ties, mid) <= F.col(tie)))
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))
        )

    return docs.withColumn("_shard", F.aggregate(steps, state, halve, lambda s: s["lo"])), bounds
