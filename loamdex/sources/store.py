"""Immutable parts in a folder: a base, the changes since it, and one pointer that is swapped.

meta.json names the parts. base/items holds one row per item, sorted by path where the index was optimised, and then
base/terms the inverted text table: a row per distinct term, field and item, by bucket of the term. delta holds the rows
that were written since, with the paths that went, so that a write costs what it changes; reading merges the two. Once
the changes are a good part of the base, a write makes a new base of both.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
import zlib
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loamdex.errors import NotFound, StorageError
from loamdex.schema import Schema
from loamdex.sources.files import Files, absolute

# What a folder must say to be an index.
MAGIC, VERSION = "loamdex-index", 2
#: Changes beyond this share of the base, and this many, are merged into a new base.
MERGE_SHARE, MERGE_ROWS, KNOWN_PARTS = 0.25, 1024, 16
#: Buckets of the inverted table, and milliseconds after which a lock whose owner can't be asked is given up.
BUCKETS, LOCK_MS = 64, 6 * 3_600_000
_KNOWN = "field string, value string"


@dataclass(frozen=True)
class Meta:
    """What the pointer says. rows, length: live items and their tokens; delta_rows: rows of the changes;
    known: folders of seen values; terms: whether the base has an inverted table; streams: the last batch of each stream."""

    schema: Schema
    base: str
    next_id: int
    rows: int = 0
    length: int = 0
    delta: str | None = None
    delta_rows: int = 0
    known: tuple[str, ...] = ()
    terms: bool = False
    streams: dict[str, int] = field(default_factory=dict)
    previous: tuple[str, ...] = ()

    def parts(self) -> tuple[str, ...]:
        return tuple(p for p in (self.base, self.delta, *self.known) if p)

    def to_json(self) -> str:
        body = {k: v for k, v in self.__dict__.items() if k != "schema"}
        return json.dumps({"magic": MAGIC, "version": VERSION, "schema": self.schema.to_json()} | body)

    @classmethod
    def from_json(cls, body: dict[str, Any]) -> Meta:
        names = {k: tuple(v) if isinstance(v, list) else v for k, v in body.items() if k in cls.__dataclass_fields__ and k != "schema"}
        return cls(Schema.from_json(body["schema"]), **names)


class Store:
    """The root is a path that driver and executors both reach, on any file system that Hadoop's client knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, absolute(root), Files(spark)

    def at(self, *names: str) -> str:
        return "/".join([self.root, *names])

    @property
    def meta_path(self) -> str:
        return self.at("meta.json")

    def create(self, schema: Schema) -> None:
        if self.files.exists(self.meta_path):
            raise StorageError(f"{self.root} already holds an index")
        self.files.mkdirs(self.root)
        base = self._write("base", items=self.spark.createDataFrame([], schema.struct()))
        self._point(Meta(schema, base, 1), None)

    def meta(self) -> Meta:
        if not self.files.exists(self.meta_path):
            raise NotFound(f"no index at {self.root}")
        try:
            body = json.loads(self.files.read(self.meta_path))
        except ValueError as e:
            raise StorageError(f"{self.meta_path} is damaged: {e}") from e
        if body.get("magic") != MAGIC or body.get("version") != VERSION:
            raise StorageError(f"{self.root} is not an index of this version")
        return Meta.from_json(body)

    def schema(self) -> Schema:
        return self.meta().schema

    # -- reading ------------------------------------------------------------------------------------------------

    def _base(self, meta: Meta) -> DataFrame:
        return self.spark.read.schema(meta.schema.struct()).parquet(self.at(meta.base, "items"))

    def _delta(self, meta: Meta) -> DataFrame | None:
        """The rows written since the base, and with gone the paths that were deleted."""
        if meta.delta is None:
            return None
        return self.spark.read.schema(meta.schema.struct().add("gone", BooleanType())).parquet(self.at(meta.delta, "items"))

    def items(self, meta: Meta | None = None) -> DataFrame:
        meta = meta or self.meta()
        base, delta = self._base(meta), self._delta(meta)
        if delta is None:
            return base
        return base.join(delta.select("path"), "path", "left_anti").select(*meta.schema.struct().fieldNames()).unionByName(delta.filter(~F.col("gone")).drop("gone"))

    def known_values(self, meta: Meta | None = None) -> DataFrame:
        meta = meta or self.meta()
        if not meta.known:
            return self.spark.createDataFrame([], _KNOWN)
        return self.spark.read.schema(_KNOWN).parquet(*[self.at(k, "known") for k in meta.known]).distinct()

    def terms(self, meta: Meta, term: str) -> DataFrame | None:
        """(field, path) of the items that hold a term, from the inverted table; none while there are changes beside the base."""
        if not meta.terms or meta.delta is not None:
            return None
        # its bucket's folder alone is listed and read
        place = self.at(meta.base, "terms", f"bucket={bucket_of(term)}")
        if not self.files.exists(place):
            return self.spark.createDataFrame([], "field string, path string")
        return self.spark.read.schema("term string, field string, path string").parquet(place).filter(F.col("term") == term).select("field", "path")

    # -- writing ------------------------------------------------------------------------------------------------

    def lock(self) -> Lock:
        return Lock(self.files, self.at("lock"))

    def _write(self, kind: str, **frames: DataFrame) -> str:
        """A part's folder, with a folder in it for each frame; nothing is left of it if one fails."""
        name = f"{kind}-{uuid.uuid4().hex}"
        try:
            for what, rows in frames.items():
                writer = rows.write.partitionBy("bucket") if what == "terms" else rows.write
                writer.parquet(self.at(name, what))
        except Exception:
            self.files.delete(self.at(name))
            raise
        return name

    def _point(self, meta: Meta, old: Meta | None) -> Meta:
        """Swap the pointer; the parts of the state before stay for readers that still hold it, older ones go."""
        meta = replace(meta, previous=old.parts() if old else ())
        self.files.replace(self.meta_path, meta.to_json())
        keep = {*meta.parts(), *meta.previous}
        for other in self.files.names(self.root):
            if other.startswith(("base-", "delta-", "known-", "snap-")) and other not in keep:
                self.files.delete(self.at(other))
        return meta

    def publish(self, meta: Meta, items: DataFrame, sort: bool = False, terms: bool = False, **changes: Any) -> Meta:
        """A new base in place of all parts. sort: by ranges of path; terms: with the inverted table."""
        schema = changes.get("schema", meta.schema)
        if sort:
            items = items.repartitionByRange("path").sortWithinPartitions("path")
        base = self._write("base", items=items)
        written = self.spark.read.schema(schema.struct()).parquet(self.at(base, "items"))
        totals = written.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        if terms:
            inverted(written, schema).write.partitionBy("bucket").parquet(self.at(base, "terms"))
        known = meta.known
        if len(known) > 1:
            known = (self._write("known", known=self.known_values(meta)),)
        changes = {k: v for k, v in changes.items() if k not in ("rows", "length")}
        new = replace(meta, base=base, delta=None, delta_rows=0, rows=totals["rows"], length=totals["length"], terms=terms, known=known)
        return self._point(replace(new, **changes), meta)

    def publish_changes(self, meta: Meta, changed: DataFrame, known: DataFrame | None, count: int, **changes: Any) -> Meta:
        """Changed rows (gone for deleted paths) on top of the parts that stand, or merged with them into a new base.

        changed has every path at most once; count: how many, about.
        """
        seen = (*meta.known, *([self._write("known", known=known)] if known is not None else []))
        if len(seen) > KNOWN_PARTS:
            seen = (self._write("known", known=self.known_values(replace(meta, known=seen))),)
        old = self._delta(meta)
        names = changed.columns
        if old is not None:
            changed = old.join(changed.select("path"), "path", "left_anti").select(*names).unionByName(changed)
        total = count + meta.delta_rows
        merged = replace(meta, known=seen)
        if total > max(MERGE_ROWS, MERGE_SHARE * meta.rows):
            base = self._base(meta)
            live = changed.filter(~F.col("gone")).drop("gone")
            if meta.rows:
                live = base.join(changed.select("path"), "path", "left_anti").select(*live.columns).unionByName(live)
            return self.publish(merged, live, **changes)
        delta = self._write("delta", items=changed)
        return self._point(replace(merged, delta=delta, delta_rows=total, **changes), meta)

    def know(self, meta: Meta, values: DataFrame) -> Meta:
        """More known values, beside the same items."""
        return self._point(replace(meta, known=(*meta.known, self._write("known", known=values))), meta)

    def drop(self) -> None:
        self.meta()
        self.files.delete(self.root)


def bucket_of(term: str) -> int:
    """The same as inverted() gives a term's rows, on the driver."""
    return zlib.crc32(term.encode("utf-8")) % BUCKETS


def inverted(items: DataFrame, schema: Schema) -> DataFrame:
    """(term, field, path, bucket), sorted by term within a bucket: one row per distinct term, field and item."""
    parts = [
        items.select(F.explode(F.array_distinct(F.col(schema.tokens(n)))).alias("term"), F.lit(n).alias("field"), "path")
        for n, _ in schema.text_fields
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int"))
    # a widespread term is spread over the tasks of its bucket by path
    return rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8))).sortWithinPartitions("bucket", "term", "path")


class Lock:
    """A file that names its owner. One whose owner has died on this host, or that is older than LOCK_MS, is given up."""

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, path
        self.token = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex, "at": int(time.time() * 1000)})

    def _dead(self, held: str) -> bool:
        try:
            owner = json.loads(held)
            if int(time.time() * 1000) - owner["at"] > LOCK_MS:
                return True
            if owner["host"] != socket.gethostname():
                return False
            os.kill(owner["pid"], 0)
            return False
        except ProcessLookupError:
            return True
        except (ValueError, KeyError, TypeError, PermissionError):
            return False

    def __enter__(self) -> None:
        if self.files.write(self.path, self.token, overwrite=False):
            return
        held = self.files.read(self.path)
        if self._dead(held):
            self.files.delete(self.path)
            if self.files.write(self.path, self.token, overwrite=False):
                return
        raise StorageError(f"another writer holds {self.path}: {held}")

    def __exit__(self, *_: object) -> None:
        if self.files.exists(self.path) and self.files.read(self.path) == self.token:
            self.files.delete(self.path)


def is_index(files: Files, path: str) -> bool:
    try:
        return files.exists(f"{path}/meta.json") and json.loads(files.read(f"{path}/meta.json")).get("magic") == MAGIC
    except (ValueError, AttributeError):
        return False


def list_indexes(spark: SparkSession, folder: str = ".") -> list[str]:
    files, folder = Files(spark), absolute(folder)
    return [n for n in files.names(folder) if files.is_folder(f"{folder}/{n}") and is_index(files, f"{folder}/{n}")]


def resolve(name: str, folder: str = ".") -> str:
    """A name with a separator or ending in .idx is a path; any other is folder/<name>.idx."""
    return name if "/" in name or os.sep in name or name.endswith(".idx") else os.path.join(folder, f"{name}.idx")
