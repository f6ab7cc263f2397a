"""The handle of an index: search, counts, facets, statistics, writes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.errors import CursorError, FeatureMissing, InvalidArgument, JsonError, NotFound, TypeMismatch
from loamdex.functions import text
from loamdex.operators import cursors, facets, mutation
from loamdex.operators.ingest import typed
from loamdex.operators.output import Page
from loamdex.operators.ranking import Order, Rank, order_of
from loamdex.plans.binder import Binder, Bound
from loamdex.plans.guard import guard
from loamdex.plans.parser import parse
from loamdex.schema import Schema
from loamdex.sources import jsonl
from loamdex.sources.shared import new_path
from loamdex.sources.store import Meta, Store

#: Items that the inverted table may name for a field; beyond, the items are scanned. And how many terms' answers are kept.
NAMED, ASKED = 1000, 64


@dataclass
class SearchOptions:
    """show: none (paths), all, or names. cursor_mode: full or short."""

    rank: str | Rank = "default"
    limit: int = 20
    after: str | None = None
    show: str | list[str] = "none"
    explain: bool = False
    cursor_mode: str = "full"
    compat_trailing: bool = False


@dataclass
class Batch:
    """Puts and deletes in order. A put that can't be read poisons the batch, even if its error is caught."""

    ops: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    broken: bool = False

    def put(self, doc: dict[str, Any] | str) -> None:
        try:
            body = json.loads(doc) if isinstance(doc, str) else doc
            path = body["path"]
            if not isinstance(path, str) or not path:
                raise ValueError("path")
        except (ValueError, KeyError, TypeError) as e:
            self.broken = True
            raise JsonError(f"a document is a JSON object with a non-empty path: {e}") from e
        self.ops.append(("put", path, doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)))

    def delete(self, path: str) -> None:
        self.ops.append(("delete", path, None))


class Index:
    """Items as one DataFrame. With a store, writes publish a new snapshot; without one, the index only reads."""

    def __init__(self, spark: SparkSession, schema: Schema, items: DataFrame, store: Store | None = None, now_ms: Callable[[], int] | None = None):
        self.spark, self.schema, self._items, self.store = spark, schema, items, store
        self.now_ms = now_ms or (lambda: int(time.time() * 1000))
        self._meta: Meta | None = None
        self._asked: dict[tuple[str, str], dict[str, set[str]] | None] = {}
        self.short = cursors.ShortCursors(store.files if store else None, store.at("cursors.json") if store else None)

    # -- making and opening -------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: Schema, now_ms: Callable[[], int] | None = None) -> Index:
        Store(spark, root).create(schema)
        return cls.open(spark, root, now_ms)

    @classmethod
    def open(cls, spark: SparkSession, root: str, now_ms: Callable[[], int] | None = None) -> Index:
        store = Store(spark, root)
        meta = store.meta()
        out = cls(spark, meta.schema, store.items(meta), store, now_ms)
        out._meta = meta
        return out

    def saved(self, root: str, terms: bool = True) -> Index:
        """The same items stored at root, by path and with the inverted text table if asked for."""
        made = Index.create(self.spark, root, self.schema, self.now_ms)
        with made.store.lock():
            top = self.items.agg(F.coalesce(F.max("item_id"), F.lit(0))).first()[0]
            made._now(made.store.publish(made._meta, self.items.select(*self.schema.struct().fieldNames()), sort=True, terms=terms and bool(self.schema.text_fields), next_id=top + 1))
            values = made._values(made.items)
            if values is not None:
                made._now(made.store.know(made._meta, values))
        return made

    @classmethod
    def from_typed(cls, rows: DataFrame, schema: Schema, now_ms: Callable[[], int] | None = None) -> Index:
        """An index over columns that exist: item_id, path, created_at, updated_at, and the schema's fields by name."""
        columns = {"data_json": F.col("data_json").cast("string") if "data_json" in rows.columns else F.lit(None).cast("string")}
        out = rows.select(
            F.col("item_id").cast("long").alias("item_id"), "path", columns["data_json"].alias("data_json"), F.col("created_at").cast("long").alias("created_at"), F.col("updated_at").cast("long").alias("updated_at"),
            *[F.col(n).cast(f.spark_type).alias(Schema.column(n)) for n, f in schema.fields.items()],
        )
        out = out.withColumns({Schema.tokens(n): text.tokens(F.col(Schema.column(n))) for n, _ in schema.text_fields}).withColumn("length", text.length(schema))
        return cls(rows.sparkSession, schema, out, None, now_ms)

    @classmethod
    def from_dataframe(cls, df: DataFrame, schema: Schema, path: str = "path", now_ms: Callable[[], int] | None = None) -> Index:
        """An index over a DataFrame whose columns are taken as documents; rows that don't fit the schema are refused when read."""
        rows = typed(jsonl.from_dataframe(df, path), schema)
        now = (now_ms or (lambda: int(time.time() * 1000)))()
        checked = rows.withColumn("path", F.when(F.size("errors") == 0, F.col("path")).otherwise(F.raise_error(F.array_join("errors", "; ")).cast("string")))
        out = checked.withColumns({"item_id": F.col("seq"), "created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long")})
        return cls(df.sparkSession, schema, out.select(*schema.struct().fieldNames()), None, now_ms)

    @property
    def items(self) -> DataFrame:
        return self._items

    # -- queries ------------------------------------------------------------------------------------------------

    def bind(self, query: str, compat_trailing: bool = False) -> Bound:
        return Binder(self.schema, self.now_ms()).bind(guard(parse(query, compat_trailing)))

    def matching(self, query: str) -> DataFrame:
        """The items that a query matches."""
        bound = self.bind(query)
        return self._named(bound).filter(bound.test)

    def _postings(self, term: str) -> dict[str, set[str]] | None:
        """Paths by field of the items that hold a term; none where the inverted table can't be asked, or names too many."""
        rows = self.store.terms(self._meta, term) if self._meta is not None else None
        if rows is None:
            return None
        key = (self._meta.base, term)
        if key not in self._asked:
            limit = NAMED * len(self.schema.text_fields)
            found = rows.limit(limit + 1).collect()
            by_field = {name: {r["path"] for r in found if r["field"] == name} for name, _ in self.schema.text_fields}
            while len(self._asked) >= ASKED:
                self._asked.pop(next(iter(self._asked)))
            self._asked[key] = by_field if len(found) <= limit else None
        return self._asked[key]

    def _named(self, bound: Bound) -> DataFrame:
        """The items, or the few that the inverted table names for a term that every match holds, which the scan then prunes by path."""
        for fields, tokens in bound.required:
            for token in tokens:
                if (found := self._postings(token)) is not None:
                    paths = set().union(*(found[f] for f in fields))
                    return self.items.filter(F.col("path").isin(*paths)) if paths else self.items.limit(0)
        return self.items

    def _holding(self, phrase: tuple[str, ...], fields: list[str]) -> int | None:
        """Rows that hold a term in any of the fields, where the inverted table tells."""
        found = self._postings(phrase[0]) if len(phrase) == 1 else None
        if found is not None:
            return len(set().union(*(found[f] for f in fields)))
        rows = self.store.terms(self._meta, phrase[0]) if self._meta is not None and len(phrase) == 1 else None
        return None if rows is None else rows.filter(F.col("field").isin(*fields)).select("path").distinct().count()

    def ranked(self, query: str, rank: str | Rank = "default", after: dict[str, Any] | None = None, limit: int | None = None) -> DataFrame:
        """Matching items with their score, in order, lazily."""
        return self._ranked(self.bind(query), Rank.of(rank), after, limit)[0]

    def _ranked(self, bound: Bound, rank: Rank, after: dict[str, Any] | None, limit: int | None) -> tuple[DataFrame, Order]:
        totals = {"known": (self._meta.rows, self._meta.length), "held": self._holding} if self._meta is not None else {}
        order, _ = order_of(rank, self.schema, bound, self.items, **totals)
        _, items = order_of(Rank("none") if order.kind == "fts" else rank, self.schema, bound, self._named(bound))
        rows = items.filter(bound.test).withColumn("score", order.score)
        if after is not None:
            rows = rows.filter(order.after(after))
        rows = rows.orderBy(*order.sort)
        return (rows if limit is None else rows.limit(limit)), order

    def _position(self, query: str, rank: Rank, token: str | None) -> tuple[str, dict[str, Any] | None]:
        """What cursors of this search are bound to, and the position of one of them."""
        digest = cursors.query_hash(self.schema.to_json(), query, rank)
        if token is None:
            return digest, None
        position = self.short.get(token, self.now_ms()) if token.startswith("c:") else cursors.decode(token)
        if position["hash"] != digest:
            raise CursorError("the cursor belongs to another query, rank or schema")
        return digest, position["payload"]

    def pages(self, query: str, options: SearchOptions | None = None) -> DataFrame:
        """All pages from options.after on in one pass: page and place (from 0), item_id, path, score, and on the last row of a page that another follows its next_cursor.

        They are the pages that search gives one by one. Rows are sorted in ranges and numbered by the sizes of the ranges
        before them, so none is brought to the driver or to one task. Cursors are full ones; documents are not shown.
        """
        options = options or SearchOptions()
        if options.limit < 1:
            raise InvalidArgument("pages hold one item or more")
        rank = Rank.of(options.rank)
        digest, after = self._position(query, rank, options.after)
        rows, order = self._ranked(self.bind(query, options.compat_trailing), rank, after, None)
        path = new_path(self.spark, "pages")
        rows.select("item_id", "path", "score", cursors.encoded(order.payload_column(), digest).alias("cursor")).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
        found = self.spark.read.parquet(path)
        part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        # a row for each range
        starts, total = {}, 0
        for p, n in sorted(found.groupBy(part.alias("p")).count().collect()):
            starts[p], total = total, total + n
        start = F.get(F.lit([starts.get(p, 0) for p in range(max(starts, default=0) + 1)]), part.cast("int")).cast("long")
        numbered = found.withColumn("n", start + within)
        last = (F.pmod("n", F.lit(options.limit)) == options.limit - 1) & (F.col("n") < total - 1)
        return numbered.select(
            F.floor(F.col("n") / options.limit).cast("long").alias("page"), F.pmod("n", F.lit(options.limit)).cast("long").alias("place"), "item_id", "path", "score", F.when(last, F.col("cursor")).alias("next_cursor"),
        )

    def search(self, query: str, options: SearchOptions | None = None) -> Page:
        options = options or SearchOptions()
        if options.cursor_mode not in ("full", "short"):
            raise InvalidArgument(f"unknown cursor mode {options.cursor_mode!r}")
        rank = Rank.of(options.rank)
        digest, after = self._position(query, rank, options.after)
        bound = self.bind(query, options.compat_trailing)
        rows, order = self._ranked(bound, rank, after, options.limit + 1)
        columns = ["item_id", "path", "updated_at", "score"] + ([] if options.show == "none" else ["data_json"])
        # the page, and one row more to know whether it goes on
        found = rows.select(*columns).collect()
        page = Page([self._shaped(r, options.show) for r in found[: options.limit]], has_more=len(found) > options.limit)
        if page.has_more and options.limit > 0:
            payload = order.payload(found[options.limit - 1])
            page.next_cursor = cursors.encode(payload, digest) if options.cursor_mode == "full" else self.short.put({"payload": payload, "hash": digest}, self.now_ms())
        if options.explain:
            page.explain_steps = bound.steps
            page.explain_plan = rows._jdf.queryExecution().toString()
        return page

    @staticmethod
    def _shaped(row: Any, show: str | list[str]) -> dict[str, Any]:
        if show == "none":
            return {"path": row["path"]}
        doc = json.loads(row["data_json"] or "{}")
        if show == "all":
            return doc | {"path": row["path"]}
        names = [show] if isinstance(show, str) else show
        return {"path": row["path"]} | {n: doc[n] for n in names if n in doc}

    def count(self, query: str) -> int:
        return self.matching(query).count()

    def get(self, path: str) -> dict[str, Any]:
        """The document and its times."""
        row = self.items.filter(F.col("path") == path).select("data_json", "created_at", "updated_at").first()
        if row is None:
            raise NotFound(path)
        return {"doc": json.loads(row["data_json"]), "created_at": row["created_at"], "updated_at": row["updated_at"]}

    def peek(self, path: str) -> dict[str, Any]:
        return self.get(path)["doc"]

    def scan_paths(self, prefix: str) -> Iterator[str]:
        """Paths with this very prefix, in byte order, streamed."""
        rows = self.items.filter(F.startswith(F.col("path"), F.lit(prefix))).select("path").orderBy("path")
        for row in rows.toLocalIterator():
            yield row["path"]

    def discover_values(self, name: str, where: str = "", top: int | None = 100) -> DataFrame:
        if where.strip():
            self._keyword(name)
            return facets.facet(self.matching(where), self.schema, name, top)
        return facets.facet(self.items, self.schema, name, top, self.store.known_values() if self.store else None)

    def _keyword(self, name: str) -> None:
        found = self.schema.get(name)
        if found is not None and found.kind != "keyword":
            raise TypeMismatch(f"{name} is a {found.kind} field, not a keyword")

    def discover_fields(self) -> DataFrame:
        return facets.overview(self.items, self.schema)

    def stats(self, name: str, where: str = "", median: bool = False) -> DataFrame:
        scoped = bool(where.strip())
        return facets.stats(self.matching(where) if scoped else self.items, self.schema, name, scoped, median)

    # -- writes -------------------------------------------------------------------------------------------------

    def _stored(self) -> Store:
        if self.store is None:
            raise FeatureMissing("this index has no store to write to")
        return self.store

    def _now(self, meta: Meta) -> None:
        self._meta, self.schema, self._items = meta, meta.schema, self._stored().items(meta)

    def _values(self, rows: DataFrame) -> DataFrame | None:
        """(field, value) of keyword fields that were not known before."""
        known = None
        for name, f in self.schema.fields.items():
            if f.kind == "keyword":
                value = F.explode(F.col(Schema.column(name))) if f.is_array else F.col(Schema.column(name))
                part = rows.select(F.lit(name).alias("field"), value.alias("value")).filter("value IS NOT NULL")
                known = part if known is None else known.unionByName(part)
        return None if known is None else known.distinct().join(self._stored().known_values(), ["field", "value"], "left_anti")

    def write_ops(self, ops: DataFrame, now_ms: int | None = None, stream: tuple[str, int] | None = None) -> int:
        """Apply ordered operations (seq, op put or delete, path, data_json) as one batch; how many took effect.

        stream: a stream's name and the number of its batch; one that was applied before changes nothing.
        """
        store = self._stored()
        with store.lock():
            meta = store.meta()
            if stream is not None and meta.streams.get(stream[0], -1) >= stream[1]:
                return 0
            now = self.now_ms() if now_ms is None else now_ms
            for c in ("created_at", "updated_at"):
                if c not in ops.columns:
                    ops = ops.withColumn(c, F.lit(None).cast("long"))
            # read and typed once: for the errors, the counts, the changes and the known values
            rows = mutation.typed_ops(ops, meta.schema).persist()
            changed = rows
            try:
                wrong = F.when(F.size("errors") > 0, F.struct("seq", "errors"))
                told = rows.agg(F.min(wrong).alias("bad"), F.count(F.when(F.col("op") == "put", 1)).alias("puts"), F.count(F.when(F.col("op") == "delete", 1)).alias("deletes")).first()
                if told["bad"] is not None:
                    raise TypeMismatch(f"document {told['bad']['seq']}: {'; '.join(told['bad']['errors'])}")
                items = store.items(meta)
                hits = self._deletes_that_hit(rows, items) if told["deletes"] else 0
                changed = mutation.changes(items, rows, meta.schema, now, meta.next_id).persist()
                live = ~F.col("gone")
                sums = changed.agg(
                    F.count(F.lit(1)).alias("n"), (F.count(F.when(live, 1)) - F.count(F.when(F.col("was"), 1))).alias("rows"),
                    (F.coalesce(F.sum(F.when(live, F.col("length"))), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("was"), F.col("old_length"))), F.lit(0))).alias("length"),
                ).first()
                streams = meta.streams | ({stream[0]: stream[1]} if stream else {})
                known = self._values(rows) if told["puts"] else None
                self._now(store.publish_changes(
                    meta, changed.drop("was", "old_length"), known, sums["n"], next_id=meta.next_id + told["puts"], rows=meta.rows + sums["rows"], length=meta.length + sums["length"], streams=streams
                ))
            finally:
                rows.unpersist()
                changed.unpersist()
        return told["puts"] + hits

    @staticmethod
    def _deletes_that_hit(ops: DataFrame, items: DataFrame) -> int:
        """A delete counts if its path is there: stored before, or put earlier in the batch and not deleted since."""
        steps = ops.select("path", "seq", "op").withColumn("prev", F.lag("op").over(Window.partitionBy("path").orderBy("seq")))
        stored = items.select("path", F.lit(True).alias("stored"))
        return steps.filter("op = 'delete'").join(stored, "path", "left").filter("prev = 'put' OR (prev IS NULL AND stored)").count()

    def write_batch(self, fill: Callable[[Batch], Any]) -> int:
        batch = Batch()
        fill(batch)
        if batch.broken:
            raise JsonError("the batch holds a document that could not be read; nothing was written")
        return self.batch(batch)

    def batch(self, batch: Batch) -> int:
        if not batch.ops:
            return 0
        rows = [(i, op, path, doc) for i, (op, path, doc) in enumerate(batch.ops)]
        return self.write_ops(self.spark.createDataFrame(rows, "seq long, op string, path string, data_json string"))

    def put_json(self, doc: dict[str, Any] | str) -> None:
        self.write_batch(lambda b: b.put(doc))

    def put_fields(self, path: str, fields: dict[str, Any]) -> None:
        self.put_json(fields | {"path": path})

    def put_lines(self, lines: Iterable[str]) -> int:
        batch = Batch()
        for line in lines:
            if line.strip():
                batch.put(line)
        return self.batch(batch)

    def import_jsonl(self, path: str) -> int:
        """All lines of a file or folder as one batch, read and typed on the executors."""
        return self.put_dataframe(jsonl.read_jsonl(self.spark, path))

    def put_dataframe(self, docs: DataFrame) -> int:
        """docs: seq, data_json."""
        path = F.try_variant_get(F.try_parse_json("data_json"), "$.path", "string")
        return self.write_ops(docs.select("seq", F.lit("put").alias("op"), path.alias("path"), "data_json"))

    def delete(self, path: str) -> bool:
        return self.write_batch(lambda b: b.delete(path)) > 0

    def delete_where(self, query: str) -> int:
        """Delete what a query matches; how many items went."""
        store = self._stored()
        bound = self.bind(query)
        with store.lock():
            meta = store.meta()
            rows = store.items(meta).filter(bound.test)
            found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
            if found["n"]:
                gone = rows.select(*[F.col(c) if c in ("item_id", "path") else F.lit(None).cast(t).alias(c) for c, t in ((x.name, x.dataType) for x in meta.schema.struct())], F.lit(True).alias("gone"))
                self._now(store.publish_changes(meta, gone, None, found["n"], rows=meta.rows - found["n"], length=meta.length - found["length"]))
        return found["n"]

    delete_query = delete_where

    def optimize(self) -> None:
        """One base in ranges of paths, with the inverted text table, of all that stands; nothing to do without text fields."""
        if not self.schema.text_fields:
            return
        store = self._stored()
        with store.lock():
            meta = store.meta()
            self._now(store.publish(meta, store.items(meta), sort=True, terms=True))

    def apply_schema(self, new: Schema) -> list[str]:
        """Add fields; their values come from the stored documents."""
        added = self.schema.check_additive(new)
        self._retype(new)
        return added

    def migrate_rebuild(self, root: str, new: Schema) -> Index:
        """Every document under another schema in a new index, ids in the old order and times as they were."""
        target = Index.create(self.spark, root, new, self.now_ms)
        ops = self.items.select(F.col("item_id").alias("seq"), F.lit("put").alias("op"), "path", "data_json", "created_at", "updated_at")
        target.write_ops(ops)
        return target

    def _retype(self, new: Schema) -> None:
        store = self._stored()
        with store.lock():
            meta = store.meta()
            rows = typed(store.items(meta).select("item_id", "data_json", "created_at", "updated_at"), new)
            if (bad := rows.filter(F.size("errors") > 0).select("errors").first()) is not None:
                raise TypeMismatch("; ".join(bad["errors"]))
            meta = store.publish(meta, rows.select(*new.struct().fieldNames()), schema=new)
            # values of the fields that were added are known from now on
            self.schema = new
            values = self._values(store.items(meta))
            self._now(meta if values is None else store.know(meta, values))
