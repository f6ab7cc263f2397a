"""Command line: python -m loamdex.cli VERB ... over indexes of the current folder."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from loamdex.errors import InvalidArgument, LoamdexError
from loamdex.index import Index, SearchOptions
from loamdex.operators.output import render
from loamdex.schema import Schema
from loamdex.sources.files import Files, absolute
from loamdex.sources.store import list_indexes, resolve


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loamdex")
    verbs = top.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index").add_subparsers(dest="action", required=True)
    create = index.add_parser("create")
    create.add_argument("name")
    create.add_argument("--field", action="append", default=[], help="name:type[:multi]")
    create.add_argument("--schema", help="a JSON file")
    index.add_parser("list")
    for name in ("schema", "optimize", "stats", "drop", "apply-schema", "migrate"):
        sub = index.add_parser(name)
        sub.add_argument("name")
        if name in ("apply-schema", "migrate"):
            sub.add_argument("--schema", required=True)
        if name == "migrate":
            sub.add_argument("--to", required=True)
    put = verbs.add_parser("put")
    put.add_argument("name")
    put.add_argument("path", nargs="?")
    put.add_argument("--set", action="append", default=[], help="field=value; the value stays one string unless it is a number or a bool")
    put.add_argument("--import", dest="source", help="a file of JSON lines, or - for standard input")
    for verb in ("get", "peek"):
        sub = verbs.add_parser(verb)
        sub.add_argument("name")
        sub.add_argument("path")
    delete = verbs.add_parser("delete")
    delete.add_argument("name")
    delete.add_argument("path", nargs="?")
    delete.add_argument("--where")
    search = verbs.add_parser("search")
    search.add_argument("name")
    search.add_argument("query")
    search.add_argument("--rank", default="default")
    search.add_argument("--limit", type=int, default=20)
    search.add_argument("--after")
    search.add_argument("--show", default="none", help="none, all, or names with commas")
    search.add_argument("--format", default="pretty")
    search.add_argument("--cursor", default="short", choices=("short", "full"))
    search.add_argument("--explain", action="store_true")
    discover = verbs.add_parser("discover").add_subparsers(dest="action", required=True)
    values = discover.add_parser("values")
    values.add_argument("name")
    values.add_argument("field")
    values.add_argument("--where", default="")
    values.add_argument("--top", type=int, default=100)
    discover.add_parser("fields").add_argument("name")
    stats = verbs.add_parser("stats")
    stats.add_argument("name")
    stats.add_argument("field")
    stats.add_argument("--where", default="")
    stats.add_argument("--median", action="store_true")
    okf = verbs.add_parser("okf").add_subparsers(dest="action", required=True)
    validate = okf.add_parser("validate")
    validate.add_argument("root")
    syncing = okf.add_parser("sync")
    syncing.add_argument("root")
    syncing.add_argument("name")
    syncing.add_argument("--strict", action="store_true")
    syncing.add_argument("--dry-run", action="store_true")
    for sub in (validate, syncing):
        sub.add_argument("--target-version")
        sub.add_argument("--format", default="pretty", choices=("pretty", "json"))
    return top


def _schema(file: str) -> Schema:
    with open(file, encoding="utf-8") as f:
        return Schema.from_json(f.read())


def run(spark: SparkSession, argv: list[str], folder: str = ".") -> tuple[int, str]:
    """(exit code, output) of one command."""
    args = parser().parse_args(argv)
    try:
        return _run(spark, args, folder)
    except (LoamdexError, OSError, ValueError) as e:
        return 1, f"error: {type(e).__name__}: {e}\n"


def _json(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def _run(spark: SparkSession, args: argparse.Namespace, folder: str) -> tuple[int, str]:
    where = resolve(args.name, folder) if hasattr(args, "name") else ""
    if args.verb == "okf":
        return _okf(spark, args, where)
    if args.verb == "index" and args.action == "list":
        return 0, "".join(f"{n}\n" for n in list_indexes(spark, folder))
    if args.verb == "index" and args.action == "create":
        Index.create(spark, where, _schema(args.schema) if args.schema else Schema.from_spec(args.field))
        return 0, f"created {where}\n"
    index = Index.open(spark, where)
    if args.verb == "index":
        return 0, _manage(index, args)
    if args.verb == "put":
        if args.source:
            n = index.put_lines(sys.stdin) if args.source == "-" else index.import_jsonl(args.source)
            return 0, f"wrote {n} documents\n"
        if not args.path:
            raise InvalidArgument("a path, or --import")
        # values stay strings, which the schema converts; a key without one is true
        index.put_fields(args.path, {k: v if given else True for k, given, v in (s.partition("=") for s in args.set)})
        return 0, f"wrote {args.path}\n"
    if args.verb in ("get", "peek"):
        return 0, _json(index.peek(args.path))
    if args.verb == "delete":
        if args.path:
            return 0, f"deleted {int(index.delete(args.path))}\n"
        return 0, f"deleted {index.delete_where(args.where)}\n" if args.where else "give a path or --where\n"
    if args.verb == "search":
        start = time.time()
        show = args.show if args.show in ("none", "all") else args.show.split(",")
        page = index.search(args.query, SearchOptions(args.rank, args.limit, args.after, show, args.explain, args.cursor))
        return 0, render(page, args.format, int((time.time() - start) * 1000))
    if args.verb == "discover":
        rows = index.discover_fields() if args.action == "fields" else index.discover_values(args.field, args.where, args.top)
        return 0, "".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in rows.collect())
    return 0, _json({k: v for k, v in index.stats(args.field, args.where, args.median).first().asDict().items() if v is not None})


def _manage(index: Index, args: argparse.Namespace) -> str:
    if args.action == "schema":
        return index.schema.to_json() + "\n"
    if args.action == "stats":
        return _json({"items": index.items.count(), "bytes": index.store.files.bytes(index.store.root), "fields": len(index.schema.fields)})
    if args.action == "drop":
        index.store.drop()
        return "dropped\n"
    if args.action == "apply-schema":
        return f"added {', '.join(index.apply_schema(_schema(args.schema))) or 'nothing'}\n"
    if args.action == "migrate":
        index.migrate_rebuild(resolve(args.to, os.path.dirname(index.store.root)), _schema(args.schema))
        return "rebuilt\n"
    index.optimize()
    return "optimized\n"


def _okf(spark: SparkSession, args: argparse.Namespace, where: str) -> tuple[int, str]:
    from loamdex.okf import bundle

    if args.action == "validate":
        found = bundle.read_bundle(spark, args.root, args.target_version)
        total = bundle.summary(found)
        rows = [r.asDict() for r in found.findings.collect()]
        code = 1 if total["errors"] else 0
        if args.format == "json":
            return code, _json({"summary": total, "findings": rows})
        lines = [f"{r['severity']} {r['code']} {r['path']}:{r['line'] or 0}:{r['column'] or 0} {r['message']}" for r in rows]
        return code, "\n".join([*lines, f"{total['concepts']} concepts, {total['errors']} errors, {total['warnings']} warnings"]) + "\n"
    temporary = not Files(spark).exists(absolute(where))
    if temporary and args.dry_run:
        empty = spark.createDataFrame([], bundle.PROJECTION.struct())
        index = Index(spark, bundle.PROJECTION, empty)
    else:
        index = Index.create(spark, where, bundle.PROJECTION) if temporary else Index.open(spark, where)
    report = bundle.sync(spark, args.root, index, args.target_version, args.strict, args.dry_run)
    text = _json(report) if args.format == "json" else "".join(f"{k}: {report[k]}\n" for k in ("ok", "concepts", "added", "updated", "unchanged", "deleted"))
    return (0 if report["ok"] else 1), text


def main() -> int:
    spark = SparkSession.builder.appName("loamdex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    code, text = run(spark, sys.argv[1:])
    sys.stdout.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
