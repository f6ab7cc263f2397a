"""Every registered query against its SQL, random queries against a plain interpreter, and plans."""

import os
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from loamdex.functions.patterns import glob_regex
from loamdex.index import Index
from loamdex.plans import ast, catalogue
from loamdex.plans.binder import Binder
from loamdex.schema import Schema
from loamdex.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted("|".join("NULL" if v is None or v != v else repr(round(v, 5)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_as_sql(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(rows.columns) == columns
    assert plain(map(tuple, rows.select(*[f"`{c}`" for c in columns]).collect())) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "item_id", "updated_at"]
    assert set(catalogue.oracle_sql()) == set(catalogue.queries()) <= set(entry.queries())


SCHEMA = Schema.from_spec("k:keyword,m:keyword:multi,n:number,x:number:multi,d:date,b:bool,t:text")
WORDS = ["alpha", "Beta", "gam_ma", "a%b", "x\\y", "été", "AB", "ab"]
ROWS = [
    dict(item_id=i, path=f"/p{i % 3}/{WORDS[i % 8]}", created_at=i * 1000, updated_at=i * 500, k=None if i % 5 == 0 else WORDS[i % 8], m=None if i % 4 == 0 else [WORDS[i % 8], WORDS[(i + 3) % 8]],
         n=None if i % 3 == 0 else float(i % 7), x=None if i % 6 == 0 else [float(i % 4), float(i % 9)], d=None if i % 7 == 0 else i * 86_400_000, b=[True, False, None][i % 3], t=None if i % 9 == 0 else f"{WORDS[i % 8]} and {WORDS[(i + 1) % 8]}")
    for i in range(40)
]


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def like(value, pattern):
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(pattern))
    return re.fullmatch(body, fold(value), re.S) is not None


def glob(value, pattern):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), value, re.S) is not None


COMPARE = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def holds(node, row):
    """The query language over one dict, written without Spark."""
    many = lambda f: row[f] if isinstance(row[f], list) else [] if row[f] is None else [row[f]]
    match node:
        case ast.And(left, right):
            return holds(left, row) and holds(right, row)
        case ast.Or(left, right):
            return holds(left, row) or holds(right, row)
        case ast.Not(inner):
            return not holds(inner, row)
        case ast.Has(f):
            return bool(many(f))
        case ast.Path(p):
            return like(row["path"], p[:-1] + "%") if p.count("*") == 1 and p.endswith("*") and "?" not in p else glob(row["path"], p)
        case ast.Keyword(f, p, shape):
            test = {"exact": lambda v: v == p, "prefix": lambda v: like(v, p[:-1] + "%"), "contains": lambda v: like(v, f"%{p[1:-1]}%"), "glob": lambda v: glob(v, p)}[shape]
            return any(map(test, many(f)))
        case ast.Number(f, op, value):
            return any(COMPARE[op](v, value) for v in many(f))
        case ast.NumberRange(f, low, high):
            return any(low <= v <= high for v in many(f))
        case ast.Date(f, op, ms):
            return any(COMPARE[op](v, ms) for v in ([row[f"{f}_at"]] if f == "created" else many(f)))
        case ast.Bool(f, value):
            return row[f] is value
        case ast.Text(_, term):
            words = lambda s: re.findall(r"[^\W_]+", s.lower().replace("é", "e"))
            have, want = words(row["t"] or ""), words(term)
            return bool(want) and any(have[i : i + len(want)] == want for i in range(len(have)))


LEAVES = st.one_of(
    st.builds(ast.Has, st.sampled_from("kmnxdbt")),
    st.builds(ast.Path, st.sampled_from(["/p1/*", "/P2/*", "/p?/a*", "/p0/alpha", "/p*/ab"])),
    st.builds(lambda f, w: ast.Keyword(f, w, "exact"), st.sampled_from("km"), st.sampled_from(WORDS)),
    st.builds(lambda f, w: ast.Keyword(f, w + "*", "prefix"), st.sampled_from("km"), st.sampled_from(["al", "BE", "a%", "x\\", "a_", "ét"])),
    st.builds(lambda f, w: ast.Keyword(f, f"*{w}*", "contains"), st.sampled_from("km"), st.sampled_from(["eta", "m_m", "%b", "\\y"])),
    st.builds(lambda f, w: ast.Keyword(f, w, "glob"), st.sampled_from("km"), st.sampled_from(["a?pha", "?b", "Be*a", "gam*"])),
    st.builds(ast.Number, st.sampled_from("nx"), st.sampled_from(sorted(COMPARE)), st.integers(0, 8).map(float)),
    st.builds(ast.NumberRange, st.sampled_from("nx"), st.integers(0, 8).map(float), st.integers(0, 8).map(float)),
    st.builds(ast.Date, st.sampled_from(["d", "created"]), st.sampled_from(sorted(COMPARE)), st.integers(0, 40).map(lambda d: d * 86_400_000)),
    st.builds(ast.Bool, st.just("b"), st.booleans()),
    st.builds(ast.Text, st.none(), st.sampled_from(["alpha", "and beta", "Été", "gam ma", "!!!", "ab and"])),
)
TREES = st.recursive(LEAVES, lambda inner: st.builds(ast.And, inner, inner) | st.builds(ast.Or, inner, inner) | st.builds(ast.Not, inner), max_leaves=8)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(trees=st.lists(TREES, min_size=8, max_size=8))
def test_random_queries(spark, trees):
    types = "item_id long, path string, created_at long, updated_at long, k string, m array<string>, n double, x array<double>, d long, b boolean, t string"
    items = Index.from_typed(spark.createDataFrame(ROWS, types), SCHEMA).items
    conditions = [Binder(SCHEMA, 0).bind(t).condition.alias(f"c{i}") for i, t in enumerate(trees)]
    got = {r.item_id: list(r)[1:] for r in items.select("item_id", *conditions).collect()}
    for row in ROWS:
        assert got[row["item_id"]] == [holds(t, row) for t in trees], (row, trees)


def test_plans_prune_and_push(spark):
    index = tables.docs(spark, SF)
    plan = index.matching("lang:fr AND n_chars>1000").select("path")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "documents.parquet" in line)
    assert "EqualTo(lang,fr)" in scan and "text" not in re.search(r"ReadSchema: (.*)", scan)[1]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    top = index.ranked("lang:fr", "recency", None, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("a[b-d]e", ["abe", "ade"], ["aae", "a[e"]), ("[^x]*", ["a", "\n"], ["x", ""]), ("[]a]", ["]", "a"], ["b"]), ("a[", [], ["a["]), ("*.md", ["x.md", "/a/b.md"], ["xmd"]), ("?", ["é", "\n"], ["", "ab"]), ("[d-b]", [], ["c"])],
)
def test_globs(spark, pattern, yes, no):
    rows = spark.createDataFrame([(s,) for s in yes + no] or [("",)], "s string")
    got = {r.s for r in rows.filter(rows["s"].rlike(glob_regex(pattern))).collect()}
    assert got == set(yes)
