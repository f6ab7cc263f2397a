"""Every query of the search engine with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.index import Index, SearchOptions
from loamdex.okf.bundle import PROJECTION, read_bundle, sync
from loamdex.sources import tables
from loamdex.sources.files import Files
from loamdex.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
_NOW, _DAY = tables.NOW_MS, 86_400_000

# The indexes in SQL, as FIXTURES.md derives them.
_DOCS = """d AS (SELECT '/docs/' || lang || '/' || doc_id AS path, doc_id AS item_id, text AS body, lang, source, n_chars, quality = 1 AS quality, toxic = 1 AS toxic,
  1704067200000 + 60000 * doc_id AS tm FROM documents LEFT JOIN labels USING (doc_id))"""
_EVENTS = """d AS (SELECT '/events/' || event_id AS path, event_id AS item_id, event_type, CAST(user_id AS VARCHAR) AS user_, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  (epoch_us(ts) // 1000) AS ts, 1704067200000 + 60000 * event_id AS tm FROM events)"""
_ORDERS = """l AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS flags, list_distinct(list(l_quantity)) AS qty, list_distinct(list(epoch_us(l_shipdate) // 1000)) AS shipdates FROM lineitem GROUP BY 1),
d AS (SELECT '/orders/' || o_orderkey AS path, o_orderkey AS item_id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total, epoch_us(o_orderdate) // 1000 AS orderdate, flags, qty, shipdates,
  1704067200000 + 60000 * o_orderkey AS tm FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)"""
_TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
_PAGES = rf"""p AS (SELECT '/pages/' || page_id AS path, page_id AS item_id, url, html,
  CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS title, 1704067200000 + 60000 * page_id AS tm FROM pages),
d AS (SELECT *, {_TOKENS.format("html")} AS th, {_TOKENS.format("coalesce(title, '')")} AS tt FROM p)"""
_SQL = {"docs": _DOCS, "events": _EVENTS, "orders": _ORDERS, "pages": _PAGES}


def _has_phrase(column: str, *phrase: str) -> str:
    joined = f"' ' || array_to_string({column}, ' ') || ' '"
    return f"contains({joined}, ' {' '.join(phrase)} ')"


# name: index, query, condition in SQL. Each returns the matching paths with their ids.
_FILTERS: dict[str, tuple[str, str, str]] = {
    "kw_exact": ("docs", "lang:fr", "lang = 'fr'"),
    "kw_prefix_ci": ("docs", "source:SRC1*", "lower(source) LIKE 'src1%'"),
    "kw_contains_anchored": ("docs", "lang:en AND source:*rc1*", "lang = 'en' AND contains(lower(source), 'rc1')"),
    "kw_glob": ("docs", "source:src?", "source GLOB 'src?'"),
    "kw_glob_class": ("docs", "source:src1[0-4] OR source:sr*[^0-7]", "source = 'src1[0-4]' OR regexp_matches(source, '^sr.*[^0-7]$')"),
    "kw_or": ("docs", "lang:de OR lang:es", "lang IN ('de', 'es')"),
    "num_eq": ("events", "user:\"17\" AND NOT k:3", "user_ = '17' AND NOT coalesce(k = 3, false)"),
    "num_cmp": ("docs", "n_chars>1000", "n_chars > 1000"),
    "num_cmp_le": ("docs", "n_chars<=300", "n_chars <= 300"),
    "num_cmp_colon": ("docs", "n_chars:>=1000", "n_chars >= 1000"),
    "num_range": ("docs", "n_chars:500..2000", "n_chars BETWEEN 500 AND 2000"),
    "num_range_reversed": ("docs", "n_chars:2000..500", "false"),
    "date_cmp": ("events", "ts>2024-01-20", "ts > 1705708800000"),
    "date_range": ("events", "ts:2024-01-01..2024-01-02", "ts BETWEEN 1704067200000 AND 1704153600000"),
    "date_rfc3339": ("events", 'ts>="2024-01-10T12:30:00+02:00"', "ts >= 1704882600000"),
    "date_rel": ("events", "ts>-7d", f"ts > {_NOW - 7 * _DAY}"),
    "date_rel_month": ("orders", "shipdates<1m AND orderdate>2000-06-01", f"len(list_filter(shipdates, lambda x: x < {_NOW + 30 * _DAY})) > 0 AND orderdate > 959817600000"),
    "date_eq": ("orders", "orderdate:1998-02-03", "orderdate = 886464000000"),
    "implicit_age": ("docs", "created<31d", f"tm >= {_NOW - 31 * _DAY}"),
    "implicit_age_older": ("docs", "updated>=744h", f"tm <= {_NOW - 31 * _DAY}"),
    "implicit_date": ("docs", "created:2024-01-01", "tm = 1704067200000"),
    "implicit_range": ("docs", 'created:"2024-01-01T01:00:00Z".."2024-01-01T02:00:00Z"', "tm BETWEEN 1704070800000 AND 1704074400000"),
    "bool_true": ("docs", "toxic:false", "toxic IS FALSE"),
    "bool_short": ("docs", "lang:en AND !toxic", "lang = 'en' AND toxic IS FALSE"),
    "has": ("docs", "lang:en AND has:quality", "lang = 'en' AND quality IS NOT NULL"),
    "not_has": ("docs", "lang:en AND NOT has:quality", "lang = 'en' AND quality IS NULL"),
    "has_multi": ("orders", "status:O AND NOT has:flags", "status = 'O' AND flags IS NULL"),
    "path_prefix": ("docs", "path:/docs/fr/*", "lower(path) LIKE '/docs/fr/%'"),
    "path_prefix_ci": ("docs", "path:/DOCS/Fr/*", "lower(path) LIKE '/docs/fr/%'"),
    "path_glob": ("docs", "path:/docs/*/1?", "path GLOB '/docs/*/1?'"),
    "path_exact": ("docs", "path:/docs/en/1 OR path:/docs/en/2 OR path:/docs/de/3", "path IN ('/docs/en/1', '/docs/en/2', '/docs/de/3')"),
    "bool_tree": ("docs", "(lang:fr OR lang:de) AND NOT source:src0", "lang IN ('fr', 'de') AND source <> 'src0'"),
    "bool_precedence": ("docs", "lang:fr OR lang:de && NOT source:src0", "lang = 'fr' OR (lang = 'de' AND source <> 'src0')"),
    "double_negation": ("docs", "NOT NOT lang:fr AND n_chars>0", "lang = 'fr' AND n_chars > 0"),
    "multi_any": ("orders", "flags:R AND qty>45", "list_contains(flags, 'R') AND len(list_filter(qty, lambda x: x > 45)) > 0"),
    "multi_range": ("orders", "qty:48..49", "len(list_filter(qty, lambda x: x BETWEEN 48 AND 49)) > 0"),
    "multi_dedup": ("orders", "flags:R OR flags:A", "list_contains(flags, 'R') OR list_contains(flags, 'A')"),
    "multi_prefix": ("orders", 'priority:"1-*"', "lower(priority) LIKE '1-%'"),
    "not_multi": ("orders", "total>100000 AND NOT flags:N", "total > 100000 AND NOT coalesce(list_contains(flags, 'N'), false)"),
    "fts_term": ("docs", "body:that", f"list_contains({_TOKENS.format('body')}, 'that')"),
    "fts_phrase": ("docs", '"of the"', _has_phrase(_TOKENS.format("body"), "of", "the")),
    "fts_accent": ("docs", 'body:"ÜBER" OR body:der', f"len(list_filter({_TOKENS.format('body')}, lambda t: t IN ('uber', 'der'))) > 0"),
    "fts_not": ("docs", 'lang:en AND NOT "that"', f"lang = 'en' AND NOT list_contains({_TOKENS.format('body')}, 'that')"),
    "fts_allfields": ("pages", "nicht OR title:the", "list_contains(th, 'nicht') OR list_contains(tt, 'nicht') OR list_contains(tt, 'the')"),
    "fts_field_phrase": ("pages", 'html:"div class"', _has_phrase("th", "div", "class")),
}


def _filter(name: str, index: str, query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # text is searched in a stored index, whose texts are split once
        made = tables.stored(spark, sf_dir, index) if name.startswith("fts_") else getattr(tables, index)(spark, sf_dir)
        return made.matching(query).select("path", "item_id")

    return run


def _page(index: str, query: str, rank: str, limit: int, after: dict | None = None, stored: bool = False) -> Query:
    """path, score and position of the first rows after a position."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = tables.stored(spark, sf_dir, index) if stored else getattr(tables, index)(spark, sf_dir)
        rows = made.ranked(query, rank, after, limit)
        return rows.select("path", F.round("score", 6).alias("score"))

    return run


def _bm25_sql(setup: str, fields: dict[str, float], condition: str, phrase: str, limit: int) -> str:
    """BM25 of one term over token columns with weights."""
    frequency = " + ".join(f"{w} * len(list_filter({c}, lambda t: t = '{phrase}'))" for c, w in fields.items())
    length = " + ".join(f"len({c})" for c in fields)
    held = f"count(*) FILTER (WHERE {' OR '.join(f"list_contains({c}, '{phrase}')" for c in fields)})"
    return f"""WITH {setup}, s AS (SELECT count(*) AS n, avg({length}) AS mean, {held} AS m FROM d), r AS (
  SELECT path, item_id, round(greatest(ln((n - m + 0.5) / (m + 0.5)), 1e-6) * ({frequency}) * 2.2 / (({frequency}) + 1.2 * (0.25 + 0.75 * ({length}) / mean)), 9) AS score FROM d, s WHERE {condition})
SELECT path, round(score, 6) AS score FROM r ORDER BY r.score DESC, item_id LIMIT {limit}"""


_DOCS_TOKENS = f"{_DOCS.replace('d AS (', 'e AS (', 1)}, d AS (SELECT *, {_TOKENS.format('body')} AS tb FROM e)"


def _facet(index: str, field: str, where: str = "", top: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(tables, index)(spark, sf_dir).discover_values(field, where, top)

    return run


def _stats(index: str, field: str, where: str = "") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = getattr(tables, index)(spark, sf_dir).stats(field, where)
        return out.select("count", "min", "max", F.round("avg", 6).alias("avg"))

    return run


def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders(spark, sf_dir).matching("flags:R AND status:F").agg(F.count(F.lit(1)).alias("n"))


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.docs(spark, sf_dir).discover_fields()


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.docs(spark, sf_dir).ranked("lang:fr AND n_chars>1000", "recency", None, 50).select("path", "item_id", "updated_at")


def _upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as documents by user in order of id, in two batches: the last of each user stands, errors delete."""
    events = tables.read(spark, sf_dir, "events")
    path = F.concat(F.lit("/users/"), F.col("user_id").cast("string"))
    doc = F.to_json(F.struct(path.alias("path"), "event_type", "value"))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    ops = events.select(F.col("event_id").alias("seq"), op.alias("op"), path.alias("path"), doc.alias("data_json"))
    index = Index.create(spark, f"{new_path(spark, 'upserts')}.idx", tables.Schema({"event_type": tables.Field("keyword"), "value": tables.Field("number")}))
    middle = events.agg(F.floor(F.avg("event_id"))).first()[0]
    index.write_ops(ops.filter(F.col("seq") <= middle), now_ms=1000)
    index.write_ops(ops.filter(F.col("seq") > middle), now_ms=2000)
    return index.items.select("path", "item_id", "created_at", "updated_at", F.col("f_event_type").alias("event_type"), F.round("f_value", 6).alias("value"))


_UPSERTS_SQL = """WITH e AS (SELECT *, CASE WHEN event_id <= (SELECT floor(avg(event_id)) FROM events) THEN 1 ELSE 2 END AS batch, event_type = 'error' AS gone FROM events),
w AS (SELECT *, max(event_id) FILTER (WHERE gone) OVER (PARTITION BY user_id, batch) AS last_gone, row_number() OVER (PARTITION BY user_id, batch ORDER BY event_id DESC) AS n FROM e),
s AS (SELECT user_id, batch, max(last_gone) AS last_gone, min(event_id) FILTER (WHERE NOT gone AND (last_gone IS NULL OR event_id > last_gone)) AS born,
  max(event_type) FILTER (WHERE n = 1) AS event_type, max(value) FILTER (WHERE n = 1) AS value, bool_or(gone) FILTER (WHERE n = 1) AS dead FROM w GROUP BY 1, 2),
one AS (SELECT *, row_number() OVER (ORDER BY born) AS item_id FROM s WHERE batch = 1 AND NOT dead),
two AS (SELECT s.*, one.item_id AS old_id FROM s LEFT JOIN one USING (user_id) WHERE s.batch = 2 AND NOT s.dead),
new AS (SELECT user_id, (SELECT count(*) FROM e WHERE batch = 1 AND NOT gone) + row_number() OVER (ORDER BY born) AS item_id FROM two WHERE old_id IS NULL OR last_gone IS NOT NULL)
SELECT '/users/' || two.user_id AS path, coalesce(new.item_id, old_id) AS item_id, CASE WHEN new.item_id IS NULL THEN 1000 ELSE 2000 END AS created_at, 2000 AS updated_at, event_type, round(value, 6) AS value FROM two LEFT JOIN new USING (user_id)
UNION ALL SELECT '/users/' || user_id, item_id, 1000, 1000, event_type, round(value, 6) FROM one WHERE user_id NOT IN (SELECT user_id FROM s WHERE batch = 2)"""


def _delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables.fresh(spark, sf_dir, "docs")
    index.delete_where("lang:en OR toxic:true")
    return index.items.select("path", "item_id")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.docs(spark, sf_dir).scan_paths("/docs/de/1")
    return spark.createDataFrame([(path,) for path in found], "path string")


def _zero_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global facet after every French document is gone: its value stays, with count 0."""
    index = tables.fresh(spark, sf_dir, "docs")
    index.delete_where("lang:fr")
    return index.discover_values("lang", top=None)


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines in several files, and imported as one batch: ids follow files and lines."""
    path = F.concat(F.lit("/docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(path.alias("path"), F.col("text").alias("body"), "lang", "n_chars")).alias("value"))
    folder = new_path(spark, "lines")
    rows.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(folder)
    index = Index.create(spark, f"{new_path(spark, 'imported')}.idx", tables.Schema.from_spec("body:text,lang:keyword,n_chars:number"))
    index.import_jsonl(folder)
    return index.items.select("path", "item_id", F.col("f_lang").alias("lang"), F.col("f_n_chars").alias("n_chars"), F.col("length").alias("n_tokens"))


def _cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a search: the first one, and all that follow its cursor in one pass."""
    index, query = tables.orders(spark, sf_dir), "status:P AND total>300000"
    got = index.search(query, SearchOptions("field:total", 40))
    first = spark.createDataFrame([(0, i, x["path"]) for i, x in enumerate(got.items)], "page long, place long, path string")
    if not got.has_more:
        return first
    rest = index.pages(query, SearchOptions("field:total", 40, got.next_cursor))
    return first.unionByName(rest.select((F.col("page") + 1).alias("page"), "place", "path"))


def _got(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of a stored index, before and after a put of one of the paths."""
    index = tables.fresh(spark, sf_dir, "pages")
    index.now_ms = lambda: _NOW
    path = index.items.agg(F.min("path")).first()[0]
    index.put_fields(path, {"url": "changed"})
    got = index.get(path)
    url = index.items.filter(F.col("path") == path).first()["f_url"]
    return spark.createDataFrame([(path, got["doc"]["url"], url, got["created_at"], got["updated_at"], index.items.count())], "path string, url string, field string, created_at long, updated_at long, items long")


def _write_bundle(spark: SparkSession, sf_dir: str, faults: bool) -> tuple[str, Files]:
    """Regions and nations as a bundle of documents that link to each other; with faults that the rules find."""
    files, root = Files(spark), new_path(spark, "bundle")
    nations = tables.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    for r in tables.read(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        links = "".join(f"* [{n['n_name']}](../nations/{n['n_nationkey']}.md)\n" for n in nations if n["n_regionkey"] == r["r_regionkey"])
        files.write(f"{root}/regions/{r['r_regionkey']}.md", f"---\ntype: Region\ntitle: {r['r_name']}\n---\n{links}")
    for n in nations:
        k = n["n_nationkey"]
        kind = "" if faults and k % 5 == 0 else "type: Nation\n"
        status = "status: odd\n" if faults and k % 7 == 3 else "status: draft\n"
        missing = f" and [none](/nowhere/{k}.md)" if faults and k % 6 == 1 else ""
        files.write(f"{root}/nations/{k}.md", f"---\n{kind}{status}title: {n['n_name']}\ntags: [r{n['n_regionkey']}]\n---\nIn [it](/regions/{n['n_regionkey']}.md){missing}.\n")
    return root, files


def _okf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_bundle(spark, _write_bundle(spark, sf_dir, True)[0]).findings
    return found.select("path", "severity", "code", F.col("line").cast("long").alias("line"))


def _okf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundle(spark, _write_bundle(spark, sf_dir, True)[0]).edges.select("source", "target")


def _okf_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index.create(spark, f"{new_path(spark, 'projections')}.idx", PROJECTION)
    sync(spark, _write_bundle(spark, sf_dir, False)[0], index)
    columns = [F.col(f"f_{c}").alias(c) for c in ("title", "type", "status", "trust_tier")]
    return index.items.select("path", *columns, F.array_join(F.array_sort("f_link_targets"), " ").alias("targets"), F.size("f_backlinks").cast("long").alias("backlinks"))


def _okf_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second synchronisation does after all regions changed and the nations of one are gone."""
    root, files = _write_bundle(spark, sf_dir, False)
    index = Index.create(spark, f"{new_path(spark, 'synced')}.idx", PROJECTION)
    first = sync(spark, root, index)
    for name in files.names(f"{root}/regions"):
        files.write(f"{root}/regions/{name}", files.read(f"{root}/regions/{name}") + "\nMore.\n")
    for n in tables.read(spark, sf_dir, "nation").filter("n_regionkey = 0").collect():
        files.delete(f"{root}/nations/{n['n_nationkey']}.md")
    again = sync(spark, root, index)
    kinds = ("added", "updated", "unchanged", "deleted")
    rows = [(i, k, report[k]) for i, report in enumerate((first, again), 1) for k in kinds] + [(3, "items", index.items.count())]
    return spark.createDataFrame(rows, "run long, kind string, n long")


_AFTER_FIELD = {"kind": "field", "field": "total", "rank_value": 300000.0, "updated_at_ms": 1704067200000, "path": "/"}
_AFTER_RECENCY = {"kind": "recency", "updated_at_ms": 1704067200000 + 60000 * 500, "path": "/docs/zz"}

_MORE: dict[str, tuple[Query, str]] = {
    "search_flagship": (_flagship, f"WITH {_DOCS} SELECT path, item_id, tm AS updated_at FROM d WHERE lang = 'fr' AND n_chars > 1000 ORDER BY tm DESC, path LIMIT 50"),
    "rank_recency": (_page("docs", "lang:de", "recency", 25), f"WITH {_DOCS} SELECT path, CAST(tm AS DOUBLE) AS score FROM d WHERE lang = 'de' ORDER BY tm DESC, path LIMIT 25"),
    "rank_default_without_text": (_page("orders", "status:P", "default", 10), f"WITH {_ORDERS} SELECT path, CAST(tm AS DOUBLE) AS score FROM d WHERE status = 'P' ORDER BY tm DESC, path LIMIT 10"),
    "rank_none": (_page("docs", "lang:de", "none", 25), f"WITH {_DOCS} SELECT path, CAST(0 AS DOUBLE) AS score FROM d WHERE lang = 'de' ORDER BY item_id LIMIT 25"),
    "rank_field": (_page("orders", "status:F", "field:total", 20), f"WITH {_ORDERS} SELECT path, round(total, 6) AS score FROM d WHERE status = 'F' ORDER BY total DESC, tm DESC, path LIMIT 20"),
    "rank_field_multi": (_page("orders", "status:F", "field:qty", 30), f"WITH {_ORDERS} SELECT path, list_max(qty) AS score FROM d WHERE status = 'F' AND qty IS NOT NULL ORDER BY list_max(qty) DESC, tm DESC, path LIMIT 30"),
    "page2_keyset": (
        _page("orders", "status:F", "field:total", 20, _AFTER_FIELD),
        f"WITH {_ORDERS} SELECT path, round(total, 6) AS score FROM d WHERE status = 'F' AND (total < 300000 OR (total = 300000 AND tm < 1704067200000)) ORDER BY total DESC, tm DESC, path LIMIT 20",
    ),
    "page2_recency": (
        _page("docs", "lang:en", "recency", 20, _AFTER_RECENCY),
        f"WITH {_DOCS} SELECT path, CAST(tm AS DOUBLE) AS score FROM d WHERE lang = 'en' AND (tm < 1704097200000 OR (tm = 1704097200000 AND path > '/docs/zz')) ORDER BY tm DESC, path LIMIT 20",
    ),
    "fts_bm25_topk": (_page("docs", "that", "default", 10, stored=True), _bm25_sql(_DOCS_TOKENS, {"tb": 1.0}, "list_contains(tb, 'that')", "that", 10)),
    "fts_bm25_weighted": (_page("pages", "the", "default", 10, stored=True), _bm25_sql(_PAGES, {"th": 1.0, "tt": 3.0}, "list_contains(th, 'the') OR list_contains(tt, 'the')", "the", 10)),
    "count_query": (_count, f"WITH {_ORDERS} SELECT count(*) AS n FROM d WHERE list_contains(flags, 'R') AND status = 'F'"),
    "facet_global": (_facet("orders", "flags"), f"WITH {_ORDERS} SELECT value, count(*) AS count FROM (SELECT unnest(flags) AS value FROM d) GROUP BY 1"),
    "facet_scoped": (_facet("orders", "flags", "status:O"), f"WITH {_ORDERS} SELECT value, count(*) AS count FROM (SELECT unnest(flags) AS value FROM d WHERE status = 'O') GROUP BY 1"),
    "facet_top": (_facet("docs", "source", "lang:en", 5), f"WITH {_DOCS} SELECT source AS value, count(*) AS count FROM d WHERE lang = 'en' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "facet_zero_frequency": (_zero_values, f"WITH {_DOCS} SELECT lang AS value, count(*) FILTER (WHERE lang <> 'fr') AS count FROM d GROUP BY 1"),
    "fields_overview": (
        _overview,
        f"""WITH {_DOCS} SELECT field, type, doc_count, weight FROM (
  SELECT 'body' AS field, 'Text' AS type, count(body) AS doc_count, CAST(1 AS DOUBLE) AS weight FROM d UNION ALL SELECT 'lang', 'Keyword', count(lang), NULL FROM d
  UNION ALL SELECT 'source', 'Keyword', count(source), NULL FROM d UNION ALL SELECT 'n_chars', 'Number', count(n_chars), NULL FROM d
  UNION ALL SELECT 'quality', 'Bool', count(quality), NULL FROM d UNION ALL SELECT 'toxic', 'Bool', count(toxic), NULL FROM d)""",
    ),
    "stats_global": (_stats("orders", "qty"), f"WITH {_ORDERS} SELECT count(x) AS count, min(x) AS min, max(x) AS max, round(avg(x), 6) AS avg FROM (SELECT unnest(qty) AS x FROM d)"),
    "stats_scoped": (
        _stats("orders", "qty", "status:O"),
        f"WITH {_ORDERS} SELECT count(DISTINCT item_id) AS count, min(x) AS min, max(x) AS max, round(avg(x), 6) AS avg FROM (SELECT item_id, unnest(qty) AS x FROM d WHERE status = 'O')",
    ),
    "stats_created": (_stats("docs", "created", "lang:es"), f"WITH {_DOCS} SELECT count(*) AS count, CAST(min(tm) AS DOUBLE) AS min, CAST(max(tm) AS DOUBLE) AS max, round(avg(tm), 6) AS avg FROM d WHERE lang = 'es'"),
    "stats_date": (_stats("events", "ts", "event_type:purchase"), f"WITH {_EVENTS} SELECT count(*) AS count, CAST(min(ts) AS DOUBLE) AS min, CAST(max(ts) AS DOUBLE) AS max, round(avg(ts), 6) AS avg FROM d WHERE event_type = 'purchase'"),
    "upsert_lww": (_upserts, _UPSERTS_SQL),
    "import_files": (
        _imported,
        f"""WITH {_DOCS}, t AS (SELECT *, {_TOKENS.format("coalesce(body, '')")} AS tb FROM d)
SELECT path, row_number() OVER (ORDER BY item_id) AS item_id, lang, CAST(n_chars AS DOUBLE) AS n_chars, len(tb) AS n_tokens FROM t""",
    ),
    "cursor_pages": (
        _cursor_pages,
        f"""WITH {_ORDERS}, r AS (SELECT path, row_number() OVER (ORDER BY total DESC, tm DESC, path) - 1 AS n FROM d WHERE status = 'P' AND total > 300000)
SELECT n // 40 AS page, n % 40 AS place, path FROM r""",
    ),
    "put_and_get": (
        _got,
        f"WITH {_PAGES}, f AS (SELECT min(path) AS path FROM d) SELECT path, 'changed' AS url, 'changed' AS field, tm AS created_at, {_NOW} AS updated_at, (SELECT count(*) FROM d) AS items FROM d WHERE path = (SELECT path FROM f)",
    ),
    "okf_findings": (
        _okf_findings,
        """SELECT 'nations/' || n_nationkey || '.md' AS path, 'error' AS severity, 'OKF105' AS code, CAST(NULL AS BIGINT) AS line FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'nations/' || n_nationkey || '.md', 'warning', 'OKF320', CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 3 END FROM nation WHERE n_nationkey % 7 = 3
UNION ALL SELECT 'nations/' || n_nationkey || '.md', 'warning', 'OKF400', CASE WHEN n_nationkey % 5 = 0 THEN 6 ELSE 7 END FROM nation WHERE n_nationkey % 6 = 1""",
    ),
    "okf_links": (
        _okf_links,
        """SELECT 'nations/' || n_nationkey || '.md' AS source, 'regions/' || n_regionkey || '.md' AS target FROM nation
UNION ALL SELECT 'regions/' || n_regionkey || '.md', 'nations/' || n_nationkey || '.md' FROM nation""",
    ),
    "okf_projections": (
        _okf_projections,
        """SELECT '/nations/' || n_nationkey AS path, n_name AS title, 'Nation' AS type, 'draft' AS status, 'unverified' AS trust_tier, '/regions/' || n_regionkey AS targets, 1 AS backlinks FROM nation
UNION ALL SELECT '/regions/' || r_regionkey, r_name, 'Region', 'stable', 'unverified', string_agg('/nations/' || n_nationkey, ' ' ORDER BY '/nations/' || n_nationkey), count(*) FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""",
    ),
    "okf_sync": (
        _okf_sync,
        """WITH c AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation WHERE n_regionkey = 0) AS gone)
SELECT 1 AS run, unnest(['added', 'updated', 'unchanged', 'deleted']) AS kind, unnest([n + r, 0, 0, 0]) AS n FROM c
UNION ALL SELECT 2, unnest(['added', 'updated', 'unchanged', 'deleted']), unnest([0, r, n - gone, gone]) FROM c UNION ALL SELECT 3, 'items', n + r - gone FROM c""",
    ),
    "delete_where": (_delete_where, f"WITH {_DOCS} SELECT path, item_id FROM d WHERE NOT (lang = 'en' OR coalesce(toxic, false))"),
    "scan_paths": (_scan, f"WITH {_DOCS} SELECT path FROM d WHERE starts_with(path, '/docs/de/1')"),
}


def queries() -> dict[str, Query]:
    return {name: _filter(name, index, query) for name, (index, query, _) in _FILTERS.items()} | {name: query for name, (query, _) in _MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {_SQL[index]} SELECT path, item_id FROM d WHERE {condition}" for name, (index, _, condition) in _FILTERS.items()} | {name: sql for name, (_, sql) in _MORE.items()}
