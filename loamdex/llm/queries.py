"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.topk import top_k, whole_vectors

    vectors = whole_vectors(_table(spark, sf_dir, "embeddings"))
    asked = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "v")
    return top_k(vectors, asked, k=5)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.secret_scan import scan

    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.token_files import encoded_positions

    return encoded_positions(_table(spark, sf_dir, "documents"))


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.sampled_pieces import sampled_segmentations

    return sampled_segmentations(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.langid import language_of

    return language_of(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.linededup import delete_repeats, digest

    return digest(delete_repeats(_table(spark, sf_dir, "documents")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.llm.mixing import mix

    found = mix(_table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("passes", lambda p: F.concat_ws(":", p["shard"].cast("string"), p["words"].cast("string"))), ",")
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", "part", shards.alias("shards"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"pipeline": pipeline}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM c q JOIN c d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

OP7_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h
  FROM w, LATERAL unnest(range(1, len(words) - 48)) AS t(i) WHERE len(words) >= 50
), f AS (
  SELECT h, min(doc_id) AS first FROM g GROUP BY h
), d AS (
  SELECT DISTINCT g.doc_id, g.i + j AS p FROM g JOIN f USING (h), LATERAL unnest(range(0, 50)) AS t(j) WHERE g.doc_id > f.first
), u AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), k AS (
  SELECT u.doc_id, count(d.p) AS n_removed, coalesce(string_agg(u.word, ' ' ORDER BY u.p) FILTER (WHERE d.p IS NULL), '') AS kept
  FROM u LEFT JOIN d ON u.doc_id = d.doc_id AND u.p = d.p GROUP BY 1
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP9_SQL = """
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), a AS (
  SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM l
), b AS (
  SELECT doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM a
), n AS (
  SELECT doc_id, pos, bare, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM b WHERE bare <> ''
), g AS (
  SELECT doc_id, p, md5(bare || chr(10) || lead(bare, 1) OVER o || chr(10) || lead(bare, 2) OVER o) AS h
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), f AS (
  SELECT h, min({'d': doc_id, 'p': p}) AS first FROM g WHERE h IS NOT NULL GROUP BY h
), x AS (
  SELECT DISTINCT g.doc_id, g.p + j AS p FROM g JOIN f USING (h), LATERAL unnest(range(0, 3)) AS t(j) WHERE {'d': g.doc_id, 'p': g.p} > f.first
), c AS (
  SELECT n.doc_id, count(*) AS n_lines, count(x.p) AS n_removed FROM n LEFT JOIN x USING (doc_id, p) GROUP BY 1
), k AS (
  SELECT b.doc_id, string_agg(b.raw, chr(10) ORDER BY b.pos) FILTER (WHERE x.p IS NULL) AS kept
  FROM b LEFT JOIN n USING (doc_id, pos) LEFT JOIN x ON x.doc_id = n.doc_id AND x.p = n.p GROUP BY 1
)
SELECT l.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  sha256(CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE coalesce(kept, '') END) AS kept_sha256
FROM l LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op7_substring_dedup": OP7_SQL, "op9_line_dedup": OP9_SQL}
