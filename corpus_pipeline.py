"""A training corpus from raw documents: stages that each call one operator, in order.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.common import WORD, cut, new_path
from loamdex.llm.langid import identify, train
from loamdex.llm.linededup import delete_repeats
from loamdex.llm.mixing import mix_in_shards, mix_key
from loamdex.llm.sampled_pieces import sampled_segmentations
from loamdex.llm.simhash import likely, near_copies, with_keys
from loamdex.sources.files import Files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least posterior of the language found.
LEAST_SCORE = 0.5
#: Words from which one or two lines that stood before are deleted as well as longer runs.
PASSAGE_WORDS = 50


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in which no language is found: without a letter, or with a posterior under LEAST_SCORE."""
    found = identify(docs, train(docs), COLUMNS)
    return found.filter(F.col("answered") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of lines, and of one or two long lines; documents of which nothing is left go."""
    rows = delete_repeats(docs.select(*COLUMNS), words=PASSAGE_WORDS)
    kept = rows.filter((F.col("lines_removed") == 0) | (F.col("lines_removed") < F.col("lines_in")))
    return _documents(kept.withColumn("text", F.col("kept_text")))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays (ties by a hash of the text, then by source and lang)."""
    found = cut(near_copies(docs).groupBy("doc", "mark").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")))
    # only rows that may go or stand more than once are shuffled
    few, rows = found.filter("n > 1 OR NOT stays").select("doc", "mark"), with_keys(docs.select(*COLUMNS))
    asked = likely(rows, few).join(found.filter("stays").select("doc", "mark"), ["doc", "mark"])
    # rows of one doc and mark have one text
    same = asked.groupBy("doc", "mark").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct("source", "lang")).alias("least"))
    kept = likely(rows, few, others=True).select("doc_id", "text", "lang", "source")
    return _documents(kept.unionByName(same.select("doc_id", "text", "least.lang", "least.source")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, its last pass cut to the words that are taken, by shard in shuffled order."""
    found, shards = mix_in_shards(docs)
    passes = found.select("key", "size", F.explode("passes").alias("p")).groupBy("key", "size", "p.words", "p.shard", "p.turn").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(*COLUMNS, mix_key(docs).alias("key")).groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "source")], F.min("lang").alias("lang"))
    # equal rows are dealt alike, so each stands as often as there are such rows
    rows = rows.join(passes, "key").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("turn")
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    return _documents(rows.withColumn("text", F.when(F.col("words") < F.col("size"), some).otherwise(F.col("text"))))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text, as piece ids."""
    return sampled_segmentations(docs, with_ids=True, batch_texts=256)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: Several stages run models and sketches that SQL has no words for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage read goes once the next has written."""
    files, paths = Files(spark), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        paths.append(new_path(spark, f"pipeline-{i}"))
        stage(spark, docs, sf_dir).write.parquet(paths[-1])
        docs = spark.read.parquet(paths[-1])
        for old in paths[:-1]:
            files.delete(old)
    return docs
