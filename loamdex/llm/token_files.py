"""Token ids of documents in ORC files, in doc_id order, and what the files hold read back.

ORC keeps the ids of a stripe as run-length encoded integers, with row indexes and Bloom filters on doc_id. Readers
split files by stripes, and a look-up by doc_id skips every stripe and row group whose statistics or filter rule it out.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loamdex.llm.common import in_shards, new_path, order_key

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Most pieces a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 600_000, 48
#: The byte-level rule of this vocabulary: ids never cross from one of these pieces to the next.
_PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d|"
_WORKERS: dict[str, PieceEncoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece of a worker's texts once.

    The library's byte-level models split a text into pieces and encode every piece by itself. Texts are split by
    the same rule here, so only pieces not met before go through the library; the ids are those of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # tokens beside the model, such as an end of text, are found before a text is split into pieces
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        #: Whether a text can be cut at them as it stands; else the library takes texts that may hold one.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        longest_first = sorted(self.added, key=len, reverse=True)
        self.between = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})") if added else None
        self.pieces = regex.compile(_CONTRACTIONS + _PIECES).findall
        # in texts of these characters alone, the standard library's classes are the rule's, and faster
        self.latin = re.compile("[\t-\r -^`-~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*").fullmatch
        fast = r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+"
        self.fast, self.fast_contracted = re.compile(fast).findall, re.compile(_CONTRACTIONS + fast).findall
        self.known: dict[str, bytes] = dict(self.added)
        # the byte-level rule: printable bytes stand for themselves, the others follow from 256 on
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in same]
        self.printable = {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(other)}

    def split(self, text: str) -> list[str]:
        """Pieces, and added tokens, which ``known`` holds from the start."""
        if self.between is not None and self.between.search(text):
            parts = self.between.split(text)
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if self.latin(text):
            # contractions can only matter where there is an apostrophe
            return (self.fast_contracted if "'" in text else self.fast)(text)
        return self.pieces(text)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces by the library's model, which takes each byte as a printable character."""
        tokenize, table = self.library.model.tokenize, self.printable
        out = {}
        for piece in pieces:
            marked = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
            out[piece] = array("I", [t.id for t in tokenize(marked)]).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.plain and any(map(self.between.search, texts)):
            return [array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        known = self.known
        pieces = [self.split(t) for t in texts]
        ids = [list(map(known.get, p)) for p in pieces]
        # one look-up for each piece; only the places of new ones are visited again
        missing = [[k for k, i in enumerate(x) if i is None] if None in x else () for x in ids]
        fresh = {p[k] for p, places in zip(pieces, missing, strict=True) for k in places}
        learned = self._learn(fresh)
        for p, x, places in zip(pieces, ids, missing, strict=True):
            for k in places:
                x[k] = learned[p[k]]
        for piece, code in learned.items():
            if len(known) >= REMEMBERED:
                break
            if len(piece) <= LONGEST:
                known[piece] = code
        return [b"".join(x) for x in ids]


def encoder(path: str) -> PieceEncoder:
    if path not in _WORKERS:
        _WORKERS[path] = PieceEncoder(path)
    return _WORKERS[path]


def _encode(path: str, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        row = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [x + end for x in encode(batch.column("text").to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
                rows = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_shard"), rows, pa.array(sizes), lists],
                    names=["doc_id", "shard", "row", "n_tokens", "ids"],
                )

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, rows_per_shard: int = 4096, stripe_bytes: int = 16 << 20) -> None:
    """Write the ids of every document, each followed by end_id, as ORC files in ascending doc_id order.

    docs: doc_id, text; other columns are ignored. A null text is the empty text (only end_id). Rows with a null
    doc_id come first; ties are ordered by a hash of the text, then by the text, so that many rows of one doc_id are shared
    among files. File k holds the k-th range of doc_ids, sorted; columns doc_id,
    shard (the file's number), row (position in it), n_tokens, ids. An empty table gives files without rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, bounds = in_shards(rows.withColumns({"_key": order_key(F.col("doc_id")), "_tie": F.xxhash64("text")}), "_key", "_tie", rows_per_shard)
    dealt = rows.repartitionById(max(1, len(bounds)), F.col("_shard").cast("int")).sortWithinPartitions("_key", "_tie", "text")
    ids = dealt.select("doc_id", F.col("_shard").cast("int").alias("_shard"), "text").mapInArrow(
        _encode(vocabulary or vocabulary_path(VOCABULARY), np.array([end_id], dtype="<u4").tobytes()),
        "doc_id long, shard int, row long, n_tokens long, ids array<int>",
    )
    (
        ids.write.format("orc")
        .option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .save(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id skip stripes by statistics and Bloom filters."""
    return spark.read.schema("doc_id long, shard int, row long, n_tokens long, ids array<int>").orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("shard"), batch.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "shard", "row", "n_tokens", "ids_crc32"],
        )


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The prefix sum has two levels, totals of files and rows within a file, so no task sees all rows.
    """
    files = read_token_files(spark, path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row per file: in_shards bounds their number
    offsets = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("offset"))
    within = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = files.select("doc_id", "shard", "row", "ids").mapInArrow(_sums, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("before", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def encoded_positions(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the token files (to a new folder in the shared one, if no path is given) and read back each document's place."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    write_token_files(docs, path, **options)
    return token_positions(spark, path)
