import zlib

import numpy as np
from tokenizers import Tokenizer

from tests.llm.conftest import in_order

from loamdex.llm.common import new_path
from loamdex.llm.token_files import PieceEncoder, VOCABULARY, encoded_positions, read_token_files, vocabulary_path, write_token_files


def whole(texts):
    t = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(odd, small):
    texts = [r[1] or "" for r in odd[1] + small[1]]
    texts += ["a  b\n \n c\t\t d   ", "it's IT'S 'tis we'll'll x'", "   x\x85y\x1cz　", "<|endoftext|> a_b __ 1²３ ९", "a<|endoftext|>b  <|endoftext|><|endoftext|>\n it's <|endoftext|", "<|endoftext|>", "  \r\n\r\n  x", "é ‍ 👩‍👩‍👧 ﬁ", "᠎﻿   "]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in PieceEncoder(vocabulary_path(VOCABULARY)).encode(texts)]
    assert got == whole(texts)


def expected(rows):
    order = in_order(rows)
    at, out = 0, []
    for (has, doc_id, *_), ids in zip(order, whole([t for *_, t in order]), strict=True):
        ids = ids + [2]
        out.append((doc_id if has else None, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_positions(odd, small, many, none):
    for docs, rows in (odd, small, many):
        for size in (3, 4096):
            got = [tuple(r) for r in encoded_positions(docs, rows_per_shard=size).orderBy("start").collect()]
            assert got == expected(rows)
    assert encoded_positions(none).collect() == []


def test_files_are_in_order_and_found_by_id(spark, small):
    docs, rows = small
    path = new_path(spark, "tokens")
    write_token_files(docs, path, rows_per_shard=40)
    files = read_token_files(spark, path)
    held = [r.doc_id for r in files.orderBy("shard", "row").collect()]
    assert held == sorted(r[0] for r in rows)
    one = files.filter("doc_id = 17")
    assert "EqualTo(doc_id,17)" in one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert one.first().ids == whole([dict((r[0], r[1]) for r in rows)[17]])[0] + [2]


def rows_read(df):
    """Rows that the scan of a filter gives, after stripes and row groups are skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_stripes_and_row_groups_are_skipped(spark):
    """A look-up reads the row group of its id; an id between those that stand is ruled out by the Bloom filters alone."""
    docs = spark.range(20_000).selectExpr("2 * id AS doc_id", "concat('some words ', id, repeat(' and more', 20)) AS text")
    path = new_path(spark, "tokens")
    write_token_files(docs, path, rows_per_shard=20_000, stripe_bytes=100_000)
    files = read_token_files(spark, path)
    assert rows_read(files.select("doc_id", "n_tokens")) == 20_000
    one = files.filter("doc_id = 7000").select("doc_id", "ids")
    assert rows_read(one) <= 2000 and one.count() == 1
    assert rows_read(files.filter("doc_id = 7001").select("doc_id", "ids")) <= 1000
    assert rows_read(files.filter("doc_id BETWEEN 10000 AND 10100").select("doc_id", "ids")) <= 2000
