"""Substring dedup by relative Lempel-Ziv parsing (see repeats.py): every document is factored greedily against the indexed
blocks of the documents before it, and factors of ``window`` words or more, compared word by word, are duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.repeats import BITS, HOT, Units, dealt, factors

WINDOW, GRAM = 50, 8
#: Order of a null doc_id: after all others.
_LAST = (1 << 63) - 1


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


WORDS = Units(split_words, " ")


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of n units lie in a span."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        edges[s["start"]] += 1
        edges[s["end"]] -= 1
    return np.cumsum(edges[:n]) > 0


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (its order) and mark (the text's hash, which tells rows of one doc_id apart)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST)), "mark": F.xxhash64("text")})


def word_factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bits: int = BITS) -> DataFrame:
    """Factors of every document: doc, mark, start, end (words), of_doc, of_mark, of_start, where these words stand first."""
    return factors(marked(docs), WORDS, window, gram, within=False, hot=hot, bits=bits)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            words, gone, sums, kept_texts = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                units = split_words(text)
                if spans:
                    out = covered(spans, len(units))
                    kept = [u for u, o in zip(units, out.tolist(), strict=True) if not o]
                    gone.append(int(out.sum()))
                else:
                    kept = units
                    gone.append(0)
                kept = b" ".join(kept)
                words.append(len(units))
                sums.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "surrogatepass"))
            columns = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if "want_text" in batch.schema.names:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False, hot: int = HOT, bits: int = BITS) -> DataFrame:
    """Remove every word that a window covers whose words also start in a document of smaller doc_id.

    docs: doc_id, text; other columns are ignored. Words are split at ASCII white space and compared byte by byte. A
    null text has no words; documents of fewer than ``window`` words lose none. A null doc_id comes after all others,
    and rows of equal doc_id don't count as earlier than each other, so repeated rows are judged alike. Windows are
    judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space, and with
    ``texts`` kept_text. No rows give no rows. hot, bits: see factors.
    """
    spans = word_factors(docs, window, gram, hot, bits).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    both = dealt(marked(docs)).join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans", *([F.lit(1).alias("want_text")] if texts else []))
    return both.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else ""))
