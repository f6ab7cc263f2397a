"""Line dedup by winnowing over line hashes.

Lines are stripped and hashed; blank lines don't count. Hashes of ``gram`` lines are winnowed: the least of every
``run - gram + 1`` neighbours is a fingerprint, so any ``run`` lines that stand in two places have one in common.
Fingerprints are joined, and a match is extended to both sides: as far as the windows around the fingerprint agree, and
from one fingerprint to the next while both texts go on alike (``repeats.parse``). The lines of a match are compared as
text, and of a run of ``run`` or more lines that stands in several places all but the first are deleted. On request one
or two lines are a run as well where they hold enough words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.repeats import BITS, HOT, Units, dealt, factors
from loamdex.llm.substring import covered

RUN, GRAM = 3, 2
_ADDED = ("lines_in", "lines_removed", "kept_text")
_BLANK = b" \t\n\r\x0b\x0c"


def split_lines(text: str | None) -> list[bytes]:
    """The stripped lines that are not blank."""
    return [s for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if (s := x.strip(_BLANK))]


LINES = Units(split_lines, "\n")


def long_runs(text: str | None, words: int) -> list[tuple[bytes, int, int]]:
    """(joined lines, first line, lines) of every one or two lines in a row that hold this many words."""
    lines = split_lines(text)
    counts = [len(x.split()) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if counts[i] >= words:
            out.append((line, i, 1))
        if i + 1 < len(lines) and counts[i] + counts[i + 1] >= words:
            out.append((b"\n".join(lines[i : i + 2]), i, 2))
    return out


def without(text: str, gone: list[bool]) -> str:
    """The text less the lines that count and are gone; if all are, nothing is left."""
    if all(gone):
        return ""
    kept, k = [], 0
    for line in text.split("\n"):
        if not line.strip(" \t\r\x0b\x0c"):
            kept.append(line)
            continue
        if not gone[k]:
            kept.append(line)
        k += 1
    return "\n".join(kept)


def _deleted(words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lines, removed, texts = [], [], []
                for text, spans, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "runs")), strict=True):
                    n = len(split_lines(text))
                    spans = list(spans or ())
                    if runs:
                        known = long_runs(text, words)
                        spans += [{"start": known[i][1], "end": known[i][1] + known[i][2]} for x in runs for i in range(x["start"], x["end"])]
                    gone = covered(spans, n).tolist() if spans else []
                    lines.append(n)
                    removed.append(sum(gone))
                    texts.append(without(text or "", gone) if any(gone) else text)
                names = [c for c in batch.schema.names if c not in ("text", "spans", "runs")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                    names=[*names, "n0", "n1", "kept"],
                )

    return run


def _spans(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias(name))


def delete_repeats(docs: DataFrame, run: int = RUN, gram: int = GRAM, words: int | None = None, hot: int = HOT, bits: int = BITS) -> DataFrame:
    """docs with lines_in, lines_removed and kept_text: lines of a run of ``run`` or more that stood before are deleted.

    With ``words``, so are one or two lines that stood before and hold this many words or more.

    docs: doc_id, text and any other columns, which are kept, whatever their names; those called lines_in, lines_removed
    or kept_text give way to the new ones. A run stood before if it starts in a row of smaller doc_id, or earlier in the
    same text. A null text stays null and has no lines. A null doc_id comes last. Repeated rows (equal doc_id and text)
    are judged alike: none is before the other, but both are after earlier rows. Only whole lines go; blank lines stay,
    unless every line is gone, which leaves the empty text. No rows give no rows. hot, bits: see factors.
    """
    keep = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("text", *_ADDED)}
    safe = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in keep.items()], F.col("text").cast("string").alias("raw"))
    doc = F.coalesce(F.col(keep["doc_id"]).cast("long"), F.lit((1 << 63) - 1))
    rows = safe.withColumns({"text": F.coalesce("raw", F.lit("")), "doc": doc}).withColumn("mark", F.xxhash64("text"))
    rows = rows.select(*keep.values(), "text", F.col("raw").isNull().alias("absent"), "doc", "mark")
    both = dealt(rows).join(_spans(factors(rows, LINES, run, gram, True, hot, bits), "spans"), ["doc", "mark"], "left")
    if words is None:
        both = both.withColumn("runs", F.lit(None).cast("array<struct<start:long,end:long>>"))
    else:
        # one or two lines are a unit; none holds a blank line, so a blank line parts them
        long = Units(lambda text: [x[0] for x in long_runs(text, words)], "\n\n")
        both = both.join(_spans(factors(rows, long, 1, 1, True, hot, bits), "runs"), ["doc", "mark"], "left")
    both = both.withColumn("text", F.when(~F.col("absent"), F.col("text")))
    kinds = [f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in keep.items()]
    out = both.select(*keep.values(), "text", "spans", "runs").mapInArrow(_deleted(words), ", ".join([*kinds, "n0 long", "n1 long", "kept string"]))
    return out.select(*[F.col(k).alias(c) for c, k in keep.items()], *[F.col(k).alias(c) for k, c in zip(("n0", "n1", "kept"), _ADDED, strict=True)])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the hash of what is kept."""
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lines_in").alias("n_lines"),
        F.col("lines_removed").alias("n_removed"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )
