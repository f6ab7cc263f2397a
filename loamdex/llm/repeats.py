"""Relative parsing of texts: units (words or lines) that repeat what stood before, as factors of indexed reference blocks.

The reference holds every window of ``window`` consecutive units once, where it stands first; its blocks are stretches of
the rows that hold such windows. The index leads from a window to its place in the reference:

* Of the ``gram``-unit hashes inside a window the least is its anchor. Equal windows have equal anchors wherever they
  stand, and neighbours mostly share one, so one row per anchor carries the hashes of its windows: about two rows for every
  window length of text. Rows whose anchor occurs once are dropped by a join with the anchors' counts.
* The others meet by anchor, and each window finds the first of its kind. As the reference holds a window once, this is
  the only block that can go on from there.

A text is then parsed from left to right: a factor starts at the first window that is in the reference and goes on, to both
sides of its anchors and across them, as far as the next window stands next to it in the reference as well. Windows that
lie across the border of two factors are looked up like all others, so that none hides there. Each factor is sent to the
block that it repeats, and only units that are equal there, compared as text, become duplicate spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import cut, give_back

#: Rows of one anchor that a task compares by itself; windows of anchors with more are dealt by their own hashes.
HOT = 8192
#: Units of a reference block, less those of the windows that start in it and end in the next.
BLOCK = 512
#: Bits of a window's hash.
BITS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Units:
    """How a text is split, and what joins units again so that no two lists of them give one text."""

    split: Callable[[str], list[bytes]]
    sep: str


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def hashes(units: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, units), dtype=np.uint64, count=len(units))


def _prefix(units: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * _powers(_BASE, len(units)), out=out[1:])
    return out


def _spans(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hashes modulo 2 ** 64 of all spans of this many units, mixed."""
    x = (prefix[length:] - prefix[:-length]) * _powers(_INVERSE, len(prefix) - length)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(units: np.ndarray, window: int, gram: int, full: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of each run of windows with one anchor: its hash, the first window, whether it stands at several places; and the windows' hashes."""
    if len(units) < window:
        none = np.zeros(0, dtype=np.uint64)
        return none, none.astype(np.int64), none.astype(bool), none
    prefix = _prefix(units)
    grams = _spans(prefix, gram)
    wide = window - gram + 1
    n = len(units) - window + 1
    place = np.empty(n, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + wide - 1], wide)[: min(1 << 16, n - at)]
        place[at : at + len(view)] = view.argmin(axis=1) + np.arange(at, at + len(view))
    least = grams[place]
    # of a gram that stands several times in a row, as in periodic text, only the hash counts, so that its windows stay one run
    starts = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    several = place[starts] != place[np.append(starts[1:], n) - 1]
    return least[starts], starts, several, _spans(prefix, window) if full else None


_ROW = "anchor long, doc long, mark long, start long, prints binary"
_HIT = "doc long, mark long, start long, end long, of_doc long, of_mark long, of_start long"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def _emit(split: Callable[[str], list[bytes]], window: int, gram: int, bits: int | None, within: bool):
    """Rows of the anchors of every text, with windows' hashes of this many bits.

    Without bits the anchors alone; with ``within`` those at several places of one run count twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys, docs, marks, places, data = [], [], [], [], []
                for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text")), strict=True):
                    units = split(text)
                    if len(units) < window:
                        continue
                    anchor, starts, several, prints = anchors(hashes(units), window, gram, bits is not None)
                    keys.append(anchor)
                    if within and bits is None:
                        keys.append(anchor[several])
                    if bits is not None:
                        docs.append(np.full(len(anchor), doc, dtype=np.int64))
                        marks.append(np.full(len(anchor), mark, dtype=np.int64))
                        places.append(starts)
                        raw = (prints if bits == 64 else prints & np.uint64((1 << bits) - 1)).tobytes()
                        ends = np.append(starts[1:], len(prints))
                        data += [raw[8 * a : 8 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                if not keys:
                    continue
                anchor = np.concatenate(keys).view(np.int64)
                if bits is None:
                    yield _batch([anchor], "anchor long")
                else:
                    yield _batch([anchor, *map(np.concatenate, (docs, marks, places)), pa.array(data, pa.binary())], _ROW)
        give_back()

    return run


def _groups(keys: tuple[str, ...], work: Callable):
    """work on the whole groups of rows that are sorted by keys and come in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            numbers = [table.column(c).to_numpy() for c in ("anchor", "doc", "mark", "start")]
            yield from work(*numbers, table.column("prints").to_pylist())

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            # the last group may go on in the next batch
            new = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
            last = int(new[-1]) + 1 if len(new) else 0
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield from flush(held)
                held = []
            if last:
                yield from flush([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from flush(held)

    return run


class _Windows:
    """The windows of rows sorted by anchor, doc, mark and start, one after another."""

    def __init__(self, anchor: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, prints: list[bytes]):
        size = np.array([len(p) // 8 for p in prints])
        self.row = np.repeat(np.arange(len(size)), size)
        self.key = np.frombuffer(b"".join(prints), dtype=np.uint64)
        self.anchor, self.doc, self.mark = anchor[self.row], doc[self.row], mark[self.row]
        self.at = start[self.row] + np.arange(len(self.row)) - np.repeat(np.cumsum(size) - size, size)
        # stable, so the first of equal windows is the earliest
        self.order = np.lexsort((self.key, self.anchor))

    def first(self, *same: np.ndarray) -> np.ndarray:
        """Of every window the first one of equal hash, and equal in these columns as well."""
        fresh = np.ones(len(self.order), dtype=bool)
        fresh[1:] = np.logical_or.reduce([np.diff(c[self.order]) != 0 for c in (self.anchor, self.key, *same)])
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = self.order[fresh][np.cumsum(fresh) - 1]
        return out


def _compare(window: int, within: bool):
    """Rows sorted by anchor, doc, mark, start: runs of windows that follow each other here and where they stand first."""

    def work(*columns) -> Iterator[pa.RecordBatch]:
        w = _Windows(*columns)
        source = w.first()
        earlier = w.doc[source] < w.doc
        if within:
            own = w.first(w.doc, w.mark)
            source = np.where(earlier, source, own)
            earlier |= w.at[own] < w.at
        hit = np.flatnonzero(earlier)
        if not len(hit):
            return
        of = source[hit]
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (np.diff(hit) != 1) | (np.diff(w.row[hit]) != 0) | (np.diff(w.row[of]) != 0) | (np.diff(w.at[of]) != 1)
        head, tail = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        of = source[head]
        yield _batch([w.doc[head], w.mark[head], w.at[head], w.at[tail] + window, w.doc[of], w.mark[of], w.at[of]], _HIT)

    return _groups(("anchor",), work)


def _apart():
    """Rows sorted by anchor, doc, mark, start: one row per window, with the first equal window of the same row of docs."""

    def work(*columns) -> Iterator[pa.RecordBatch]:
        w = _Windows(*columns)
        own = w.at[w.first(w.doc, w.mark)]
        for i in range(0, len(own), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield _batch([c[part] for c in (w.anchor, w.key.view(np.int64), w.doc, w.mark, w.at, own)], _WINDOW)

    return _groups(("anchor", "doc", "mark"), work)


_WINDOW = "anchor long, print long, doc long, mark long, start long, own long"


def runs(rows: DataFrame, units: Units, window: int, gram: int, within: bool, hot: int = HOT, bits: int = BITS) -> DataFrame:
    """Runs of windows of every row of docs whose hashes stood before: doc, mark, start, end, of_doc, of_mark, of_start."""
    counts = rows.mapInArrow(_emit(units.split, window, gram, None, within), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    every = rows.mapInArrow(_emit(units.split, window, gram, bits, within), _ROW)
    # read by both branches below
    shared = cut(every.join(counts, "anchor"))
    place = ["anchor", "doc", "mark", "start"]
    few = shared.filter(F.col("n") <= hot).drop("n").repartition("anchor").sortWithinPartitions(*place).mapInArrow(_compare(window, within), _HIT)
    many = shared.filter(F.col("n") > hot).drop("n").repartition("anchor", "doc", "mark").sortWithinPartitions(*place).mapInArrow(_apart(), _WINDOW)
    first = many.groupBy("anchor", "print").agg(F.min(F.struct("doc", "mark", "start")).alias("first"))
    earlier = F.col("first.doc") < F.col("doc")
    if within:
        first_own = F.struct("doc", "mark", F.col("own").alias("start"))
        found = many.join(first, ["anchor", "print"]).filter(earlier | (F.col("own") < F.col("start"))).withColumn("first", F.when(earlier, F.col("first")).otherwise(first_own))
    else:
        found = many.join(first, ["anchor", "print"]).filter(earlier)
    return few.unionByName(
        found.select("doc", "mark", "start", (F.col("start") + window).alias("end"), F.col("first.doc").alias("of_doc"), F.col("first.mark").alias("of_mark"), F.col("first.start").alias("of_start"))
    )


def parse(found: list[dict], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Factors (start, end, of_doc, of_mark, of_start) of one text from left to right, as long as the reference goes on.

    found: runs of its windows, of which no two hold the same window.
    """
    at: tuple | None = None
    for run in sorted(found, key=lambda r: r["start"]):
        source = (run["of_doc"], run["of_mark"], run["of_start"] - run["start"])
        if at is not None and at[2] == source and at[1] - window + 1 == run["start"]:
            at = (at[0], run["end"], source)
            continue
        if at is not None:
            yield at[0], at[1], at[2][0], at[2][1], at[2][2] + at[0]
        at = (run["start"], run["end"], source)
    if at is not None:
        yield at[0], at[1], at[2][0], at[2][1], at[2][2] + at[0]


_CLAIM = "of_doc long, of_mark long, block long, doc long, mark long, start long, end long, of_start long, words binary"


def _claims(units: Units, window: int, block: int):
    """Factors with their units, cut where a block of the reference ends. What repeats its own text is compared here."""
    sep = units.sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = []
                for doc, mark, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "runs")), strict=True):
                    words = units.split(text)
                    for start, end, of_doc, of_mark, of_start in parse(found, window):
                        if (of_doc, of_mark) == (doc, mark):
                            same = [words[start + i : start + i + window] == words[of_start + i : of_start + i + window] for i in range(end - start - window + 1)]
                            out += [(of_doc, of_mark, None, doc, mark, start + i, start + i + window, of_start + i, None) for i, equal in enumerate(same) if equal]
                            continue
                        shift, last = of_start - start, end - window
                        while start <= last:
                            number = (start + shift) // block
                            until = min(last, (number + 1) * block - 1 - shift)
                            out.append((of_doc, of_mark, number, doc, mark, start, until + window, start + shift, sep.join(words[start : until + window])))
                            start = until + 1
                if out:
                    *numbers, texts = zip(*out, strict=True)
                    yield _batch([*(pa.array(c, pa.int64()) for c in numbers), pa.array(texts, pa.binary())], _CLAIM)
        give_back()

    return run


_BLOCK = "of_doc long, of_mark long, block long, reference binary"


def _blocks(units: Units, window: int, block: int):
    """The blocks of the reference that are asked for, once for each row of docs in a task."""
    sep = units.sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = []
                for doc, mark, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "wanted")), strict=True):
                    if (doc, mark) in seen:
                        continue
                    seen.add((doc, mark))
                    words = units.split(text)
                    out += [(doc, mark, number, sep.join(words[number * block : (number + 1) * block + window - 1])) for number in wanted]
                if out:
                    *numbers, texts = zip(*out, strict=True)
                    yield _batch([*(pa.array(c, pa.int64()) for c in numbers), pa.array(texts, pa.binary())], _BLOCK)
        give_back()

    return run


def _held(reference: Column, words: Column, sep: str) -> Column:
    """Whether the reference holds these units one after another."""
    return F.contains(F.concat(F.lit(sep), reference, F.lit(sep)), F.concat(F.lit(sep), words, F.lit(sep)))


def dealt(rows: DataFrame) -> DataFrame:
    """rows by doc and mark: what joins the same rows in one query shares this exchange."""
    return rows.repartition("doc", "mark")


def factors(rows: DataFrame, units: Units, window: int, gram: int, within: bool, hot: int = HOT, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Factors (doc, mark, start, end, of_doc, of_mark, of_start): units start..end of a row repeat those from of_start on.

    rows: doc (order of rows, not null), mark (a hash that tells rows of one doc apart), text (not null), any other
    columns. A window is repeated if an equal one starts in a row of smaller doc or, with ``within``, earlier in the same
    row. Factors are cut at the ends of blocks.

    Shuffled are the anchors' counts, one row per anchor, again those rows whose anchor occurs twice or more, the texts
    once (see dealt), and the units of factors and of the blocks that they name. A collision of hashes can hide a repeat
    behind windows that differ, with a chance of 2 ** -bits for two windows of one anchor; it never makes one, as all
    units of a factor are compared, and of a factor that differs each window by itself.
    """
    found = cut(runs(rows.select("doc", "mark", "text"), units, window, gram, within, hot, bits))
    by_row = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end", "of_doc", "of_mark", "of_start")).alias("runs"))
    claims = dealt(rows).join(by_row, ["doc", "mark"]).mapInArrow(_claims(units, window, block), _CLAIM).withColumn("words", F.col("words").cast("string"))
    other = found.filter((F.col("of_doc") != F.col("doc")) | (F.col("of_mark") != F.col("mark")))
    last = F.col("of_start") + F.col("end") - F.col("start") - window
    numbers = F.explode(F.sequence(F.floor(F.col("of_start") / block), F.floor(last / block))).alias("block")
    wanted = other.select(F.col("of_doc").alias("doc"), F.col("of_mark").alias("mark"), numbers).distinct().groupBy("doc", "mark").agg(F.collect_list("block").alias("wanted"))
    reference = dealt(rows).join(wanted, ["doc", "mark"]).mapInArrow(_blocks(units, window, block), _BLOCK).withColumn("reference", F.col("reference").cast("string"))
    # many factors name one block; the skewed join splits them
    met = claims.join(reference, ["of_doc", "of_mark", "block"], "left")
    words, held = F.split("words", units.sep), F.col("block").isNull() | _held(F.col("reference"), F.col("words"), units.sep)
    one = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.struct(i.cast("long").alias("i"), F.array_join(F.slice(words, i + 1, window), units.sep).alias("w")))
    alone = F.transform(F.filter(one, lambda x: _held(F.col("reference"), x["w"], units.sep)), lambda x: F.struct((F.col("start") + x["i"]).alias("start"), (F.col("start") + x["i"] + window).alias("end"), (F.col("of_start") + x["i"]).alias("of_start")))
    equal = met.select("doc", "mark", "of_doc", "of_mark", F.explode(F.when(held, F.array(F.struct("start", "end", "of_start"))).otherwise(alone)).alias("f"))
    return equal.select("doc", "mark", "f.start", "f.end", "of_doc", "of_mark", "f.of_start")
