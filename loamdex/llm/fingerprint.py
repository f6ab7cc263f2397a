"""Document fingerprints from prefix polynomial hashes.

A text's prefix array modulo a prime answers equality of any two spans in constant time, and a binary search over
span lengths finds the longest common extension of two positions. A fingerprint is the text's length, its hash
modulo two primes, and a sketch of the hashes of all its short spans, which the same prefix array yields.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import in_shards, order_key

PRIMES = (2147483647, 2147483629)
BASES = (1000003697, 1220703133)
SPAN = 16
BINS = 64
_CHUNK = 1 << 20
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo prime, kept for the longest text so far up to a chunk."""
    have = _POWERS.get((base, prime))
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.int64) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, have * pow(base, len(have), prime) % prime])
        _POWERS[base, prime] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHashes:
    """Prefix arrays of one text modulo both primes; built chunk by chunk, they take eight bytes a code point."""

    def __init__(self, text: str):
        codes = code_points(text)
        self.n = len(codes)
        self.prefix = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            out = np.zeros(self.n + 1, dtype=np.uint32)
            total = 0
            for at in range(0, self.n, _CHUNK):
                part = codes[at : at + _CHUNK].astype(np.int64) + 1
                terms = part * _powers(base, prime, len(part)) % prime
                if at:
                    terms = terms * pow(base, at, prime) % prime
                sums = (np.cumsum(terms) + total) % prime
                out[at + 1 : at + 1 + len(part)] = sums
                total = int(sums[-1])
            self.prefix.append(out)

    def span(self, start: int, length: int) -> tuple[int, int]:
        """Hash of a span, the same wherever an equal span stands."""
        return tuple(
            (int(p[start + length]) - int(p[start])) * pow(base, -start, prime) % prime
            for p, base, prime in zip(self.prefix, BASES, PRIMES, strict=True)
        )

    def same(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        """Whether the spans are equal; both sides are shifted to a common power, so nothing is divided."""
        for a, b, base, prime in zip(self.prefix, other.prefix, BASES, PRIMES, strict=True):
            x = (int(a[start + length]) - int(a[start])) * pow(base, at, prime)
            y = (int(b[at + length]) - int(b[at])) * pow(base, start, prime)
            if (x - y) % prime:
                return False
        return True

    def common(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common extension to the right of the two positions."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(start, other, at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def sketch(self, span: int = SPAN, bins: int = BINS) -> bytes:
        """For each of the bins the low byte of the least span hash dealt to it, 1 to 255; 0 for an empty bin."""
        span = min(span, self.n)
        least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        if span:
            base, prime, p = BASES[0], PRIMES[0], self.prefix[0]
            inverse = pow(base, -1, prime)
            for at in range(0, self.n - span + 1, _CHUNK):
                count = min(_CHUNK, self.n - span + 1 - at)
                diff = p[at + span : at + span + count].astype(np.int64) - p[at : at + count].astype(np.int64)
                diff %= prime
                diff = diff * _powers(inverse, prime, count) % prime
                if at:
                    diff = diff * pow(inverse, at, prime) % prime
                mixed = diff.astype(np.uint64) + np.uint64(span)
                mixed = (mixed ^ (mixed >> np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                if count > 64 * bins:
                    # a bin's least is almost surely far below this; bins left empty are then done in full
                    low = mixed[(mixed >> np.uint64(6)) < np.uint64(1 << 58) // np.uint64(max(1, count // (16 * bins)))]
                    if len(np.unique(low & np.uint64(bins - 1))) == bins:
                        mixed = low
                np.minimum.at(least, (mixed & np.uint64(bins - 1)).astype(np.int64), mixed)
        low = ((least >> np.uint64(6)) % np.uint64(255)).astype(np.uint8) + 1
        low[least == np.iinfo(np.uint64).max] = 0
        return low.astype(np.uint8).tobytes()

    def fingerprint(self) -> str:
        whole = "".join(f"{int(p[-1]):08x}" for p in self.prefix)
        return f"{self.n:x}-{whole}-{self.sketch().hex()}"


def fingerprint(text: str) -> str:
    return PrefixHashes(text).fingerprint()


def likeness(one: str, other: str) -> float:
    """0 to 1: the share of common spans (Dice) that the sketches estimate; 1 for equal fingerprints alone."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x.rpartition("-")[2]), dtype=np.uint8) for x in (one, other))
    used = (a > 0) | (b > 0)
    if not used.any():
        return 0.0
    jaccard = max(0.0, (float(((a == b) & used).sum() / used.sum()) - 1 / 255) / (1 - 1 / 255))
    return min(0.999, round(2 * jaccard / (1 + jaccard), 6))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by as many from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edit_at long"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {c.split()[0]: [] for c in _SCHEMA.split(", ")}
    kinds = pa.schema([(k, pa.string() if "sha" in k or "print" in k else pa.float64() if "near" in k else pa.int64()) for k in out])
    held, done = None, False

    def flush():
        batch = pa.RecordBatch.from_pydict(out, schema=kinds)
        for column in out.values():
            column.clear()
        return batch

    for batch in batches:
        for doc_id, text, borrowed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "borrowed")), strict=True):
            if done:
                continue
            text = text or ""
            hashes = PrefixHashes(text)
            own = hashes.fingerprint()
            if held:
                last_id, last_text, last_hashes, last_own = held
                changed = edited(last_text, text)
                changed_hashes = PrefixHashes(changed)
                changed_own = changed_hashes.fingerprint()
                row = (
                    last_id,
                    len(last_text),
                    hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    last_own,
                    changed_own,
                    likeness(last_own, changed_own),
                    likeness(last_own, own),
                    last_hashes.common(0, changed_hashes, 0),
                )
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            held, done = (doc_id, text, hashes, own), borrowed
        if out["doc_id"]:
            yield flush()


def fingerprints(docs: DataFrame, rows_per_shard: int = 4096) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness.

    docs: doc_id, text; other columns are ignored. A null text is the empty text. Rows are taken in ascending
    doc_id (null first, ties by a hash of the text, then by the text), and the last is followed by the first. The empty
    text's fingerprint has length 0 and an empty sketch; it is like itself (1) and unlike all others (0). Repeated rows
    count as rows of their own. An empty table gives no rows. edit_at is the longest common extension of text and edited text.

    One shuffle carries each text once, to the shard of its doc_id range; the first row of every shard is sent to
    the shard before as well, so a row meets the next without a global window.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, bounds = in_shards(rows.withColumns({"_key": order_key(F.col("doc_id")), "_tie": F.xxhash64("text")}), "_key", "_tie", rows_per_shard)
    n = max(1, len(bounds))
    # the first row of a shard has its bound as key
    first = {i: (key, None) for i, (key, _) in enumerate(bounds or [(0, 0)])}
    if len({key for key, _ in bounds}) < len(bounds):
        # shards of one doc_id: their first rows, of those that have any, are looked up; one row of numbers for each shard
        heads = rows.groupBy("_shard").agg(F.min(F.struct("_key", "_tie")).alias("head")).collect()
        first = {r["_shard"]: tuple(r["head"]) for r in heads}
    live = sorted(first)
    before = dict(zip(live, [live[-1], *live[:-1]], strict=True))
    by_shard = lambda values: F.get(F.lit([values.get(i, 0) for i in range(n)]), F.col("_shard"))
    head = by_shard({i: key for i, (key, _) in first.items()}) == F.col("_key")
    if any(tie is not None for _, tie in first.values()):
        head = head & (by_shard({i: tie for i, (_, tie) in first.items()}) == F.col("_tie"))
    own = F.struct(F.col("_shard").alias("shard"), F.lit(False).alias("borrowed"))
    also = F.struct(by_shard(before).alias("shard"), F.lit(True).alias("borrowed"))
    dealt = (
        rows.withColumn("_to", F.explode(F.when(head, F.array(own, also)).otherwise(F.array(own))))
        .select("_key", "_tie", "doc_id", "text", F.col("_to.shard").cast("int").alias("_shard"), F.col("_to.borrowed").alias("borrowed"))
        .repartitionById(n, "_shard")
        .sortWithinPartitions("borrowed", "_key", "_tie", "text")
        .select("doc_id", "text", "borrowed")
    )
    return dealt.mapInArrow(_compare, _SCHEMA)
