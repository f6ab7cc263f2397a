"""Near duplicates by SimHash, with keys from a Golay code.

A 64-bit fingerprint is cut into four segments of 16 bits. Of two fingerprints that differ in at most three bits, at
most one segment holds two or more errors and at least one holds none. Take the segments in a ring: whichever they are,
some segment without error is followed by one with at most one error. So a key is a segment as it is, and the next one
made fuzzy by the binary Golay code (23 bits, distance 7): a word within radius 2 of its nearest codeword has that
codeword's index as its key; one at radius 3 also has those of the five codewords at distance 4. Words one bit apart
then always share an index, and a fingerprint has 4 to 24 keys. Fingerprints that share a key are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import cut, give_back
from loamdex.llm.components import components

RADIUS = 3
#: Fingerprints of one key that a task compares at once; a key with more is split into pairs of blocks.
BLOCK = 2048
_GENERATOR = 0b101011100011


def _syndrome(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, _GENERATOR << (bit - 11), 0)
    return words


@cache
def _coset_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less, and for those of weight 3 the five of weight 4, else zeros; and syndromes of the upper bits."""
    ones = [0] + [1 << i for i in range(23)]
    # every syndrome has one error pattern of weight 3 or less: the code is perfect
    patterns = np.array(sorted({a ^ b ^ c for a in ones for b in ones for c in ones}), dtype=np.int64)
    leader = np.zeros(2048, dtype=np.int64)
    leader[_syndrome(patterns)] = patterns
    fours = np.array([sum(1 << i for i in c) for c in combinations(range(23), 4)], dtype=np.int64)
    order = np.argsort(_syndrome(fours), kind="stable")
    others = np.zeros((2048, 5), dtype=np.int64)
    heavy, first, count = np.unique(_syndrome(fours)[order], return_index=True, return_counts=True)
    for s, at, n in zip(heavy.tolist(), first.tolist(), count.tolist(), strict=True):
        if bin(int(leader[s])).count("1") == 3:
            others[s, :n] = fours[order[at : at + n]]
    return leader, others, _syndrome(np.arange(1 << 12, dtype=np.int64) << 11)


def fuzzy(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of words of up to 23 bits, -1 where there are fewer."""
    leader, others, upper = _coset_tables()
    synd = upper[words >> 11] ^ (words & 0x7FF)
    more = others[synd]
    return np.concatenate([((words ^ leader[synd]) >> 11)[:, None], np.where(more > 0, (words[:, None] ^ more) >> 11, -1)], axis=1)


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word, padded with zeros to 23 bits: its indices (n, 6) and how many of them it has."""
    keys = fuzzy(np.arange(1 << 16, dtype=np.int64))
    return keys, (keys >= 0).sum(axis=1)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in prints, key) of every key of unsigned 64-bit fingerprints."""
    table, _ = golay_tables()
    rows, keys = [], []
    parts = [((prints >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    for i in range(4):
        fuzzy = table[parts[(i + 1) % 4]]
        whole = (fuzzy & 0xFFF) | (parts[i] << 12)[:, None] | (i << 28)
        at, column = np.nonzero(fuzzy >= 0)
        rows.append(at)
        keys.append(whole[at, column])
    return np.concatenate(rows), np.concatenate(keys)


def simhash(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    elif shingle == 3:
        hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)))]
    return print_of(hashes)


def print_of(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        # sums of 255 bits fit a byte
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(prints.view(np.int64))], names=[*(c for c in batch.schema.names if c != "text"), "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and print (the 64 bits as a signed long) of every row. A null text is the empty text, whose print is 0."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_prints(shingle), ", ".join([*kinds, "print long"]))


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False)
        rows, keys = keys_of(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], names=["k", "print"])


_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    out = _BITS[(x & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int16)
    for i in (16, 32, 48):
        out += _BITS[((x >> np.uint64(i)) & np.uint64(0xFFFF)).astype(np.int64)]
    return out


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within radius that connect what all links within radius connect: at most one fewer than prints.

    A breadth-first walk over rows that no walk has met; each row is compared with those still unmet, once.
    """
    unmet = np.sort(prints)
    links = []
    while len(unmet):
        front, unmet = [unmet[0]], unmet[1:]
        while front and len(unmet):
            at = front.pop()
            near = distance(unmet, np.uint64(at)) <= radius
            if near.any():
                found = unmet[near]
                unmet = unmet[~near]
                front.extend(found)
                links.extend((int(x), int(at)) for x in found)
    return links


def _link_groups(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prints")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            out: set[tuple[int, int]] = set()
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]
            a, b = values[two], values[two + 1]
            near = distance(a, b) <= radius
            out.update(zip(a[near].tolist(), b[near].tolist(), strict=True))
            for k in np.flatnonzero(sizes > 2):
                out.update(forest(np.unique(values[offsets[k] : offsets[k + 1]]), radius))
            links = np.array(list(out), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1]))], names=["u", "v"])

    return run


def print_links(distinct_prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) of distinct prints that connect all prints within radius, found by Golay keys.

    A key held by more than ``block`` prints is split: its prints are dealt to blocks by hash, and every pair of blocks
    is compared by a task of its own, so no task holds more than about two blocks and no pair is left out.
    """
    if radius > RADIUS:
        raise ValueError("the keys guarantee pairs of up to 3 differing bits")
    keyed = distinct_prints.select("print").mapInArrow(_emit_keys, "k long, print long")
    held = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keyed.join(held, "k")
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("print"), parts).cast("int")
    # with b parts, a print of part p goes to the pairs (p, q) and (q, p), q any part
    pairs = F.when(parts <= 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.least(mine, q) * parts + F.greatest(mine, q))
    )
    rows = rows.withColumn("pair", F.explode(pairs))
    # at most about two blocks of eight bytes each in a group
    groups = rows.groupBy("k", "pair").agg(F.collect_list("print").alias("prints")).filter(F.size("prints") > 1).select("prints")
    return groups.mapInArrow(_link_groups(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, print and component_id (the least doc_id reachable over links) of every row.

    docs: doc_id, text; other columns are ignored. Texts are lower-cased in A-Z and split at ASCII white space; shingles
    are counted with repeats. A text of fewer words than a shingle is one shingle; without words (null, empty, blank)
    its print is 0, linked like any other. Rows with equal prints are one class from the start, so copies cost one key
    set. A row whose doc_id is null has its component's least doc_id, or null if there is none. No rows give no rows.

    Only prints are shuffled, never texts. Hot prints meet by partial aggregation, hot keys are split into blocks.
    """
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(print_links(classes, radius))
    grouped = classes.join(roots, classes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = grouped.join(least, "root").select("print", "component_id")
    return prints.join(by_print, "print").select("doc_id", "print", "component_id")


#: 64-bit parts of a print of bits_at.
PARTS = 8
#: Least buckets of the counts that bound how many shingles two texts share; doubled until a bucket has two at most on average.
BUCKETS = 256
#: Sets of a list up to which its pairs are bounded one by one, and up to which they are then lists of their own, so
#: that a pair that meets in many lists is compared once. Longer lists are compared whole.
SOME, FEW = 256, 16
#: One row in so many counts for the order of shingles, and most shingles that the order knows; the order changes what is
#: compared, never what is found.
SAMPLE, KNOWN = 16, 1 << 20
#: Bits of a prefix key that hold the size of its set, at most; one more is the last, the others are the first of the hash.
SIZE_BITS = 24
MOST_SIZE = (1 << SIZE_BITS) - 1


def bits_at(similarity: float, slack: float = 1.0) -> int:
    """Bits of the deciding print in which sets of this Jaccard similarity differ on average, plus slack spreads."""
    cosine = 2 * similarity / (1 + similarity)
    p = float(np.arccos(cosine) / np.pi)
    n = 64 * PARTS
    return int(n * p + slack * np.sqrt(n * p * (1 - p)))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; of a text without words the hash of nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found = {b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))} if len(words) > shingle else {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found)))


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first hashes of a set in an order of all hashes, rare before common, so many that sets of this Jaccard similarity share one.

    Such sets share at least similarity * n of the hashes of each, so the n - ceil(similarity * n) + 1 first of both
    have one in common, whatever the order. common: ascending hashes that come last, with their counts.
    """
    n = len(hashes)
    keep = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, times[at], 0)))]
    return hashes[:keep]


def bucket_counts(hashes: np.ndarray) -> np.ndarray:
    """Hashes of a set by bucket; all 255 if a count reaches 255."""
    bits = (BUCKETS - 1).bit_length()
    while len(hashes) > 2 << bits:
        bits += 1
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.full(1 << bits, 255, dtype=np.uint8) if counts.max() >= 255 else counts.astype(np.uint8)


def _similar(shared: np.ndarray, one: int, others: np.ndarray, similarity: float) -> np.ndarray:
    return shared * (1 + similarity) >= similarity * (one + others) - 1e-6


def hopeful(sizes: np.ndarray, counts: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """For each set the later ones that can be as similar as this to it: two sets share at most the sum of the lesser counts."""
    out = []
    for i, mine in enumerate(counts):
        later = np.arange(i + 1, len(sizes))
        later = later[_similar(np.minimum(sizes[later], sizes[i]), int(sizes[i]), sizes[later], similarity)]
        most = np.zeros(len(later), dtype=np.int64)
        for j, k in enumerate(later.tolist()):
            one, other = sorted((mine, counts[k]), key=len)
            if one[0] == other[0] == 255 or len(other) > 4 * len(one):
                most[j] = sizes[i] + sizes[k]
                continue
            if one[0] == 255:
                most[j] = sizes[i] if other is mine else sizes[k]
                continue
            if other[0] == 255:
                most[j] = sizes[k] if one is counts[k] else sizes[i]
                continue
            one, other = one.astype(np.int32), other.astype(np.int32)
            while len(other) > len(one):
                other = other[::2] + other[1::2]
            most[j] = np.minimum(one, other).sum()
        out.append(later[_similar(most, int(sizes[i]), sizes[later], similarity)])
    return out


def set_forest(sigs: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of sets whose Jaccard similarity is this or more, enough to connect all such sets."""
    if len(sets) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(sigs[0]), int(sigs[1]))] if _similar(shared, len(sets[0]), len(sets[1]), similarity) else []
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    of = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(len(known), dtype=bool)
    unmet, links = np.arange(1, len(sets)), []
    # of held sets, some of which are met, all hashes stand in a row; they are laid out anew when half are met
    held = np.zeros(0, dtype=np.int64)
    front = [0]
    while len(unmet):
        if not front:
            front, unmet = [int(unmet[0])], unmet[1:]
            continue
        if not len(held) or 2 * len(unmet) < len(held):
            held = unmet
            row, starts = np.concatenate([of[i] for i in held.tolist()]), np.cumsum(sizes[held]) - sizes[held]
        at = front.pop()
        mark[of[at]] = True
        shared = np.add.reduceat(mark[row], starts, dtype=np.int64)[np.searchsorted(held, unmet)]
        mark[of[at]] = False
        near = _similar(shared, int(sizes[at]), sizes[unmet], similarity)
        found, unmet = unmet[near], unmet[~near]
        front.extend(found.tolist())
        links.extend((int(sigs[x]), int(sigs[at])) for x in found)
    return links


def _all_shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [shingle_set(t, shingle) for t in whole.column("text").slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    return run


def common_shingles(rows: DataFrame, shingle: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that three rows or more of a sample hold, ascending, and their counts; the most frequent KNOWN at most."""
    some = rows.filter(F.pmod(F.xxhash64("mark", "doc"), F.lit(sample)) == 0)
    counted = cut(some.select("text").mapInArrow(_all_shingles(shingle), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3"))
    least, total = 3, 0
    for n, times in counted.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        total += times
        if total > KNOWN:
            least = n + 1
            break
    found = counted.filter(F.col("n") >= least).toArrow()
    hashes, times = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def _sketches(shingle: int, similarity: float, common: np.ndarray, times: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, prints, firsts, counts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, shingle)
                sigs.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                prints.append(print_of(hashes))
                firsts.append(prefix(hashes, similarity, common, times).tobytes())
                counts.append(bucket_counts(hashes).tobytes())
            signed, signed_prints = (np.array(x, dtype=np.uint64).view(np.int64) for x in (sigs, prints))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), pa.array(signed), pa.array(sizes, pa.int64()), pa.array(signed_prints), pa.array(firsts, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc", "mark", "sig", "size", "print", "first", "counts"],
            )
        give_back()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(sets, pa.binary())], names=["sig", "hashes"])
        give_back()

    return run


def _prefix_keys(similarity: float):
    """k: the first bits of a hash of a set's prefix, the set's size, and 0 if the hash is one of those that the lesser set of a pair needs.

    Hashes cut short may put more sets together, never fewer. Of sets of m and n >= m hashes that are similar, at least
    2 * similarity / (1 + similarity) * m are shared, so the lesser one shares a hash of a prefix of m - that + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                firsts, sizes = batch.column("first").to_pylist(), batch.column("size").to_numpy()
                times = np.array([len(x) // 8 for x in firsts], dtype=np.int64)
                short = sizes - np.ceil(2 * similarity / (1 + similarity) * sizes - 1e-6).astype(np.int64) + 1
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                later = (place >= np.repeat(short, times)).astype(np.int64)
                keys = np.frombuffer(b"".join(firsts), dtype=np.int64) >> (SIZE_BITS + 1) << (SIZE_BITS + 1)
                keys = keys | np.repeat(np.minimum(sizes, MOST_SIZE), times) << 1 | later
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("sig").to_numpy(), times))], names=["k", "sig"])

    return run


def _runs(key: str, batches: Iterator[pa.RecordBatch], drop: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by key, without its last ``drop`` bits, and the groups' bounds; a group that goes on is held back."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts)
        keys = table.column(key).to_numpy() >> drop
        return table, np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy() >> drop
        differ = np.flatnonzero(keys != keys[-1])
        last = int(differ[-1]) + 1 if len(differ) else 0
        if held and held[-1].column(key)[-1].as_py() >> drop != keys[0]:
            yield whole(held)
            held = []
        if last:
            yield whole([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield whole(held)


def _listed(lists: list[np.ndarray]) -> pa.RecordBatch:
    """(list, sig) of every member; lists of the same members have the same name."""
    named = {xxhash.xxh64_intdigest(x.tobytes()): x for x in lists}
    names = np.repeat(np.array(list(named), dtype=np.uint64).view(np.int64), [len(x) for x in named.values()])
    members = np.concatenate([*named.values(), np.zeros(0, dtype=np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(members)], names=["list", "sig"])


def _lists(block: int, similarity: float):
    """Of rows sorted by k, sig the sets that share a hash and are of similar size; of more than block sets, those of each pair of blocks.

    Within a hash sets stand by size, and are parted where a size is under similarity times the next: no similar pair is.
    A set that needs a lesser one beside it (_prefix_keys) and has none goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _runs("k", batches, SIZE_BITS + 1):
            sigs, keys = table.column("sig").to_numpy(), table.column("k").to_numpy()
            hashes, sizes, lesser = keys >> (SIZE_BITS + 1), keys >> 1 & MOST_SIZE, keys & 1 == 0
            before = np.maximum.accumulate(np.where(lesser, np.arange(len(keys)), 0))
            kept = lesser | (lesser[before] & (hashes[before] == hashes) & (sizes[before] >= similarity * sizes - 1e-6))
            sigs, hashes, sizes = sigs[kept], hashes[kept], sizes[kept]
            if not len(sigs):
                continue
            starts = np.append((hashes[1:] != hashes[:-1]) | (sizes[:-1] < similarity * sizes[1:] - 1e-6), True)
            bounds, out = np.append(0, np.flatnonzero(starts) + 1), []
            for a, b in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist(), strict=True):
                if b - a <= block:
                    out.append(np.sort(sigs[a:b]))
                    continue
                parts = np.array_split(np.arange(a, b), -(-(b - a) // block))
                for p, q in combinations(parts, 2):
                    if sizes[p[-1]] < similarity * sizes[q[0]] - 1e-6:
                        continue
                    out.append(np.sort(sigs[np.concatenate([p, q])]))
                    if len(out) >= 64:
                        yield _listed(out)
                        out = []
            yield _listed(out)

    return run


def _hopeful(similarity: float):
    """Of lists the sets that may be similar to another that no link was found to yet: by their sizes and counts, and their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _runs("list", batches):
            sigs, sizes, roots = (table.column(c).to_numpy() for c in ("sig", "size", "root"))
            counts = [np.frombuffer(x, dtype=np.uint8) for x in table.column("counts").to_pylist()]
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if (roots[a:b] == roots[a]).all():
                    continue
                if b - a > SOME:
                    out.append(sigs[a:b])
                    continue
                pairs = [(a + i, a + j) for i, near in enumerate(hopeful(sizes[a:b], counts[a:b], similarity)) for j in near.tolist() if roots[a + i] != roots[a + j]]
                if b - a <= FEW or len(pairs) <= 2 * (b - a):
                    out += [sigs[[i, j]] for i, j in pairs]
                else:
                    out.append(sigs[sorted({i for pair in pairs for i in pair})])
            yield _listed(out)

    return run


def _set_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _runs("list", batches):
            sigs, hashes = table.column("sig").to_numpy(), table.column("hashes").to_pylist()
            out: set[tuple[int, int]] = set()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out.update(set_forest(sigs[a:b], [np.frombuffer(x, dtype=np.uint64) for x in hashes[a:b]], similarity))
            links = np.array(list(out), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1]))], names=["u", "v"])
        give_back()

    return run


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with doc (doc_id, null as the greatest) and mark (a hash of the text), which together name a row."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "mark": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def likely(rows: DataFrame, few: DataFrame, words: int = 1 << 18, on: tuple[str, ...] = ("doc", "mark"), others: bool = False) -> DataFrame:
    """rows whose keys may be among those of few, by a bitmap of 64 * words bits at most, so that the rest is not shuffled; others: that rest."""
    code = f"xxhash64({', '.join(on)})"
    place = {"_word": F.expr(f"cast(pmod({code}, {words}L) as int)"), "_bit": F.expr(f"shiftleft(1L, cast(shiftrightunsigned({code}, 58) as int))")}
    bits = few.withColumns(place).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    # a row for each word: its size is bounded whatever the tables hold
    found = rows.withColumns(place).join(F.broadcast(bits), "_word", "left" if others else "inner")
    met = F.col("_bits").bitwiseAND(F.col("_bit")) != 0
    return found.filter(~F.coalesce(met, F.lit(False)) if others else met).select(rows.columns)


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """doc, mark (with_keys), component_id and stays: documents whose shingle sets have this Jaccard similarity or more are linked.

    First SimHash: prints of the sets of distinct shingles, taken by their 64-bit hashes, meet within 3 bits by their Golay
    keys. Each link is checked on the whole sets, and what holds makes groups. As 3 bits only meet sets that are almost equal,
    an exact join of the sets finds the rest: sets of this similarity share a hash of their prefixes, and sets that share one
    and are not in one group yet are compared in full, unless their sizes or counts by bucket show that they share too few.

    docs: doc_id, text; other columns are ignored. Case of A-Z and white space don't count. Texts without words are one
    group. Rows with equal sets are one class before keys are made. Sets that share a key are a list; a key of many sets
    makes lists of pairs of blocks, and lists of the same sets are compared once. Of a group the least doc, then mark,
    stays; its doc is the component_id. A null doc_id comes last. Rows that are equal in doc_id and text stay or go
    together. No rows give no rows.
    """
    texts = with_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc", "mark", "text")
    rows = cut(texts.mapInArrow(_sketches(shingle, similarity, *common_shingles(texts, shingle)), "doc long, mark long, sig long, size long, print long, first binary, counts binary"))
    classes = cut(rows.groupBy("sig").agg(F.min(F.struct("doc", "mark")).alias("least"), F.first("print").alias("print"), F.count(F.lit(1)).alias("n")))

    def checked(lists: DataFrame) -> DataFrame:
        """Links of the similar sets of each list."""
        asked = lists.select("sig").distinct().join(classes, "sig").select("sig", F.col("least.doc").alias("doc"), F.col("least.mark").alias("mark"))
        sets = likely(texts, asked).join(asked, ["doc", "mark"]).groupBy("doc", "mark", "sig").agg(F.first("text").alias("text")).select("sig", "text").mapInArrow(_sets(shingle), "sig long, hashes binary")
        found = lists.join(sets, "sig").select("list", "sig", "hashes").repartition("list").sortWithinPartitions("list", "sig")
        return cut(found.mapInArrow(_set_links(similarity), "u long, v long").distinct())

    near = checked(_print_lists(classes))
    grouped = cut(components(near))
    # a class of one row needs no exchange of its prefix
    several = classes.filter("n > 1").select("sig")
    firsts = rows.select("sig", "size", "first")
    single, more = likely(firsts, several, on=("sig",), others=True), likely(firsts, several, on=("sig",))
    keyed = single.unionByName(more.groupBy("sig").agg(F.first("size").alias("size"), F.first("first").alias("first"))).mapInArrow(_prefix_keys(similarity), "k long, sig long")
    met = keyed.repartition(F.shiftright("k", SIZE_BITS + 1)).sortWithinPartitions("k", "sig").mapInArrow(_lists(block, similarity), "list long, sig long")
    lists = cut(met.distinct())
    counts = likely(rows.select("sig", "size", "counts"), lists.select("sig").distinct(), on=("sig",)).groupBy("sig").agg(F.first("size").alias("size"), F.first("counts").alias("counts"))
    counts = counts.join(grouped, F.col("sig") == F.col("node"), "left").select("sig", "size", "counts", F.coalesce("root", "sig").alias("root"))
    counted = lists.join(counts, "sig").select("list", "sig", "size", "counts", "root")
    lists = cut(counted.repartition("list").sortWithinPartitions("list", "sig").mapInArrow(_hopeful(similarity), "list long, sig long").distinct())
    roots = components(near.unionByName(checked(lists)))
    joined = classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    first = joined.groupBy("root").agg(F.min("least").alias("first"))
    found = rows.select("doc", "mark", "sig").join(joined.join(first, "root").select("sig", "first"), "sig")
    return found.select("doc", "mark", F.col("first.doc").alias("component_id"), (F.col("first") == F.struct("doc", "mark")).alias("stays"))


def _print_lists(classes: DataFrame) -> DataFrame:
    """Pairs of sets, as lists of two: sets of one print with the least of them, and the least ones of prints within 3 bits."""
    by_print = classes.groupBy("print").agg(F.min("sig").alias("sig"))
    same = classes.select("print", F.col("sig").alias("b")).join(by_print.withColumnRenamed("sig", "a"), "print").filter("a <> b").select("a", "b")
    links = print_links(by_print.select("print"))
    far = links.join(by_print.toDF("u", "a"), "u").join(by_print.toDF("v", "b"), "v").select("a", "b")
    pairs = same.unionByName(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cut(pairs.select(F.xxhash64("a", "b").alias("list"), F.explode(F.array("a", "b")).alias("sig")).distinct())
