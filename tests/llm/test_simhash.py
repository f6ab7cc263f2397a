import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loamdex.llm.components import components
from loamdex.llm import simhash as module
from loamdex.llm.simhash import likely, bits_at, forest, golay_tables, keys_of, near_copies, near_duplicates, print_links, simhash


def reference(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= radius:
            parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def expected(rows):
    prints = [(r[0], reference(r[1])) for r in rows]
    of = groups({p for _, p in prints})
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[of[p]] = min(doc, least.get(of[p], doc))
    return sorted(str((d, p, least.get(of[p]))) for d, p in prints)


def test_golay_code():
    keys, count = golay_tables()
    assert set(count) <= {1, 6}
    words = np.arange(1 << 16)
    for bit in range(16):
        a, b = keys[words], keys[words ^ (1 << bit)]
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_keys_meet_within_three_bits():
    rng = random.Random(4)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        a, b = (set(keys_of(np.array([v], dtype=np.uint64))[1].tolist()) for v in (x, y))
        assert a & b and 4 <= len(a) <= 24


def test_prints(odd, small):
    for _, rows in (odd, small):
        assert [simhash(r[1]) for r in rows] == [reference(r[1]) for r in rows]


def test_rows(odd, small, none):
    for docs, rows in (odd, small):
        got = sorted(str((r.doc_id, r["print"] % (1 << 64), r.component_id)) for r in near_duplicates(docs).collect())
        assert got == expected(rows)
    assert near_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [4, 2048])
def test_links_connect_hot_keys(spark, block):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(120):
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << b
        prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "print long")
    roots = {r.node: r.root for r in components(print_links(rows, block=block)).collect()}
    of = groups(prints)
    mine = [{q for q in signed if roots.get(q, q) == roots.get(p, p)} for p in signed]
    want = [{q for q in signed if of[q % (1 << 64)] == of[p % (1 << 64)]} for p in signed]
    assert mine == want
    assert len(forest(np.array(sorted(prints), dtype=np.uint64))) == len(prints) - len(set(of.values()))


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(100)] + [(300, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def jaccard(a, b, n=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_copies_are_caught_and_others_left(spark, odd, none):
    rng = random.Random(2)
    texts = []
    for _ in range(40):
        words = ["w%d" % rng.randint(0, 3000) for _ in range(rng.randint(60, 400))]
        for _ in range(3):
            edit = list(words)
            for _ in range(max(1, len(words) // 150)):
                edit[rng.randrange(len(edit))] = "new%d" % rng.randint(0, 999)
            texts.append(" ".join(edit))
        half = words[: len(words) // 2] + ["v%d" % rng.randint(0, 3000) for _ in range(len(words) // 2)]
        texts.append(" ".join(half))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.doc: r.component_id for r in near_copies(docs).collect()}
    close = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if a // 4 == b // 4 and jaccard(texts[a], texts[b]) >= 0.85]
    assert len(close) > 60
    assert sum(of[a] == of[b] for a, b in close) >= 0.97 * len(close)
    assert all(of[4 * k + 3] == 4 * k + 3 for k in range(40))
    rows = near_copies(odd[0]).collect()
    assert len(rows) == len(odd[1]) and {r.component_id for r in rows if r.doc in (1, 2, 7)} == {1}
    assert sum(r.stays for r in rows) >= len({r.component_id for r in rows})
    assert near_copies(none).collect() == []


def test_bits():
    assert bits_at(1.0) == 0 and bits_at(0.8, 0) == int(512 * np.arccos(1.6 / 1.8) / np.pi)


def linked(rows, similarity=0.8):
    """Brute force: the least doc of each component of pairs with this Jaccard similarity."""
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        if jaccard(s, t) >= similarity - 1e-9:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("block", [3, 2048])
def test_cut_appended_and_edited_copies_all_meet(spark, block):
    """Copies that gain or lose a contiguous part, just above the limit."""
    rng = random.Random(block)
    word = lambda: "w%d" % rng.randint(0, 5000)
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        words = [word() for _ in range(rng.randint(100, 300))] + passage
        n = len(words)
        texts += [words, words[: int(0.83 * n)], words[int(0.17 * n) :], words + ["x%d" % rng.randint(0, 10**6) for _ in range(int(0.21 * n))], words + words[: int(0.2 * n)]]
        edit = list(words)
        edit[::55] = ["e%d" % i for i in range(len(edit[::55]))]
        texts.append(edit)
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked(rows)
    assert len(set(want.values())) == 12
    assert {r.doc: r.component_id for r in near_copies(docs, block=block).collect()} == want


def test_pairs_under_the_limit_are_left(spark):
    """Scattered edits to a similarity from 0.74 to 0.795: no pair is a near copy, and at 0.8 or more all are."""
    rng = random.Random(7)
    rows = []
    for k in range(40):
        words = ["w%d" % rng.randint(0, 5000) for _ in range(240)]
        edit = list(words)
        at = 3
        while jaccard(" ".join(words), " ".join(edit)) >= 0.795:
            edit[at] = "e%d_%d" % (k, at)
            at += 39
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edit))]
    assert all(0.74 <= jaccard(rows[i][1], rows[i + 1][1]) < 0.795 for i in range(0, 80, 2))
    got = {r.doc: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in rows}


def test_likely_rows_hold_all_that_are_asked_for(spark):
    rows = spark.range(20_000).selectExpr("id AS doc", "xxhash64(id) AS mark", "'t' AS text")
    few = rows.filter("doc % 97 = 5").select("doc", "mark")
    for words, most in ((1 << 18, 250), (64, 20_000), (1, 20_000)):
        found = likely(rows, few, words)
        assert found.columns == rows.columns and found.join(few, ["doc", "mark"]).count() == few.count() <= found.count() <= most
    assert likely(rows, few.limit(0)).count() == 0


def test_rows_that_are_not_likely_are_the_others(spark):
    rows = spark.range(5000).selectExpr("id AS doc", "xxhash64(id) AS mark")
    few = rows.filter("doc % 97 = 5").select("doc")
    for words in (1 << 18, 1):
        both = [likely(rows, few, words, ("doc",), others) for others in (False, True)]
        assert sorted(r.doc for x in both for r in x.collect()) == list(range(5000)) and both[1].join(few, "doc").count() == 0
    assert likely(rows, few.limit(0), on=("doc",)).count() == 0 and likely(rows, few.limit(0), on=("doc",), others=True).count() == 5000


def test_near_copies_meet_by_their_prints(spark, monkeypatch):
    """Without the join of prefixes almost equal texts still meet, by SimHash and Golay keys; links are checked on the sets."""
    rng = random.Random(11)
    words = [["w%d" % rng.randint(0, 10**6) for _ in range(2000)] for _ in range(10)]
    rows = [(2 * i, " ".join(w)) for i, w in enumerate(words)] + [(2 * i + 1, " ".join(w[:1000] + ["new"] + w[1001:])) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: d - d % 2 for d, _ in rows}
    assert {r.doc: r.component_id for r in near_copies(docs).collect()} == want

    def none(block, similarity):
        return lambda batches: (pa.RecordBatch.from_pydict({"list": pa.array([], pa.int64()), "sig": pa.array([], pa.int64())}) for _ in batches)

    monkeypatch.setattr(module, "_lists", none)
    assert {r.doc: r.component_id for r in near_copies(docs).collect()} == want


def test_prints_that_meet_are_checked_on_the_sets(spark):
    """Sets of one print or of prints within 3 bits are pairs of their own, which are compared as any other list."""
    classes = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 255 << 8), (5, 0)], "sig long, print long")
    got = module._print_lists(classes).collect()
    assert {tuple(sorted(r.sig for r in got if r.list == k)) for k in {r.list for r in got}} == {(1, 2), (1, 5), (1, 3)}
    # half of the shingles in common, in prints as near as can be
    assert module.set_forest(np.arange(2), [np.arange(10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)], 0.8) == []


@pytest.mark.parametrize("block", [3, 2048])
def test_every_similar_pair_is_in_a_list(block):
    """Sets of any sizes, with similarities on both sides of the limit; sets of unlike size share no list."""
    rng = np.random.default_rng(block)
    sets = []
    for n in (1, 2, 5, 9, 10, 40, 100, 300):
        for _ in range(6):
            base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            for lost, new in ((0, 0), (n // 10, n // 9), (n // 5, 0), (0, n // 4), (n // 9, n // 9)):
                sets.append(np.unique(np.concatenate([base[lost:], rng.integers(0, 1 << 64, new, dtype=np.uint64)])))
    common = np.unique(np.concatenate([x[:2] for x in sets]))
    sets = [np.unique(np.append(x, common[:3])) if len(x) > 30 else x for x in sets]
    firsts = [module.prefix(x, 0.8, common[:3], np.array([9, 8, 7])).tobytes() for x in sets]
    batch = pa.RecordBatch.from_pydict({"sig": pa.array(range(len(sets)), pa.int64()), "size": pa.array([len(x) for x in sets], pa.int64()), "first": pa.array(firsts, pa.binary())})
    keyed = pa.Table.from_batches(module._prefix_keys(0.8)([batch])).sort_by([("k", "ascending"), ("sig", "ascending")])
    lists = {}
    for part in module._lists(block, 0.8)(keyed.to_batches(max_chunksize=50)):
        for name, sig in zip(part["list"].to_pylist(), part["sig"].to_pylist(), strict=True):
            lists.setdefault(name, set()).add(sig)
    met = {pair for x in lists.values() for pair in itertools.combinations(sorted(x), 2)}
    shared = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    similar = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if shared(a, b) >= 0.8}
    assert len(similar) > 100 and similar <= met and len(met) < 8 * len(similar)


def test_prints_of_many_hashes():
    rng = np.random.default_rng(3)
    for n in (1, 254, 255, 256, 1000, 40_000):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > n)
        assert module.print_of(hashes) == module.print_of(hashes.tolist()) == want
