import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loamdex.llm.mixing import LEAST_BLOCKS, hypergeometric, mix, splitting_tree


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """Reshare by weight until none is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def check(docs, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = targets(sizes)
    got = mix(docs, block_words=500).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.passes)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s
    again = mix(docs.repartition(5), block_words=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_and_quotas(odd, small):
    check(*small)
    # the sums hold with repeated rows too, but which of equal rows is cut is free
    docs, rows = odd
    check(docs.dropDuplicates(["doc_id", "text"]), list(dict.fromkeys(rows)))


def test_repeated_rows_and_no_rows(spark, none):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(2, "d", "t")], "doc_id long, text string, source string")
    got = mix(docs).collect()
    # t stops at twice its one word, s takes the rest of 150 %
    assert len(got) == 6 and sum(r.taken for r in got) == 24 and max(r.taken for r in got if r.source == "t") == 2
    assert mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mix(blank).collect()] == [0, 0]


def test_tree_is_exact_and_fair(spark):
    counts = [40, 0, 24, 100]
    one = spark.createDataFrame([(counts,)], "counts array<long>")
    leaves = splitting_tree(one, 3).collect()
    assert len(leaves) == 8
    assert [sum(r.counts[i] for r in leaves) for i in range(4)] == counts
    assert {sum(r.counts) for r in leaves} <= {20, 21}
    # over seeds, a child's share of a source has the hypergeometric mean and variance
    left = [splitting_tree(one, 1, seed).filter("shard = 0").first().counts[0] for seed in range(40)]
    mean = sum(left) / len(left)
    spread = sum((x - mean) ** 2 for x in left) / len(left)
    want = 82 * (40 / 164) * (124 / 164) * (82 / 163)
    assert abs(mean - 20) < 1.8 and 0.4 * want < spread < 2 * want


def test_draws_follow_the_distribution(spark):
    """Inversion at a grid of u gives each outcome as often as it is likely, at the ends of its range too."""
    for n, k, d in ((10, 4, 5), (7, 7, 3), (9, 0, 4), (50, 45, 30), (12, 6, 12), (1, 1, 0), (3000, 40, 1500)):
        grid = 4000
        cases = spark.range(grid).select(((F.col("id") + 0.5) / grid).alias("u"), *[F.lit(x).cast("long").alias(c) for c, x in (("n", n), ("k", k), ("d", d))])
        got = {r.x: r["count"] for r in cases.groupBy(hypergeometric(F.col("u"), F.col("n"), F.col("k"), F.col("d")).alias("x")).count().collect()}
        for x in range(k + 1):
            chance = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) if 0 <= d - x <= n - k else 0
            assert abs(got.pop(x, 0) - grid * chance) <= 1.01
        assert not got
    big = spark.sql("SELECT 0.5D AS u, 20000000L AS n, 6000000L AS k, 10000000L AS d")
    assert abs(big.select(hypergeometric(F.col("u"), F.col("n"), F.col("k"), F.col("d"))).first()[0] - 3_000_000) < 4000


def test_shards_hold_what_the_leaves_say(small):
    """Every pass goes through the tree: items of each source in each shard are the tree's counts, and texts go whole."""
    got = mix(small[0], levels=2, block_words=10, seed=7).collect()
    items, blocks = defaultdict(set), defaultdict(set)
    order = sorted({r.source for r in got}, key=lambda s: (s is None, (s or "").encode()))
    for r in got:
        n = max(LEAST_BLOCKS, -(-r.source_size // 10))
        for i, p in enumerate(r.passes):
            # passes are in order, so a whole pass is known by its number, the partial one by what it takes
            number = i if i < r.copies else r.copies
            items[r.source, p.shard].add((r.key % n, number))
            blocks[r.source, r.key % n, number].add(p.shard)
        assert [p.words for p in r.passes] == [r.size] * r.copies * (r.size > 0) + [r.part] * (r.part > 0)
    assert all(len(x) == 1 for x in blocks.values())
    total = {s: sum(len(items[s, k]) for k in range(4)) for s in order}
    assert sum(total.values()) > 100 and any(r.copies > 0 for r in got)
    spark = small[0].sparkSession
    leaves = splitting_tree(spark.createDataFrame([([total[s] for s in order],)], "counts array<long>"), 2, 7).collect()
    assert {(s, r.shard): r.counts[i] for r in leaves for i, s in enumerate(order)} == {(s, k): len(items[s, k]) for s in order for k in range(4)}


def test_equal_rows_of_two_sources_are_two_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e", s) for s in ("s", "t", None)] + [(2, None, "u"), (2, "u", None)], "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len({r.key for r in got}) == 5 and sorted(r.taken for r in got if r.doc_id == 1 and r.source) == [4, 10]


def test_edge_document_gives_its_first_words(small):
    got = mix(small[0]).filter((F.col("part") > 0) & (F.col("part") < F.col("size")))
    per = got.groupBy("source").count().collect()
    assert all(r["count"] <= 1 for r in per)
