"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame functions only.

Each source gets an exact quota of words. Its documents are dealt to blocks by a hash, the blocks are put in a hashed
order, and the quota takes whole passes over the source, then whole blocks, then the documents of one edge block, whose
last document gives only its first words. Every block of every pass is one item, and all items are shared among the output
shards: from the root, which holds every source's count of items, each node passes half of its slots to its left child, as
many of each source as a multivariate-hypergeometric draw says. A leaf is a shard; it takes the next items of each source's
permuted order, so shards are disjoint and together hold the quota exactly. Within a shard, rows stand in the order of a
hash. Every draw is a hash of seed, node and place: reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.common import cut, let, words_in

#: By a source's place in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Least blocks of a source, so that the one it is cut within is small, and bounds of the tree's height.
LEAST_BLOCKS, LEVELS = 256, (3, 16)


def _uniform(*keys: Column) -> Column:
    """0 <= u < 1 from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def mix_key(docs: DataFrame, seed: int = 42) -> Column:
    """What a row's fate follows from: a hash of its doc_id, text and source, and of which are null."""
    columns = [docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["source"].cast("string")]
    return F.xxhash64(F.lit(seed), *columns, *[c.isNull() for c in columns])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of (source, size): its place, size and target in words.

    Targets are min(most * size, level * weight), where the level makes them add up to share * all sizes: what the
    stopped ones leave is shared again by weight until none is above. Sources are in code point order, null last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    placed = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    # in the order in which a rising level stops them: those before row i are at their cap if the level passes theirs
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("cap").over(every))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = placed.withColumn("level", level).withColumn("open", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    final = F.min(F.when(F.col("open").isNotNull(), F.struct(F.col("cap") / F.col("weight"), "place", "open"))).over(every)["open"]
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return levels.select("source", "place", "source_size", target.alias("target"))


def hypergeometric(u: Column, population: Column, good: Column, draws: Column) -> Column:
    """How many of ``draws`` items from a population are good ones, for a uniform u: inversion of the distribution.

    Chances are taken relative to the most likely outcome, by the ratio of neighbours; outcomes are gone through from it
    upwards, then downwards, as far as 12 standard deviations and 12 more, beyond which nothing is left in a double. So a
    draw takes time in proportion to the root of the counts, and no item is drawn by itself.
    """
    p = good / population
    spread = F.sqrt(F.greatest(F.lit(0.0), draws * p * (1 - p) * (population - draws) / F.greatest(population - 1, F.lit(1))))
    most = F.floor((draws + 1) * (good + 1) / (population + 2))
    lo, hi = F.greatest(F.lit(0).cast("long"), draws - (population - good)), F.least(draws, good)
    facts = F.struct(
        population.alias("n"), good.alias("k"), draws.alias("d"), u.alias("u"), lo.alias("lo"), hi.alias("hi"),
        F.least(hi, F.greatest(lo, most)).cast("long").alias("mode"), (F.ceil(spread * 12) + 12).cast("long").alias("wide"),
    )

    def invert(f):
        none = F.array().cast("array<long>")
        top, low = F.least(f["hi"], f["mode"] + f["wide"]), F.greatest(f["lo"], f["mode"] - f["wide"])
        up = F.when(top > f["mode"], F.sequence(f["mode"] + 1, top)).otherwise(none)
        down = F.when(low < f["mode"], F.sequence(f["mode"] - 1, low, F.lit(-1).cast("long"))).otherwise(none)
        rest = f["n"] - f["k"] - f["d"]

        def above(w, i):
            return w * (f["k"] - i + 1) * (f["d"] - i + 1) / (i * (rest + i))

        def below(w, i):
            return w * (i + 1) * (rest + i + 1) / ((f["k"] - i) * (f["d"] - i))

        def total(outcomes, ratio):
            state = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))
            return F.aggregate(outcomes, state, lambda s, i: let(ratio(s["w"], i), lambda w: F.struct(w.alias("w"), (s["t"] + w).alias("t"))), lambda s: s["t"])

        def pick(outcomes, ratio, left):
            # the first outcome whose chance uses up what is left, else the last
            state = F.struct(F.lit(1.0).alias("w"), left.alias("left"), F.lit(None).cast("long").alias("at"))
            step = lambda s, i: let(ratio(s["w"], i), lambda w: F.struct(w.alias("w"), (s["left"] - w).alias("left"), F.coalesce(s["at"], F.when(s["left"] < w, i)).alias("at")))
            return F.coalesce(F.aggregate(outcomes, state, step, lambda s: s["at"]), F.element_at(outcomes, -1))

        def place(t):
            left = f["u"] * (1 + t["up"] + t["down"]) - 1
            return F.when(left < 0, f["mode"]).when((left < t["up"]) | (F.size(down) == 0), pick(up, above, left)).otherwise(pick(down, below, left - t["up"]))

        return let(F.struct(total(up, above).alias("up"), total(down, below).alias("down")), place)

    return F.when(population > 0, let(facts, invert)).otherwise(F.lit(0).cast("long"))


def splitting_tree(counts: DataFrame, levels: int, seed: int = 42) -> DataFrame:
    """Counts of each source in each of 2 ** levels shards.

    counts: one row, counts array<long> by the sources' place. Returns shard, counts. Each level halves a node's slots:
    of each source the left child gets a hypergeometric draw, conditional on what the sources before it took, so the
    vector is multivariate-hypergeometric and children add up to their parent.
    """
    nodes = counts.select(F.lit(1).cast("long").alias("node"), "counts")
    for _ in range(levels):
        nodes = nodes.withColumn("_n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
        state = F.struct(F.floor(F.col("_n") / 2).cast("long").alias("slots"), F.col("_n").alias("left"), F.lit(0).cast("long").alias("place"), F.array().cast("array<long>").alias("drawn"))

        def source(s, k):
            took = hypergeometric(_uniform(F.lit(seed), F.col("node"), s["place"]), s["left"], k, s["slots"])
            return let(took, lambda t: F.struct((s["slots"] - t).alias("slots"), (s["left"] - k).alias("left"), (s["place"] + 1).alias("place"), F.concat(s["drawn"], F.array(t)).alias("drawn")))

        drawn = F.aggregate("counts", state, source, lambda s: s["drawn"])
        nodes = nodes.withColumn("_left", drawn).withColumn("_right", F.zip_with("counts", F.col("_left"), lambda a, b: a - b))
        nodes = nodes.select(F.col("node").alias("_p"), F.posexplode(F.array("_left", "_right")).alias("_side", "counts"))
        nodes = nodes.select((F.col("_p") * 2 + F.col("_side")).cast("long").alias("node"), "counts")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), "counts")


def tree_levels(words: float, shard_words: int) -> int:
    """Height of the tree whose leaves hold about this many words, within LEVELS."""
    least, most = LEVELS
    return max(least, min(most, math.ceil(math.log2(max(1.0, words / shard_words)))))


def deal(items: DataFrame, places: DataFrame, levels: int, seed: int = 42) -> DataFrame:
    """items (place, block, pass) with the shard that the tree's leaves give each, by a permuted order of each source's."""
    used = places.join(items.groupBy("place").agg(F.count(F.lit(1)).alias("used")), "place", "left").select("place", F.coalesce("used", F.lit(0).cast("long")).alias("used"))
    root = used.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "used"))), lambda x: x["used"]).alias("counts"))
    # drawn once: both the leaves' ends and the items' ranks rest on it
    leaves = cut(splitting_tree(root, levels, seed)).select("shard", F.posexplode("counts").alias("place", "n")).filter("n > 0")
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaves = leaves.withColumn("last", F.sum("n").over(upto))
    spots = leaves.select("place", "shard", F.explode(F.sequence((F.col("last") - F.col("n") + 1).cast("int"), F.col("last").cast("int"))).alias("rank"))
    order = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed + 3), "place", "pass", "block"), "pass", "block")
    return items.withColumn("rank", F.row_number().over(order)).join(spots, ["place", "rank"]).drop("rank")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of mix_in_shards."""
    return mix_in_shards(docs, **options)[0]


def mix_in_shards(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, levels: int | None = None, block_words: int = 1_000_000, shard_words: int = 2_000_000, seed: int = 42
) -> tuple[DataFrame, int]:
    """How many words of each document the mix takes, and where they go; and the number of shards.

    docs: doc_id, text, source; other columns are ignored. Size is the number of words; null texts have none. A null
    source is a source of its own, last in order. Returns doc_id, source, size, source_size, target, copies (whole
    passes over the document), part (words of one further, partial pass), taken = copies * size + part, passes (for each
    pass that takes words of it: words, shard, and turn, by which the shard's rows stand), key (see mix_key). Empty
    tables give no rows; documents without words take 0. Repeated rows are documents of their own; equal rows share a
    fate. Without ``levels``, the tree has as many leaves as give each shard_words or fewer, a power of two from 8 to
    65,536.

    Only (doc_id, source, size) is shuffled, never text. Blocks hold about block_words words, so the one block per
    source that is cut within is small; a block's key is a hash, so a hot source is spread over its blocks.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), mix_key(docs, seed).alias("key")))
    targets = source_targets(rows, weights, share, most)
    # passes over the whole source, and the words of the partial pass
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("copies", F.floor(ratio + 1e-12).cast("long"))
    targets = targets.withColumn("quota", F.greatest(F.lit(0).cast("long"), F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size")))
    targets = targets.withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / block_words)).cast("long"))
    plan = cut(targets)
    if levels is None:
        levels = tree_levels(plan.agg(F.sum("target")).first()[0] or 0.0, shard_words)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    # one row per source; Spark broadcasts it where its measured size allows and shuffles it otherwise
    by_source = plan.select(key.alias("source_key"), "place", "source_size", "target", "copies", "quota", "blocks")
    keyed = rows.withColumn("source_key", key).join(by_source, "source_key").withColumn("block", F.pmod(F.col("key"), F.col("blocks")))
    blocks = keyed.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("copies").alias("copies"))
    order = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed + 1), "place", "block"), "block")
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    blocks = cut(blocks.withColumn("room", F.least(F.col("words"), F.greatest(F.lit(0).cast("long"), F.col("quota") - before))))
    # the items that the tree shares out: every block of every pass, whole or in part
    items = blocks.select("place", "block", "copies", "words", "room", F.explode(F.sequence(F.lit(0).cast("long"), "copies")).alias("pass"))
    items = items.filter(F.when(F.col("pass") < F.col("copies"), F.col("words")).otherwise(F.col("room")) > 0).select("place", "block", "pass")
    shards = deal(items, plan.select("place"), levels, seed).groupBy("place", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    full = keyed.join(blocks.select("place", "block", "words", "room").join(shards, ["place", "block"], "left"), ["place", "block"])
    # within the block that the quota ends in, documents are taken in hashed order until it is full
    edge = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    inside = Window.partitionBy("place", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cols = ["doc_id", "source", "size", "source_size", "target", "copies", "part", "dealt", "key"]
    whole = full.filter(~edge).withColumn("part", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    partial = full.filter(edge).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    partial = partial.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("room") - F.col("_before"))))
    both = whole.select(cols).unionByName(partial.select(cols))

    def one(x):
        words = F.when(x["pass"] < F.col("copies"), F.col("size")).otherwise(F.col("part"))
        return F.struct(words.alias("words"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), F.col("key"), x["pass"]).alias("turn"))

    passes = F.filter(F.transform(F.coalesce("dealt", F.array().cast("array<struct<pass:bigint,shard:int>>")), one), lambda x: x["words"] > 0)
    taken = (F.col("copies") * F.col("size") + F.col("part")).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", "part", taken.alias("taken"), passes.alias("passes"), "key"), 1 << levels
