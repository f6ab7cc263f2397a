"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of near ones: a coarse tree, halved at medians over a bounded sample, gives each vector a cell,
and a cell with more vectors than a shard holds is split by a hash of their ids. A shard's own tree halves its vectors at
the median along the direction between two far points, down to leaves; a node keeps its centre and radius, so no vector
below it scores more than query . centre + |query| * radius. For a block of queries, leaves are ordered for each query by
that bound and scored best first, until the next bound is below the query's k-th score so far. That k-th score is shared:
a first pass scores every query against the shard where it lies itself, which also gives the shards' balls; then a query
is sent only to the shards whose ball can reach what it has, and a shard only to blocks with such a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.common import cut

LEAF = 128
#: Vectors of a shard, queries of a block, balls of a group: what one task holds.
SHARD, QUERIES, BALLS = 8192, 2048, 4096
#: Vectors that the coarse tree is made from, about, and its most cells; the sample places vectors, it decides no score.
SAMPLE, CELLS = 4096, 512


def _stack(column: pd.Series) -> np.ndarray:
    """Rows as float64, shorter ones padded with zeros."""
    width = max((len(v) for v in column), default=0)
    out = np.zeros((len(column), width), dtype=np.float64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


class BallTree:
    """Leaves of one shard: rows in leaf order, and each leaf's centre, radius and bounds of its ancestors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        order = np.arange(len(rows))
        stack = [(0, len(rows), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            part = rows[order[start:end]]
            centre = part.mean(axis=0)
            away = np.sqrt(((part - centre) ** 2).sum(axis=1))
            here = len(self.nodes)
            # the bound must hold in floating point too
            self.nodes.append([centre, float(away.max()) * (1 + 1e-9) + 1e-6, start, end, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = here
            if end - start > leaf and away.max() > 0:
                one = part[away.argmax()]
                other = part[((part - one) ** 2).sum(axis=1).argmax()]
                along = part @ (one - other)
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(along, half)]
                stack += [(start, start + half, here, 0), (start + half, end, here, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.least = [self.ids[n[2] : n[3]].min() for n in self.nodes]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, scores: np.ndarray, found: np.ndarray) -> None:
        """Improve each query's k best in place: scores (n, k) descending with -inf for none, found their ids, ties by less id."""
        norms = np.sqrt((queries**2).sum(axis=1)) * (1 + 1e-9)
        live = [(0, np.arange(len(queries)))]
        bounds: list[tuple[int, np.ndarray, np.ndarray]] = []
        while live:
            node, who = live.pop()
            centre, radius, _, _, left, right = self.nodes[node]
            bound = queries[who] @ centre + norms[who] * radius + 1e-6
            keep = bound >= scores[who, -1]
            who, bound = who[keep], bound[keep]
            if not len(who):
                continue
            if left < 0:
                bounds.append((node, who, bound))
            else:
                live += [(left, who), (right, who)]
        if not bounds:
            return
        leaf = np.concatenate([np.full(len(w), n) for n, w, _ in bounds])
        who = np.concatenate([w for _, w, _ in bounds])
        bound = np.concatenate([b for *_, b in bounds])
        order = np.lexsort((-bound, who))
        leaf, who, bound = leaf[order], who[order], bound[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        turn = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        # round r scores, for every query that can still gain, its r-th best leaf
        by_turn = np.argsort(turn, kind="stable")
        starts = np.flatnonzero(np.diff(turn[by_turn], prepend=-1))
        for at, to in zip(starts, np.append(starts[1:], len(turn)), strict=True):
            pick = by_turn[at:to]
            pick = pick[bound[pick] >= scores[who[pick], -1]]
            if not len(pick):
                break  # bounds fall from round to round
            pick = pick[np.argsort(leaf[pick], kind="stable")]
            edges = np.flatnonzero(np.diff(leaf[pick], prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(pick)), strict=True):
                self._score(int(leaf[pick[a]]), who[pick[a:b]], queries, own, k, scores, found)

    def _score(self, node: int, who: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, scores: np.ndarray, found: np.ndarray) -> None:
        _, _, start, end, *_ = self.nodes[node]
        ids = self.ids[start:end]
        new = queries[who] @ self.rows[start:end].T
        new[own[who][:, None] == ids[None, :]] = -np.inf
        gains = (new.max(axis=1) > scores[who, -1]) | ((new.max(axis=1) == scores[who, -1]) & (ids.min() < found[who, -1]))
        who, new = who[gains], new[gains]
        if not len(who):
            return
        every = np.concatenate([scores[who], new], axis=1)
        names = np.concatenate([found[who], np.broadcast_to(ids, new.shape)], axis=1)
        best = np.lexsort((names, -every), axis=1)[:, :k]
        scores[who] = np.take_along_axis(every, best, axis=1)
        found[who] = np.take_along_axis(names, best, axis=1)


_NONE = np.iinfo(np.int64).max


class CoarseTree:
    """Cells of near vectors: directions and thresholds of a binary tree over a sample."""

    def __init__(self, rows: np.ndarray, cells: int):
        self.width, self.nodes, self.cells = rows.shape[1] if rows.ndim == 2 else 0, [], 0
        self._split(rows, max(1, cells))

    def _split(self, rows: np.ndarray, cells: int) -> int:
        here = len(self.nodes)
        self.nodes.append(None)
        if cells > 1 and len(rows) >= 4:
            one = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            along = rows @ (one - other)
            cut = float(np.median(along))
            low = along < cut
            if low.any() and not low.all():
                self.nodes[here] = (one - other, cut, self._split(rows[low], cells // 2), self._split(rows[~low], cells - cells // 2))
        if self.nodes[here] is None:
            self.nodes[here] = self.cells
            self.cells += 1
        return here

    def cell(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), self.width))
        wide[:, : min(self.width, rows.shape[1])] = rows[:, : self.width]
        out, live = np.zeros(len(rows), dtype=np.int32), [(0, np.arange(len(rows)))]
        while live:
            node, who = live.pop()
            if isinstance(self.nodes[node], int):
                out[who] = self.nodes[node]
                continue
            way, cut, left, right = self.nodes[node]
            low = wide[who] @ way < cut
            live += [(left, who[low]), (right, who[~low])]
        return out


def _placed(tree: CoarseTree):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(cell=tree.cell(_stack(frame["v"])))

    return run


_FOUND = "query_id long, vec_id long, score long, shard int, centre array<double>, radius double"


def _searcher(k: int, balls: bool = False):
    """The k best of a shard's vectors for each query; with ``balls`` also a row with the shard's root ball."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": [], "centre": [], "radius": []})
        if not len(vectors):
            return out
        rows = _stack(vectors["v"])
        asked = _stack(queries["w"]) if len(queries) else np.zeros((0, rows.shape[1]))
        width = max(rows.shape[1], asked.shape[1])
        rows, asked = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, asked))
        tree = BallTree(vectors["vec_id"].to_numpy(), rows)
        if len(queries):
            scores = np.full((len(asked), k), -np.inf)
            if "floor" in queries:
                # what the query has reached elsewhere; scores equal to it still count
                scores[:] = np.nan_to_num(queries["floor"].to_numpy(dtype=np.float64), nan=-np.inf)[:, None]
            found = np.full((len(asked), k), _NONE)
            tree.search(asked, queries["query_id"].to_numpy(), k, scores, found)
            at, place = np.nonzero((found != _NONE) & np.isfinite(scores))
            out = pd.DataFrame({"query_id": queries["query_id"].to_numpy()[at], "vec_id": found[at, place], "score": scores[at, place].astype(np.int64), "shard": None, "centre": None, "radius": None})
        if balls:
            centre, radius, *_ = tree.nodes[0]
            ball = pd.DataFrame({"query_id": [None], "vec_id": [None], "score": [None], "shard": [int(vectors["shard"].iloc[0])], "centre": [centre], "radius": [radius]})
            out = pd.concat([out.astype(object), ball.astype(object)], ignore_index=True)
        return out.astype({"query_id": "Int64", "vec_id": "Int64", "score": "Int64", "shard": "Int32", "radius": "float64"})

    return run


def _reached(queries: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
    """Queries with the shards, but their own, whose ball can reach what they have."""
    empty = pd.DataFrame({"query_id": [], "w": [], "floor": [], "block": [], "shard": []}).astype({"query_id": "int64", "floor": "float64", "block": "int32", "shard": "int32"})
    if not len(queries) or not len(balls):
        return empty
    asked, centres = _stack(queries["w"]), _stack(balls["centre"])
    width = max(asked.shape[1], centres.shape[1])
    asked, centres = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (asked, centres))
    norms = np.sqrt((asked**2).sum(axis=1)) * (1 + 1e-9)
    # the bound must hold in floating point too
    bound = asked @ centres.T + norms[:, None] * balls["radius"].to_numpy()[None, :] + 1e-6
    shards = balls["shard"].to_numpy()
    floor = np.nan_to_num(queries["floor"].to_numpy(dtype=np.float64), nan=-np.inf)
    at, ball = np.nonzero((bound >= floor[:, None]) & (queries["home"].to_numpy()[:, None] != shards[None, :]))
    columns = {c: queries[c].to_numpy()[at] for c in ("query_id", "w", "floor", "block")}
    return pd.DataFrame(columns | {"shard": shards[ball]}) if len(at) else empty


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERIES, balls: int = BALLS) -> DataFrame:
    """The k best vec_ids of each query by inner product, over all vectors but the query's own.

    vectors: vec_id, v; queries: query_id, v; v arrays of whole numbers held as doubles. Shorter arrays are padded with
    zeros. Scores are exact while sums stay below 2 ** 53. Returns query_id, rank (from 1), vec_id, score; ties go to
    the smaller vec_id; fewer rows where there are fewer candidates. Equal ids count as one vector's rows: none of them
    is its own query's candidate. No vectors or no queries give no rows.

    A task holds one shard and one block of queries, or a block and a group of balls, whatever the table's size. Sent are
    every vector once, the balls once for each block of queries, the queries once for each group of balls, and what
    bounds can't rule out: a query to the shards that its bounds reach, a shard to the blocks with such a query.
    """
    n_vectors, n_queries = vectors.count(), queries.count()
    if not n_vectors or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, -(-n_queries // block))
    some = vectors.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(-(-n_vectors // SAMPLE))) == 0).select("v").toPandas()
    tree = CoarseTree(_stack(some["v"]), min(CELLS, -(-n_vectors // shard)))
    placed = cut(vectors.select("vec_id", "v").mapInPandas(_placed(tree), "vec_id long, v array<double>, cell int"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "v").mapInPandas(_placed(tree), "query_id long, v array<double>, cell int")
    # a cell of more vectors than a shard holds is several shards
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    pieces = [max(1, -(-sizes.get(c, 0) // shard)) for c in range(tree.cells)]
    first, shards = [sum(pieces[:c]) for c in range(tree.cells)], sum(pieces)
    of = lambda c: (F.get(F.lit(first), F.col("cell")) + F.pmod(F.xxhash64(c), F.get(F.lit(pieces), F.col("cell")))).cast("int")
    placed = placed.select("vec_id", "v", of("vec_id").alias("shard"))
    # columns of their own: both sides may come from one table
    asked = asked.select("query_id", F.col("v").alias("w"), of("query_id").alias("home"), F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(blocks)).cast("int").alias("block"))
    # each query's own shard, which holds about as many of the queries as of the vectors
    own = asked.select("query_id", "w", F.col("home").alias("shard"))
    seeds = cut(placed.groupBy("shard").cogroup(own.groupBy("shard")).applyInPandas(_searcher(k, True), _FOUND))
    found = seeds.filter("query_id IS NOT NULL").select("query_id", "vec_id", "score")
    if shards == 1:
        return _best(found, k).select("query_id", "rank", "vec_id", "score")
    floor = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    groups = -(-shards // balls)
    every = asked.join(floor, "query_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    all_balls = seeds.filter("query_id IS NULL").select("shard", "centre", "radius", F.floor(F.col("shard") / balls).cast("int").alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    reached = every.groupBy("part", "block").cogroup(all_balls.groupBy("part", "block")).applyInPandas(_reached, "query_id long, w array<double>, floor double, block int, shard int")
    reached = cut(reached)
    wanted = reached.select("shard", F.col("block").alias("to")).distinct()
    copies = placed.join(wanted, "shard").select("vec_id", "v", F.col("shard").alias("at"), "to")
    rest = copies.groupBy("at", "to").cogroup(reached.groupBy("shard", "block")).applyInPandas(_searcher(k), _FOUND)
    return _best(found.unionByName(rest.select("query_id", "vec_id", "score")), k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with components floor(scale * x); rows that are null or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))
