"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by a perturbed A-star search over the lattice.

A text is cut at spaces into units (a run of spaces with the word after it), over whose lattices its segmentations
factorise, as no piece has a space after another character; a piece's weight is 1 / (rank + 50) of its place in the public vocabulary. A segmentation's log-probability
plus an independent Gumbel noise is its perturbed score, and the k highest are k segmentations drawn without
replacement. They are found best first. The search tree's root has the Gumbel maximum of all segmentations; of a subtree
with maximum G the best leaf is an ordinary draw from it, and every sibling branch that the draw leaves aside has a
maximum of its own, a Gumbel located at the branch's log-probability and cut off at G. The highest of these bounds is the
subtree to open next. The next bound after k leaves is the threshold, from which each sample's inclusion score follows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import give_back
from loamdex.llm.lattice import SPACE, PieceTable, by_length, byte_ids, vocabulary

#: Longer units are laid out one by one: their segmentations are kept as lists, their sums relative to each other.
LONGEST = 24
#: A uniform number is spread over a unit's steps until this much of it is used; then its hash takes its place.
USED = 2.0**-20
#: Cells of the table of steps of long units that walk together.
WALKED = 1 << 18
SAMPLES = 2
UNKNOWN = 1e-9
#: Bytes of characters without a piece, as they stand until they are put together.
_escaped = re.compile("[\udc80-\udcff]").search
_units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
_WORKERS: dict[str | None, Sampler] = {}


def units_of(text: str) -> list[str]:
    """The text with its spaces marked and one in front, cut into units; nothing for the empty text."""
    return _units(SPACE + text.replace(" ", SPACE)) if text else []


def _fresh(u: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers by a hash of a unit's own one and the step."""
    x = u.view(np.uint64) + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _pick(chances: np.ndarray, random: np.random.Generator) -> int:
    """A place by its share of the chances; never one without."""
    upto = np.cumsum(chances)
    return int(np.searchsorted(upto, min(random.random() * upto[-1], np.nextafter(upto[-1], 0.0)), side="right"))


class Lattices:
    """Of distinct units: by place, the chance of each piece length as the next step, the sums over all that follows divided out.

    A uniform number below the chance of always taking the likeliest piece means that segmentation, which is kept ready;
    only the others walk through the lattice. Chances of what is left aside are added up, never got by subtraction, so
    the rarest segmentation counts. Memory is in proportion to the units' characters.
    """

    def __init__(self, sampler: Sampler, units: list[str]):
        table = sampler.table
        self.sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        self.long = self.sizes > LONGEST
        self.first = np.cumsum(self.sizes) - self.sizes
        found = [(at, table.arcs(codes)) for at, codes in by_length(units)]
        # no wider than the longest piece that stands anywhere
        width = max((k for _, arcs in found for k, x in enumerate(arcs, 1) if k == 1 or (x != table.size).any()), default=1)
        places = int(self.sizes.sum())
        self.part = np.zeros((places, width), dtype=np.float64)
        self.piece = np.full((places, width), table.size, dtype=np.int32)
        # units of one length lie together while they are filled in
        base = 0
        for at, arcs in found:
            m, n = arcs[0].shape
            self.first[at] = base + np.arange(m) * n
            part, piece = (x[base : base + m * n].reshape(m, n, width) for x in (self.part, self.piece))
            base += m * n
            for length, x in enumerate(arcs[:width]):
                piece[:, : n - length, length] = x
            (self._fill_long if n > LONGEST else self._fill)(sampler.p, piece, part)
        self.top_length = self.part.argmax(axis=1)
        rows = np.arange(places)
        self.top = self.part[rows, self.top_length]
        self.part[rows, self.top_length] = 0.0
        #: Chance of all steps but the likeliest.
        self.other = self.part.sum(axis=1)
        self.part[rows, self.top_length] = self.top
        # what always taking the likeliest piece gives
        self.best_steps, self.best, self.best_log, self.best_rest = self._likeliest()

    @staticmethod
    def _fill(p: np.ndarray, piece: np.ndarray, part: np.ndarray) -> None:
        """Chances of the next step at each place of units of one length, from the end on."""
        m, n, width = piece.shape
        sums = [np.ones(m)]
        for i in range(n - 1, -1, -1):
            longest = min(n - i, width)
            steps = np.empty((longest, m))
            for length in range(longest):
                np.multiply(p[piece[:, i, length]], sums[length], out=steps[length])
            total = steps.sum(axis=0)
            part[:, i, :longest] = (steps / total).T
            sums.insert(0, total)

    @staticmethod
    def _fill_long(p: np.ndarray, piece: np.ndarray, part: np.ndarray) -> None:
        """The same, unit by unit, with sums relative to the last one's, so that none underflows."""
        m, n, width = piece.shape
        for unit in range(m):
            part[unit] = p[piece[unit]]
            # sums from a place on, of which those up to ``width`` places behind have one scale
            sums = np.zeros(n + width)
            sums[n] = 1.0
            for i in range(n - 1, -1, -1):
                total = part[unit, i] @ sums[i + 1 : i + 1 + width]
                part[unit, i] *= sums[i + 1 : i + 1 + width]
                part[unit, i] /= total
                sums[i] = total
                if not 1e-60 < total < 1e60:
                    sums[i : i + width] /= total

    def _likeliest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of short units the likeliest steps: pieces, chance, its logarithm, and the chance of all other segmentations."""
        width, pieces, count = self.part.shape[1], self.piece.ravel(), len(self.sizes)
        chance, rest, steps = np.ones(count), np.zeros(count), []
        live = np.flatnonzero(~self.long)
        place, end = self.first[live], self.first[live] + self.sizes[live]
        while len(live):
            length = self.top_length[place]
            rest[live] += chance[live] * self.other[place]
            chance[live] *= self.top[place]
            step = np.full(count, -1, dtype=np.int32)
            step[live] = pieces[place * width + length]
            steps.append(step)
            place = place + length + 1
            more = place < end
            live, place, end = live[more], place[more], end[more]
        with np.errstate(divide="ignore"):
            log = np.log(chance)
        # long units, and those whose likeliest steps use a number up, walk
        ready = np.where((chance >= USED) & ~self.long, chance, 0.0)
        return (np.stack(steps, axis=1) if steps else np.zeros((count, 0), dtype=np.int32)), ready, log, np.log(rest, out=np.full(count, -np.inf), where=rest > 0)

    def _walk(self, of: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each unit: pieces (units, steps), -1 after the last; the logarithms of its chance and of all others'."""
        width, pieces, seeds = self.part.shape[1], self.piece.ravel(), u
        log, rest, used, steps = np.zeros(len(of)), np.zeros(len(of)), np.ones(len(of)), []
        live, place, end = np.arange(len(of)), self.first[of], self.first[of] + self.sizes[of]
        while len(live):
            row, top, top_length = self.part[place], self.top[place], self.top_length[place]
            at = np.arange(len(live))
            # the likeliest piece's chance comes first, then the others in order
            row[at, top_length] = 0.0
            upto = np.cumsum(row, axis=1) + top[:, None]
            on_top = u < top
            length = np.where(on_top, top_length, (upto <= np.minimum(u, np.nextafter(upto[:, -1], 0.0))[:, None]).argmin(axis=1))
            part = np.where(on_top, top, row[at, length])
            low = np.where(on_top, 0.0, upto[at, length] - part)
            rest[live] += np.exp(log[live]) * np.where(on_top, self.other[place], 1.0 - part)
            log[live] += np.log(part)
            # what is left of a number within its interval is uniform again, until too little of it is left
            u = np.minimum(np.maximum(u - low, 0.0) / part, 1 - 1e-16)
            spent = used * part
            if (spent < USED).any():
                u = np.where(spent < USED, _fresh(seeds[live], len(steps) + 1), u)
                spent = np.where(spent < USED, 1.0, spent)
            step = np.full(len(of), -1, dtype=np.int32)
            step[live] = pieces[place * width + length]
            steps.append(step)
            place = place + length + 1
            more = place < end
            live, place, end, u, used = live[more], place[more], end[more], u[more], spent[more]
        return (np.stack(steps, axis=1) if steps else np.zeros((len(of), 0), dtype=np.int32)), log, np.log(rest, out=np.full(len(of), -np.inf), where=rest > 0)

    def draw(self, of: np.ndarray, u: np.ndarray) -> Drawn:
        """A segmentation of each unit from one uniform number."""
        steps, log, rest = self.best_steps[of], self.best_log[of], self.best_rest[of]
        walks = u >= self.best[of]
        long = self.long[of]
        other = np.flatnonzero(walks & ~long)
        if len(other):
            more, logs, rests = self._walk(of[other], u[other])
            if more.shape[1] > steps.shape[1]:
                steps = np.pad(steps, ((0, 0), (0, more.shape[1] - steps.shape[1])), constant_values=-1)
            steps[other] = -1
            steps[other, : more.shape[1]] = more
            log[other], rest[other] = logs, rests
        lists, wide = {}, np.flatnonzero(long)
        wide = wide[np.argsort(self.sizes[of[wide]], kind="stable")]
        while len(wide):
            # as many at once as keep what they are laid out in small
            n = max(1, int(np.searchsorted(np.arange(1, len(wide) + 1) * self.sizes[of[wide]], WALKED, side="right")))
            some, wide = wide[:n], wide[n:]
            more, log[some], rest[some] = self._walk(of[some], u[some])
            lists |= {i: x[x >= 0] for i, x in zip(some.tolist(), more, strict=True)}
        return Drawn(steps, log, rest, lists)

    def lengths(self, unit: int, steps: np.ndarray) -> tuple[int, ...]:
        """The piece lengths, less one, of a segmentation of a unit."""
        out, place = [], int(self.first[unit])
        for piece in steps[steps >= 0].tolist():
            # a unit of one length: no two pieces of a place are equal
            length = int(np.flatnonzero(self.piece[place] == piece)[0])
            out.append(length)
            place += length + 1
        return tuple(out)

    def _aside(self, unit: int, taken: list[tuple[int, ...]]) -> list[tuple[float, int, tuple[int, ...], int, tuple[int, int]]]:
        """Where a segmentation can leave those taken: (log chance up to a place, the place, steps to leave out, steps before, of whom)."""
        out = []
        stack = [(0.0, int(self.first[unit]), list(range(len(taken))), 0)]
        while stack:
            log, place, same, depth = stack.pop()
            ways: dict[int, list[int]] = {}
            for t in same:
                if depth < len(taken[t]):
                    ways.setdefault(taken[t][depth], []).append(t)
            if ways:
                out.append((log, place, tuple(ways), depth, same[0]))
                stack += [(log + math.log(self.part[place, w]), place + w + 1, ts, depth + 1) for w, ts in ways.items()]
        return out

    def _left_out(self, place: int, ways: tuple[int, ...]) -> np.ndarray:
        row = self.part[place].copy()
        row[list(ways)] = 0.0
        return row

    def left(self, unit: int, taken: list[tuple[int, ...]]) -> float:
        """Logarithm of the chance of all segmentations that are not taken."""
        found = [log + math.log(c) for log, place, ways, *_ in self._aside(unit, taken) if (c := float(self._left_out(place, ways).sum())) > 0]
        return float(np.logaddexp.reduce(found)) if found else -math.inf

    def another(self, unit: int, taken: list[tuple[int, ...]], random: np.random.Generator) -> tuple[np.ndarray, float]:
        """A draw from the segmentations that are not taken: pieces and the logarithm of the probability among all."""
        ways = [(w, self._left_out(w[1], w[2])) for w in self._aside(unit, taken)]
        logs = np.array([w[0] + math.log(c) if (c := float(row.sum())) > 0 else -math.inf for w, row in ways])
        chances = np.exp(logs - logs.max())
        (log, place, _, depth, which), row = ways[_pick(chances, random)]
        steps, at = [], int(self.first[unit])
        for length in taken[which][:depth]:
            steps.append(int(self.piece[at, length]))
            at += length + 1
        end = int(self.first[unit] + self.sizes[unit])
        while place < end:
            length = _pick(row, random)
            log += math.log(self.part[place, length])
            steps.append(int(self.piece[place, length]))
            place += length + 1
            if place < end:
                row = self.part[place]
        return np.array(steps, dtype=np.int32), log


@dataclass
class Drawn:
    """Segmentations of units in a row: pieces (units, steps), -1 after the last, those of long units in lists by place;
    logarithms of their chances and of the chance of all others of each unit."""

    steps: np.ndarray
    log: np.ndarray
    rest: np.ndarray
    lists: dict[int, np.ndarray]

    def part(self, a: int, b: int) -> Drawn:
        return Drawn(self.steps[a:b], self.log[a:b], self.rest[a:b], {i - a: x for i, x in self.lists.items() if a <= i < b} if self.lists else {})

    def of(self, i: int) -> np.ndarray:
        return self.lists[i] if i in self.lists else self.steps[i]

    def then(self, mine: np.ndarray, log: float, tail: Drawn, long: bool) -> Drawn:
        """These units, one more with this segmentation, and the tail's."""
        n = len(self.log)
        width = max(self.steps.shape[1], 0 if long else len(mine), tail.steps.shape[1])
        steps = np.full((n + 1 + len(tail.log), width), -1, dtype=np.int32)
        steps[:n, : self.steps.shape[1]] = self.steps
        steps[n + 1 :, : tail.steps.shape[1]] = tail.steps
        if not long:
            steps[n, : len(mine)] = mine
        lists = self.lists | ({n: mine} if long else {}) | {n + 1 + i: x for i, x in tail.lists.items()}
        return Drawn(steps, np.concatenate([self.log, [log], tail.log]), np.concatenate([self.rest, [-np.inf], tail.rest]), lists)

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces in order, and the unit of each."""
        used = self.steps >= 0
        flat, row = self.steps[used], np.flatnonzero(used) // max(1, self.steps.shape[1])
        if self.lists:
            rows = sorted(self.lists)
            cuts = np.searchsorted(row, rows)
            both = [x for i, part in zip(rows, np.split(flat, cuts), strict=False) for x in (part, self.lists[i])]
            flat = np.concatenate([*both, flat[cuts[-1] :]])
            both = [x for i, part in zip(rows, np.split(row, cuts), strict=False) for x in (part, np.full(len(self.lists[i]), i))]
            row = np.concatenate([*both, row[cuts[-1] :]])
        return flat, row


def _cut_gumbel(loc: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel maxima located at loc, conditional on being at most ``most``."""
    with np.errstate(divide="ignore"):
        return np.where(np.isfinite(loc), -np.logaddexp(-most, np.log(-np.log(u)) - loc), -np.inf)


class Sampler:
    def __init__(self, path: str | None = None):
        pieces, ids, ranks = vocabulary(path)
        self.bytes = byte_ids(path)
        # a byte below 128 is a character of its own: those without a piece, line ends among them, act as pieces
        single = [chr(b) for b in range(128) if chr(b) not in set(pieces)]
        self.pieces = (*pieces, *single)
        self.table = PieceTable(self.pieces)
        n = self.table.size
        weights = 1.0 / (np.array(ranks, dtype=np.float64) + 50.0)
        self.p = np.full(n + 2, UNKNOWN)
        self.p[: len(pieces)] = weights / weights.sum()
        self.p[n] = 0
        self.ids = np.array([*ids, *(self.bytes[ord(c)] for c in single), -1, -2], dtype=np.int64)
        self.widths = np.array([*map(len, self.pieces), 0, 1], dtype=np.int64)
        text = dict(zip(self.ids[:n].tolist(), self.pieces, strict=True)) | {i: chr(b if b < 128 else 0xDC00 + b) for b, i in enumerate(self.bytes)}
        #: What each id stands for, with spaces for their markers.
        self.text = np.full(max(text) + 1, "", dtype=object)
        self.text[list(text)] = [x.replace(SPACE, " ") for x in text.values()]

    def token_ids(self, drawn: Drawn, units: list[str]) -> np.ndarray:
        """Ids in order; an unknown character becomes the ids of its UTF-8 bytes."""
        flat, row = drawn.pieces()
        ids = self.ids[flat]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        upto = np.cumsum(self.widths[flat])
        first = np.searchsorted(row, row[odd])
        within = upto[odd] - 1 - (upto[first] - self.widths[flat[first]])
        codes = [[self.bytes[b] for b in units[r][c].encode("utf-8", "surrogatepass")] for r, c in zip(row[odd].tolist(), within.tolist(), strict=True)]
        counts = np.ones(len(ids), dtype=np.int64)
        counts[odd] = [len(c) for c in codes]
        out = np.repeat(ids, counts)
        starts = np.cumsum(counts) - counts
        for at, code in zip(starts[odd].tolist(), codes, strict=True):
            out[at : at + len(code)] = code
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = "".join(self.text[ids].tolist())
        if not text.isascii() and _escaped(text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape").replace(SPACE, " ")
        return text[1:]

    def sample(self, texts: list[str], keys: list[int], k: int = SAMPLES, seed: int = 42) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct segmentations as (ids, log-probability, perturbed score, inclusion score)."""
        split = [units_of(t) for t in texts]
        number = {u: i for i, u in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        of = [np.fromiter(map(number.__getitem__, units), dtype=np.int64, count=len(units)) for units in split]
        lattices = Lattices(self, list(number))
        random = [np.random.Generator(np.random.SFC64([seed, key & 0xFFFFFFFFFFFFFFFF])) for key in keys]
        tops = [float(-np.log(-np.log(r.random()))) for r in random]
        sizes = [len(o) for o in of]
        every = np.concatenate(of) if of else np.zeros(0, dtype=np.int64)
        drawn = lattices.draw(every, np.concatenate([r.random(n) for r, n in zip(random, sizes, strict=True)]) if of else np.zeros(0))
        ends = np.cumsum(sizes)
        searches = []
        for i, end in enumerate(ends.tolist()):
            at = end - sizes[i]
            search = _Search(lattices, of[i], random[i], tops[i], k)
            search.reach(0, tops[i], drawn.part(at, end))
            searches.append(search)
        # the suffixes of all texts are drawn together
        for _ in range(1, k):
            opened = [(s, *got) for s in searches if (got := s.open())]
            if not opened:
                break
            tails = [s.of[t + 1 :] for s, t, *_ in opened]
            drawn = lattices.draw(np.concatenate(tails), np.concatenate([s.random.random(len(x)) for (s, *_), x in zip(opened, tails, strict=True)]))
            done = 0
            for (s, t, g, parent), tail in zip(opened, tails, strict=True):
                s.branch(t, g, parent, drawn.part(done, done + len(tail)))
                done += len(tail)
        return [s.results(self, units) for s, units in zip(searches, split, strict=True)]


class _Search:
    """The search of one text: found leaves, and by leaf the bounds of the branches it left aside."""

    def __init__(self, lattices: Lattices, of: np.ndarray, random: np.random.Generator, top: float, k: int):
        self.lattices, self.of, self.random, self.k = lattices, of, random, k
        self.leaves: list[dict] = []

    def reach(self, t: int, g: float, drawn: Drawn) -> None:
        """A leaf that leaves the tree's known part at unit t; drawn holds all its units, with what is left aside at each."""
        n = len(self.of)
        before = np.concatenate([[0.0], np.cumsum(drawn.log)])
        bounds = np.full(n, -np.inf)
        u = np.maximum(self.random.random(n - t), 1e-300)
        bounds[t:] = _cut_gumbel(before[t:n] + drawn.rest[t:], np.full(n - t, g), u)
        self.leaves.append({"drawn": drawn, "log": float(before[-1]), "g": g, "bounds": bounds, "shut": {}})

    def open(self) -> tuple[int, float, dict] | None:
        """The unit, bound and leaf of the best branch left aside."""
        best = max(self.leaves, key=lambda leaf: leaf["bounds"].max(initial=-np.inf))
        if not len(self.of) or not np.isfinite(g := best["bounds"].max()):
            return None
        return int(best["bounds"].argmax()), float(g), best

    def branch(self, t: int, g: float, parent: dict, tail: Drawn) -> None:
        """Open the branch at unit t: a segmentation of it that is not taken there, then the drawn tail."""
        unit = int(self.of[t])
        taken = parent["shut"].setdefault(t, [self.lattices.lengths(unit, parent["drawn"].of(t))])
        mine, log = self.lattices.another(unit, taken, self.random)
        taken.append(self.lattices.lengths(unit, mine))
        parent["bounds"][t] = -np.inf
        drawn = parent["drawn"].part(0, t).then(mine, log, tail, bool(self.lattices.long[unit]))
        drawn.rest[t] = self.lattices.left(unit, taken)
        self.reach(t, g, drawn)
        self.leaves[-1]["shut"][t] = taken

    def results(self, sampler: Sampler, units: list[str]) -> list[tuple[np.ndarray, float, float, float]]:
        if not len(self.of):
            return [(np.zeros(0, dtype=np.int64), 0.0, self.leaves[0]["g"], 1.0)]
        threshold = max(float(leaf["bounds"].max()) for leaf in self.leaves)
        out = []
        for leaf in sorted(self.leaves, key=lambda x: -x["g"]):
            included = float(-np.expm1(-np.exp(min(50.0, leaf["log"] - threshold)))) if np.isfinite(threshold) else 1.0
            out.append((sampler.token_ids(leaf["drawn"], units), leaf["log"], leaf["g"], included))
        return out


def sampler(path: str | None) -> Sampler:
    if path not in _WORKERS:
        _WORKERS[path] = Sampler(path)
    return _WORKERS[path]


def _rows(path: str | None, k: int, seed: int, with_ids: bool, batch_texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path)
        for whole in batches:
            for batch in _parts(whole, batch_texts, batch_texts * 4096):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows: list[tuple] = []
                for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), texts, own.sample(texts, batch.column("key").to_pylist(), k, seed), strict=True):
                    for rank, (ids, log_p, score, included) in enumerate(found, 1):
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append((doc_id, rank, len(ids), crc, log_p, score, included, own.decode(ids) == text, *([ids] if with_ids else [])))
                names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_probability", "perturbed_score", "inclusion", "round_trip", *(["ids"] if with_ids else [])]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds)] if rows else [pa.array([], kind) for _, kind in zip(names, kinds)], names=names)
        give_back()

    return run


def _parts(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and, but for a single long text, of bounded text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and end - at < rows and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def sampled_segmentations(docs: DataFrame, k: int = SAMPLES, seed: int = 42, path: str | None = None, with_ids: bool = False, batch_texts: int = 1024) -> DataFrame:
    """k distinct segmentations of every whole text, drawn without replacement, best perturbed score first.

    docs: doc_id, text; other columns are ignored. The draw is seeded by seed and a hash of doc_id and text, so reruns
    and repeated rows agree. A text with fewer segmentations than k gives all of them, with inclusion 1; a null text is
    the empty text, whose one segmentation has no pieces. Decoding any sample gives the text back (round_trip); a
    space is the marker U+2581 in pieces, so a text that holds this character decodes to one with a space. Returns
    doc_id, sample, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), log_probability, perturbed_score,
    inclusion, round_trip and, with with_ids, ids. batch_texts texts (and 4096 characters for each) share their units'
    lattices: more take less time and more memory. No shuffle; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_probability double, perturbed_score double, inclusion double, round_trip boolean"
    return rows.mapInArrow(_rows(path, k, seed, with_ids, batch_texts), schema + (", ids array<int>" if with_ids else ""))
