"""Piece lattices of many words at once.

A word's lattice has a node for every place between characters and an arc for every piece of a vocabulary that stands
there. Words are taken by length, so every step below is one array operation over all words of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

VOCABULARY = "piece_bpe_32k.model"
#: Stands for a space in pieces.
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.uint64(0xD6E8FEB86659FD93)
_BITS = 20


@cache
def vocabulary(path: str | None = None) -> tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...]]:
    """Pieces, their ids and their ranks (0 best), of a public SentencePiece model; and nothing that can't be segmented with."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found = [
        (model.id_to_piece(i), i, model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    # pieces that no merge makes have a score below all ranks; of these only single characters can be needed
    found = [x for x in found if x[2] > -1e8 or len(x[0]) == 1]
    return tuple(x[0] for x in found), tuple(x[1] for x in found), tuple(int(min(-x[2], len(found))) for x in found)


@cache
def byte_ids(path: str | None = None) -> tuple[int, ...]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    return tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))


class PieceTable:
    """Finds pieces by the hash of their characters; size stands for no piece, size + 1 for an unknown character."""

    def __init__(self, pieces: tuple[str, ...]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        with np.errstate(over="ignore"):
            hashes = np.zeros(self.size + 2, dtype=np.uint64)
            for k, piece in enumerate(pieces):
                h = np.uint64(0)
                for c in piece:
                    h = h * _BASE + np.uint64(ord(c))
                hashes[k] = h
        self.hashes = hashes
        slot = ((hashes[: self.size] * _KEY) >> np.uint64(64 - _BITS)).astype(np.int64)
        self.table = np.full(1 << _BITS, self.size, dtype=np.int32)
        _, first, count = np.unique(slot, return_index=True, return_counts=True)
        self.table[slot[first]] = first
        #: The few slots that several pieces want are marked; what falls there is looked up by its hash.
        self.table[slot[first[count > 1]]] = -1
        shared = np.flatnonzero(np.isin(slot, slot[first[count > 1]]))
        self.shared = dict(zip(hashes[shared].tolist(), shared.tolist(), strict=True))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = self.table[((hashes * _KEY) >> np.uint64(64 - _BITS)).astype(np.int64)]
        crowded = np.nonzero(out < 0)
        out[self.hashes[out] != hashes] = self.size
        if len(crowded[0]):
            out[crowded] = [self.shared.get(h, self.size) for h in hashes[crowded].tolist()]
        return out

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words of one length n, codes (m, n): at [length - 1] the pieces from each place, (m, n - length + 1)."""
        n = codes.shape[1]
        chars = codes.astype(np.uint64)
        hashes, out = np.zeros_like(chars), []
        for length in range(1, min(n, self.longest) + 1):
            hashes = hashes[:, : n - length + 1] * _BASE + chars[:, length - 1 :]
            found = self.find(hashes)
            if length == 1:
                found[found == self.size] = self.size + 1
            out.append(found)
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, codes) of the words of each length, in blocks."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if not len(part) or not sizes[part[0]]:
            continue
        for at in range(0, len(part), 8192):
            block = part[at : at + 8192]
            text = "".join([words[i] for i in block.tolist()])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield block, codes.reshape(len(block), -1)


def forward(arcs: list[np.ndarray], p: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations up to each place, (m, columns of p); p has a row per piece and two more (none, unknown)."""
    m, n = arcs[0].shape
    none = len(p) - 2
    out = [np.ones((m, p.shape[1]))]
    for j in range(1, n + 1):
        total = np.zeros((m, p.shape[1]))
        for length in range(1, min(j, len(arcs)) + 1):
            piece = arcs[length - 1][:, j - length]
            at = np.flatnonzero(piece != none)
            if len(at):
                total[at] += out[j - length][at] * p[piece[at]]
        out.append(total)
    return out


def backward(arcs: list[np.ndarray], p: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations from each place on."""
    m, n = arcs[0].shape
    none = len(p) - 2
    out = [np.ones((m, p.shape[1]))]
    for i in range(n - 1, -1, -1):
        total = np.zeros((m, p.shape[1]))
        for length in range(1, min(n - i, len(arcs)) + 1):
            piece = arcs[length - 1][:, i]
            at = np.flatnonzero(piece != none)
            if len(at):
                total[at] += out[length - 1][at] * p[piece[at]]
        out.insert(0, total)
    return out


def log_forward(codes: np.ndarray, lengths: np.ndarray, table: PieceTable, p: np.ndarray, chunk: int = 4096, every: bool = False) -> np.ndarray:
    """Logarithms of the sums over all segmentations of words of any length, (m, columns of p).

    codes: (m, n), words of which those shorter than n are filled up; lengths: theirs. The sums up to the last places,
    as many as the longest piece is long, are held relative to the last one's, whose logarithm is carried on, so that
    nothing underflows; arcs are looked up for ``chunk`` places at a time. every: sums up to every place, (n + 1, m, columns).
    """
    m, n = codes.shape
    wide, k = table.longest, p.shape[1]
    held, log = np.zeros((wide, m, k)), np.zeros((m, k))
    held[0] = 1.0
    out, kept = np.zeros((m, k)), [log]
    for at in range(0, n, chunk):
        first = max(0, at - wide + 1)
        part = codes[:, first : at + chunk]
        ends = np.full((wide, *part.shape), table.size, dtype=np.int32)
        for length, found in enumerate(table.arcs(part), 1):
            ends[length - 1, :, length - 1 :] = found
        for j in range(at, min(n, at + chunk)):
            total = np.einsum("lmk,lmk->mk", held, p[ends[:, :, j - first]])
            held[1:] = held[:-1] / total
            held[0] = 1.0
            log = log + np.log(total)
            if every:
                kept.append(log)
            done = lengths == j + 1
            out[done] = log[done]
    return np.array(kept) if every else out


def log_backward(arcs: list[np.ndarray], p: np.ndarray, wide: int) -> np.ndarray:
    """Logarithms of the sums over all segmentations from each place on, (n + 1, m, columns of p)."""
    m, n = arcs[0].shape
    starts = np.full((wide, m, n), len(p) - 2, dtype=np.int32)
    for length, found in enumerate(arcs, 1):
        starts[length - 1, :, : found.shape[1]] = found
    held, log = np.zeros((wide, m, p.shape[1])), np.zeros((m, p.shape[1]))
    held[0] = 1.0
    out = [log]
    for i in range(n - 1, -1, -1):
        total = np.einsum("lmk,lmk->mk", held, p[starts[:, :, i]])
        held[1:] = held[:-1] / total
        held[0] = 1.0
        log = log + np.log(total)
        out.append(log)
    return np.array(out[::-1])


def of_like_length(words: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in words, codes, lengths) of groups of words, none much longer than the shortest; codes are filled up with zeros."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and sizes[order[end]] <= 1.25 * sizes[order[at]] and (end + 1 - at) * sizes[order[end]] <= most:
            end += 1
        block = order[at:end]
        codes = np.zeros((len(block), int(sizes[block[-1]])), dtype=np.uint32)
        for row, i in enumerate(block.tolist()):
            codes[row, : sizes[i]] = np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield block, codes, sizes[block]
        at = end
