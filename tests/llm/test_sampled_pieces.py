import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from loamdex.llm.sampled_pieces import UNKNOWN, Lattices, Sampler, _cut_gumbel, sampled_segmentations, units_of

S = Sampler()


def segmentations(text):
    """Every segmentation of a short text with its probability."""
    unit = "".join(units_of(text))
    index = {p: i for i, p in enumerate(S.pieces)}
    out = {}
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(unit[at:i])
                at = i
        parts.append(unit[at:])
        # a character without a piece stands as its bytes
        if all(x in index or len(x) == 1 for x in parts):
            ids = [i for x in parts for i in ([int(S.ids[index[x]])] if x in index else [S.bytes[b] for b in x.encode()])]
            out[tuple(ids)] = math.prod(S.p[index[x]] if x in index else UNKNOWN for x in parts)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_samples_are_distinct_valid_and_scored():
    for text in ("the nation", "a b", "x"):
        every = segmentations(text) if " " not in text else None
        found = S.sample([text], [7], k=6)[0]
        ids = [tuple(i.tolist()) for i, *_ in found]
        assert len(set(ids)) == len(ids) and all(S.decode(np.array(i)) == text for i in ids)
        scores = [g for _, _, g, _ in found]
        assert scores == sorted(scores, reverse=True)
        assert all(0 < x <= 1 for *_, x in found)
        if every:
            assert set(ids) <= set(every) and len(ids) == min(6, len(every))
            for i, log_p, *_ in found:
                assert math.isclose(math.exp(log_p), every[tuple(i.tolist())], rel_tol=1e-6, abs_tol=1e-12)


def test_first_sample_follows_the_distribution_and_two_without_replacement():
    text, n = "onti", 4000
    every = segmentations(text)
    first, both = Counter(), Counter()
    for key in range(n):
        found = [tuple(i.tolist()) for i, *_ in S.sample([text], [key], k=2)[0]]
        first[found[0]] += 1
        for f in found:
            both[f] += 1
    for k, p in every.items():
        assert abs(first[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 2 / n
        # chance of being among two draws without replacement
        want = p + sum(q * p / (1 - q) for o, q in every.items() if o != k and q < 1)
        assert abs(both[k] / n - want) < 4 * math.sqrt(want * (1 - want) / n) + 3 / n


def test_inclusion_scores_are_unbiased():
    text, n = "onti", 3000
    every = segmentations(text)
    total = Counter()
    for key in range(n):
        for ids, log_p, _, q in S.sample([text], [key], k=2)[0]:
            total[tuple(ids.tolist())] += math.exp(log_p) / q
    assert abs(sum(total.values()) / n - 1) < 0.1
    for k, p in every.items():
        if p > 0.05:
            assert abs(total[k] / n - p) < 0.15 * p + 0.02


def lattice_walks(unit, sampler=S):
    """Every segmentation of a unit of any length, as (pieces, log weight)."""
    index = {p: i for i, p in enumerate(sampler.pieces)}
    found = [((), 0, 0.0)]
    while found:
        parts, at, log = found.pop()
        if at == len(unit):
            yield parts, log
            continue
        for n in range(1, min(sampler.table.longest, len(unit) - at) + 1):
            x = unit[at : at + n]
            if x in index or n == 1:
                found.append(((*parts, x), at + n, log + math.log(sampler.p[index[x]] if x in index else UNKNOWN)))


def test_units_of_any_length_are_segmented_whole():
    """Two stretches that can be cut in several ways, among characters without pieces: all segmentations of 60 characters, exactly."""
    rare = "\U00010400"
    text = rare * 20 + "ing" + rare * 17 + "the" + rare * 16
    every = dict(lattice_walks("".join(units_of(text))))
    assert len(units_of(text)) == 1 and 6 < len(every) < 60
    total = np.logaddexp.reduce(list(every.values()))
    found = S.sample([text], [3], k=100)[0]
    assert len(found) == len(every) and all(x == 1 for *_, x in found)
    assert len({tuple(i.tolist()) for i, *_ in found}) == len(found) and all(S.decode(i) == text for i, *_ in found)
    assert np.allclose(sorted(log for _, log, *_ in found), sorted(x - total for x in every.values()), atol=1e-9)
    n, first = 3000, Counter()
    for key in range(n):
        first[round(S.sample([text], [key], k=1)[0][0][1], 6)] += 1
    chances = Counter()
    for x in every.values():
        chances[round(x - total, 6)] += math.exp(x - total)
    for log, p in chances.items():
        assert abs(first[log] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 2 / n


def test_pieces_cross_every_place_of_a_long_unit():
    """How often a piece ends at each place of a unit of 5000 characters, against sums over all segmentations."""
    unit = units_of("nationalization" * 340)[0]
    lattices = Lattices(S, [unit])
    n, width = lattices.part.shape
    reached = np.zeros(n + width)
    reached[0] = 1
    for i in range(n):
        reached[i + 1 : i + 1 + width] += reached[i] * lattices.part[i]
    assert math.isclose(reached[n], 1, rel_tol=1e-9)
    seen = np.zeros(n + 1)
    runs = 400
    for key in range(runs):
        drawn = lattices.draw(np.zeros(1, dtype=np.int64), np.random.default_rng(key).random(1))
        seen[np.cumsum(np.array(lattices.lengths(0, drawn.of(0))) + 1)] += 1
    # places of one kind are taken together
    want, got = reached[1 : n - 20].reshape(-1)[: n // 15 * 15 - 30].reshape(-1, 15).mean(axis=0), seen[1 : n - 20][: n // 15 * 15 - 30].reshape(-1, 15).mean(axis=0) / runs
    assert np.abs(want - got).max() < 0.01 and ((want > 0.2) & (want < 0.8)).sum() >= 2


def test_the_rarest_segmentations_count():
    """Others of a chance below 1e-20, beyond any sum's last digit, are found by k, with inclusion 1."""
    rare = Sampler()
    rare.p = np.full(len(rare.p), 1e-30)
    rare.p[rare.pieces.index("▁the")] = 1.0
    rare.p[rare.table.size] = 0
    every = dict(lattice_walks("▁the", rare))
    found = rare.sample(["the"], [5], k=50)[0]
    assert len(found) == len(every) > 4 and all(x == 1 for *_, x in found)
    total = np.logaddexp.reduce(list(every.values()))
    assert np.allclose(sorted(log for _, log, *_ in found), sorted(x - total for x in every.values()))
    some = rare.sample(["the the"], [6], k=3)[0]
    assert len({tuple(i.tolist()) for i, *_ in some}) == 3 and some[0][3] > 0.999999


def test_cut_gumbels_stay_below_and_fit():
    u = np.random.default_rng(0).random(20_000)
    x = _cut_gumbel(np.zeros(20_000), np.full(20_000, 0.3), u)
    assert (x <= 0.3).all()
    want = math.exp(-math.exp(0.5)) / math.exp(-math.exp(-0.3))
    assert abs((x <= -0.5).mean() - want) < 0.02
    assert (_cut_gumbel(np.full(3, -np.inf), np.zeros(3), np.full(3, 0.5)) == -np.inf).all()


def test_units_and_bytes():
    assert units_of("") == [] and "".join(units_of("a  b c ")) == "▁a▁▁b▁c▁"
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("line\nend\ttab", "é 😀 漢字 \x00", "  two  ", "word" * 50, "ſt İ"):
        (ids, *_), = S.sample([text], [1], k=1)[0]
        assert S.decode(ids) == text and model.decode(ids.tolist()).strip(" ") == text.strip(" ")


def test_rows(odd, small, none, spark):
    for docs, rows in (odd, small):
        got = sampled_segmentations(docs, with_ids=True).collect()
        assert all(r.round_trip for r in got) and len({(r.doc_id, r.sample, tuple(r.ids)) for r in got}) >= len({(r.doc_id, r.sample) for r in got})
        empty = [r for r in got if r.n_pieces == 0]
        assert {r.doc_id for r in empty} == {r[0] for r in rows if not r[1]} and all(r.inclusion == 1 for r in empty)
        again = sampled_segmentations(docs.repartition(3)).collect()
        assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str(tuple(r)[:6]) for r in again)
    assert sampled_segmentations(none).collect() == []
