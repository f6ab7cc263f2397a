import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import in_order

from loamdex.llm.fingerprint import PrefixHashes, edited, fingerprint, fingerprints, likeness


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé😀", max_size=60), st.text(alphabet="abé😀", max_size=60), st.data())
def test_spans_and_extensions_agree_with_slices(a, b, data):
    x, y = PrefixHashes(a), PrefixHashes(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    assert (x.span(i, n) == y.span(j, n)) == (a[i : i + n] == b[j : j + n])
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert x.common(i, y, j) == want
    assert (fingerprint(a) == fingerprint(b)) == (a == b)


def test_chunks_do_not_change_hashes(monkeypatch):
    import loamdex.llm.fingerprint as m

    text = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = fingerprint(text)
    monkeypatch.setattr(m, "_CHUNK", 257)
    assert fingerprint(text)[:30] == whole[:30]
    assert PrefixHashes(text).common(0, PrefixHashes(text[:4000] + "!"), 0) == 4000


@pytest.mark.parametrize("rows_per_shard", [2, 4096])
def test_rows(odd, small, many, spark, rows_per_shard):
    for docs, rows in (odd, small, many):
        order = in_order(rows)
        want = []
        for k, (has, doc_id, _, text) in enumerate(order):
            after = order[(k + 1) % len(order)][3]
            changed = edited(text, after)
            own, other = fingerprint(text), fingerprint(changed)
            sha = hashlib.sha256(changed.encode()).hexdigest()
            want.append((doc_id if has else None, len(text), sha, own, other, likeness(own, other), likeness(own, fingerprint(after))))
        got = [tuple(r)[:7] for r in fingerprints(docs, rows_per_shard).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_likeness_follows_shared_text(small):
    texts = [r[1] for r in small[1] if len(r[1]) > 400][:60]
    near = [likeness(fingerprint(t), fingerprint(edited(t, u))) for t, u in zip(texts, texts[1:])]
    far = [likeness(fingerprint(t), fingerprint(u)) for t, u in zip(texts, texts[1:])]
    assert sum(near) / len(near) > 0.35 and sum(far) / len(far) < 0.1


def test_no_rows(none):
    assert fingerprints(none).collect() == []


def test_one_row_follows_itself(spark):
    docs = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert fingerprints(docs).first().edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
