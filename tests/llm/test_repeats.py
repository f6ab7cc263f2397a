import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loamdex.llm import queries
from loamdex.llm.linededup import delete_repeats, digest
from loamdex.llm.substring import remove_repeats, split_words, word_factors

LAST = 1 << 63


def removed(rows, window):
    """Brute force over all windows."""
    first = {}
    order = sorted(rows, key=lambda r: LAST if r[0] is None else r[0])
    for doc, text, *_ in order:
        words = split_words(text)
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), LAST if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        words = split_words(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (LAST if doc is None else doc):
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)[:4]) for r in df.collect())


def test_words(odd, small, none):
    for docs, rows in (odd, small):
        assert rows_of(remove_repeats(docs)) == removed(rows, 50)
    assert remove_repeats(none).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_with_few_words(spark, seed):
    """Few words make many overlapping, periodic and nested repeats; a low limit sends some anchors the other way."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("ab", k=rng.randint(4, 30))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices("abcd", k=8)) for _ in range(rng.randint(0, 5)))
        rows.append((rng.choice([i, i, i, None]), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(remove_repeats(docs, window=9, gram=3)) == removed(rows, 9)
    assert rows_of(remove_repeats(docs, window=9, gram=3, hot=6)) == removed(rows, 9)


@pytest.mark.parametrize("hot", [1, 131072])
def test_colliding_hashes_remove_nothing(spark, hot):
    """Texts that share 8-word phrases, hashes of 2 bits: what goes has stood before, and no word else goes."""
    rng = random.Random(7)
    head = [f"phrase{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"{rng.random()}" for _ in range(25)), *head, *(f"{rng.random()}" for _ in range(25))])) for i in range(40)]
    rows += [(40 + i, f"{rng.random()} {rows[rng.randrange(40)][1]} {rng.random()}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.split(",")[0]: r for r in removed(rows, 50)}
    assert rows_of(remove_repeats(docs, hot=hot)) == sorted(want.values())
    got = {str(tuple(r)[:4]).split(",")[0]: r for r in remove_repeats(docs, hot=hot, bits=2).collect()}
    assert all(got[k].n_removed <= int(w.split(",")[2]) for k, w in want.items())
    assert all(got[f"({i}"].n_removed == 0 for i in range(40))
    lines = spark.createDataFrame([(i, t.replace(" ", "\n")) for i, t in rows], "doc_id long, text string")
    left = {r.doc_id: r for r in delete_repeats(lines, run=50, gram=8, hot=hot, bits=2).collect()}
    assert all(left[i].lines_removed == 0 for i in range(40))


def test_factors_point_to_what_they_repeat(small):
    docs, rows = small
    texts = {r[0]: split_words(r[1]) for r in rows}
    found = word_factors(docs).collect()
    assert found
    for f in found:
        assert f.of_doc < f.doc and f.end - f.start >= 50
        assert f.of_doc in texts
        assert texts[f.doc][f.start : f.end] == texts[f.of_doc][f.of_start : f.of_start + f.end - f.start]


def test_lines(spark, tmp_path, odd, none):
    license_ = "\n".join(f"License line {i} of the text." for i in range(6))
    rows = [
        (1, f"Start.\n{license_}\nEnd."), (2, f"{license_}\n"), (3, "x\n" + license_.split("\n", 3)[3] + "\ny"), (4, f"{license_}\n\nmiddle\n\n{license_}"), (5, "a\nb\nc\na\nb\nc\nd"),
        (6, None), (7, ""), (8, "  a \n\tb\n c"), (9, "a\nb"), (10, "a\n\nb\n\n\nc\r\nzz"), (11, "p\np\np\np\np\np"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in delete_repeats(docs).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "" and got[3].kept_text == "x\ny"
    assert got[4].kept_text == "\nmiddle\n" and got[5].kept_text == "a\nb\nc\nd"
    assert got[6].kept_text is None and got[7].lines_in == 0 and got[8].kept_text == "" and got[9].lines_removed == 0
    assert got[10].kept_text == "\n\n\nzz" and got[11].kept_text == "p"
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.OP9_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in digest(delete_repeats(docs)).collect())
    clash = docs.withColumns({c: F.lit("x") for c in ("lines_in", "lines_removed", "kept_text", "doc", "mark", "spans", "runs", "c0", "n0", "raw")})
    assert sorted(map(str, digest(delete_repeats(clash)).collect())) == sorted(map(str, digest(delete_repeats(docs)).collect()))
    kept = delete_repeats(odd[0])
    assert set(odd[0].columns) - {"text"} < set(kept.columns) and kept.count() == len(odd[1])
    assert delete_repeats(none).collect() == []
