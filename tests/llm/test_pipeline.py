import importlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from loamdex.llm import queries
from loamdex.llm.mixing import mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == COLUMNS
            assert after.filter("n_chars <> length(text)").count() == 0
        if i < 3:
            # filtering stages keep nearly all documents, and each at most once
            assert 0.8 * counts[-1] <= after.count() <= counts[-1] and after.select("doc_id").distinct().count() == after.count()
        counts.append(after.count())
        docs = after
    assert docs.filter("NOT round_trip").count() == 0


def test_odd_rows_pass_through(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd[0]), ("none", none)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert importlib.util.find_spec("corpus_pipeline") is not None


def test_long_lines_are_deleted_as_a_run(spark):
    """One or two repeated lines of 50 words go in the pipeline; shorter ones stay."""
    long, half, short = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("long", 50), ("half", 25), ("short", 24)))
    texts = [f"a\n{long}\nb", f"c\n{long}\nd", f"{half}\n{half}x", f"e\n\n{half}\n{half}x", f"{short}\n{half}\nf", f"{short}\n{half}\ng", long, f"{long}\nh\n{long}", f"i\n{long} j\n{long} j"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: "c\nd", 2: texts[2], 3: "e\n", 4: texts[4], 5: texts[5], 7: "h", 8: f"i\n{long} j"}


def test_equal_texts_of_two_sources_both_stay_in_the_mix(spark):
    """Rows that differ in their source alone are mixed each by its own source; equal rows stand as often as there are such rows."""
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "en", "s", 0), (1, text, "en", "t", 0), (1, text, "en", None, 0), (2, "a b c", "en", "t", 0), (2, "a b c", "en", "t", 0), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    taken = {s: sum(r.taken for r in mix(docs).collect() if r.source == s) for s in ("s", "t", None)}
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and text.startswith(r.text) or "a b c".startswith(r.text)
    assert words == taken and len(taken) == 3 and min(taken.values()) > 0


def test_shards_stand_together_in_the_order_of_their_hash(spark, small):
    docs = small[0].select(*COLUMNS)
    got = corpus_pipeline.mix_sources(spark, docs, "").select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")).collect()
    shards = defaultdict(list)
    for r in mix(docs).collect():
        for p in r.passes:
            shards[p.shard].append((p.turn, r.doc_id))
    orders = [[doc for _, doc in sorted(rows)] for rows in shards.values()]
    # a shard's rows are the next ones of their order within one partition
    by_part = defaultdict(list)
    for r in sorted(got, key=lambda r: r.row):
        by_part[r.part].append(r.doc_id)
    assert sum(map(len, by_part.values())) == sum(map(len, orders)) > 200
    for part in by_part.values():
        at = 0
        while at < len(part):
            order = next(x for x in orders if x == part[at : at + len(x)])
            orders.remove(order)
            at += len(order)
    assert not orders


def test_planted_near_copies_go_and_clean_documents_stay(spark):
    """Copies with words replaced, cut at the end or appended, of a shingle similarity of 0.8 or more by brute force."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, want = [], {}
    for i in range(60):
        text = rng.choices(words, k=rng.randint(60, 400))
        copy = list(text)
        kind = i % 4
        if kind == 0:
            for _ in range(max(1, len(text) // 60)):
                copy[rng.randrange(len(copy))] = "other"
        elif kind == 1:
            copy = copy[: int(len(copy) * rng.uniform(0.8, 0.99))]
        elif kind == 2:
            copy += rng.choices(words, k=int(len(copy) * rng.uniform(0.01, 0.3)))
        else:
            copy = rng.choices(words, k=len(text))
        a, b = (set(zip(*(t[j:] for j in range(5)))) for t in (text, copy))
        want[1000 + i] = len(a & b) / len(a | b) < 0.8
        rows += [(i, " ".join(text), "en", "s", 0), (1000 + i, " ".join(copy), "en", "s", 0)]
    assert 20 < sum(want.values()) < 45
    kept = {r.doc_id for r in corpus_pipeline.dedup_near_copies(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert kept == set(range(60)) | {i for i, clean in want.items() if clean}


def _shuffled(spark):
    """Bytes written to shuffles by all stages so far, and the number of stages."""
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_dedup_shuffles_less_than_the_texts(spark, tmp_path):
    """Texts that stay are not shuffled, nor prefixes and counts of sets that share no key."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(2000)) for _ in range(200)]
    texts[150] = texts[20] + " more"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = _shuffled(spark)
    kept = {r.doc_id: r.text for r in corpus_pipeline.dedup_near_copies(spark, docs, "").select("doc_id", "text").collect()}
    assert kept == {i: t for i, t in enumerate(texts) if i != 150}
    assert _shuffled(spark) - before < 0.8 * sum(map(len, texts))
