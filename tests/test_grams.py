"""N-grams by blocks: any number of adding tasks, repeated identifiers, and plans in which no n-gram is a row of a shuffle."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import lower_tokens, raw_tokens
from newsloom.operators import grams, keywords
from newsloom.session import materialize

ROWS = [(1, "a b a_b c a b"), (2, "B a b"), (2, "x b a b"), (3, ""), (4, None), (5, " ..."), (6, "e"), (7, "b a B a b a b c d e f"), (None, "a b"), (None, "c a b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id int, text string").repartition(3).withColumn("title", F.lit("a b"))


def runs(words):
    return [" ".join(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_sums(docs, buckets):
    low = grams.dealt(docs, buckets, "id", "text", {grams.LOW: lower_tokens(F.col("text"))})
    got = grams.summed(low, buckets, "count").collect()
    want = Counter(g for _, t in ROWS if t for g in runs(re.findall(r"\w+", t.replace("_", " ").lower())))
    assert {r.gram: r["count"] for r in got} == want and len(got) == len(want) and all(r.n == len(r.gram.split()) for r in got)
    written = grams.dealt(docs, buckets, "id", "text", {grams.WRITTEN: raw_tokens(F.col("text"))})
    got = grams.summed(written, buckets, "df").collect()
    assert {r.gram: r.df for r in got} == Counter(g for _, g in {(i, g) for i, t in ROWS if t for g in runs(re.findall(r"\w+", t))})


def test_identifiers_that_repeat_are_one_document(docs):
    got = {(r.id, r.key): r for r in keywords.candidates(docs).collect()}
    assert (got[2, "b a b"].freq, got[None, "a b"].freq) == (2, 2) and len(got) == keywords.candidates(docs).count()
    assert got[2, "b a b"].display == "B a b" and got[7, "b a b"].display == "b a B"
    tf = {(r.id, r.gram): r.tf for r in keywords.tfidf(docs).collect()}
    assert tf[2, "a b"] == 2 and tf[None, "a b"] == 2


def test_no_shuffle_has_a_row_for_an_n_gram(docs):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan(keywords.candidates(docs))
    for df in (keywords.ngram_counts(docs), keywords.document_frequency(docs), keywords.tfidf(docs), keywords.phrase_pmi(docs), keywords.scored(docs), keywords.extract(docs)):
        dealt = re.findall(r"hashpartitioning\((\w+)#", plan(df))
        assert {*dealt} <= {"id", "block"}, dealt
        assert "Window" not in plan(df)


def test_stored_keywords_break_ties_as_sorted(spark, tmp_path):
    """Many equal scores, and a repeated word; no window or join sees all of a document's words."""
    from newsloom.sources import tables

    texts = [" ".join(f"word{i:04d}" for i in range(k, 900 + k)) + " twice twice" * (k % 2) for k in range(4)] + ["", None, "four"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {i: sorted((r for r in tables.make_keyword_occurrences(spark, str(tmp_path)).collect() if r.news_id == i), key=lambda r: (-r.final_score, r.keyword)) for i in range(7)}
    assert [r.keyword for r in rows[0]] == ["word0000", *(f"word{i:04d}" for i in range(1, 10))]
    assert rows[1][0].keyword == "twice" and rows[1][0].frequency == 2 and len(rows[1]) == 10
    assert [r.keyword for r in rows[3]][:2] == ["twice", "word0902"] and not rows[4] and not rows[6]


def near(rows):
    return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows}


def test_many_blocks_give_what_one_gives(spark, monkeypatch):
    """Passages that some blocks share, and n-grams of one block alone whose words all blocks have."""
    rng = random.Random(4)
    said = [" ".join(rng.choice("a b c d E f1 g_h".split()) for _ in range(9)) for _ in range(5)]
    docs = [(i, " ".join(rng.choice([*said, "b", f"w{rng.randint(0, 60)}", "a c a"]) for _ in range(rng.randint(0, 12))), rng.choice(["a b", "w1", None])) for i in range(80)]
    docs = spark.createDataFrame(docs, "id int, text string, title string")
    ways = [keywords.tfidf, keywords.phrase_pmi, keywords.scored]
    one = [f(docs).collect() for f in ways]
    monkeypatch.setattr(grams, "buckets_of", lambda docs, text: 7)
    for f, want in zip(ways, one, strict=True):
        got = f(docs).collect()
        assert len(got) == len(want) and near(got) == near(want)


def test_longer_grams_of_one_block_alone_are_not_sent(spark):
    """Each of three tasks has a block; all have one passage and a text of words in an order of its own."""
    words = [f"w{i}" for i in range(40)]
    docs = [(i, f"p q r s t u. {' '.join(random.Random(i).sample(words, 40))}") for i in range(3)]
    docs = spark.createDataFrame(docs, "id int, text string")
    rows = docs.repartitionByRange(3, "id").sortWithinPartitions("id").select("id", lower_tokens(F.col("text")).alias(grams.LOW))
    blocks = materialize(grams.packed_blocks(rows), "blocks")
    assert blocks.count() == 3
    asked = []

    def sent(rows, names, buckets, counted, rounds, known=None):
        out = real(rows, names, buckets, counted, rounds, known)
        asked.append(sum(grams.opened(bytes(r.data), 2)[0][0].size for r in out.collect()))
        return out

    real, grams.sent = grams.sent, sent
    try:
        got = grams.met(blocks, [grams.LOW], 3, ["count"], lambda block, sums: iter([grams.pa.RecordBatch.from_arrays([grams.pa.array(sums[0])], ["c"])]), "c long").collect()
    finally:
        grams.sent = real
    assert len(got) == 3 * (46 + 45 + 44 + 43 + 42) and asked[0] == 3 * (46 + 45)
    assert 3 * 4 <= asked[1] <= 3 * 12 and 3 * (3 + 2) <= asked[2] <= 3 * 12, asked
    assert Counter(r.c for r in got)[3] >= 3 * (46 + 5 + 4 + 3 + 2)


def test_written_tables_leave_no_shuffle(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = blocks.getAllBlocks().size()
    found = materialize(spark.range(1000).repartition(4, "id"), "t")
    assert blocks.getAllBlocks().size() <= before
    assert found.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_batches_to_python_are_small(spark):
    from newsloom.session import bounded_batches

    bounded_batches(spark)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    sizes = [r.b for r in rows.mapInArrow(lambda bs: (grams.pa.RecordBatch.from_arrays([grams.pa.array([b.nbytes])], ["b"]) for b in bs), "b long").collect()]
    assert sum(sizes) >= 15_000_000 and max(sizes) <= 5 << 20


def test_a_tasks_text_is_sent_in_one_block(spark):
    """Rows of the shuffle are blocks times tasks that add up: one task's 600,000 words go to seven in seven rows."""
    words = F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: F.concat(F.lit("w"), (x * (F.col("id") + 1) % 1000).cast("string")))
    rows = spark.range(0, 2, 1, 1).select("id", words.alias(grams.WRITTEN))
    assert grams.sent(rows, [grams.WRITTEN], 7, ["df"], [(1, 1)]).count() == 7
    got = {r.gram: r.df for r in grams.summed(rows, 7, "df", 1, lengths=False).collect()}
    assert got == {f"w{i}": 2 - i % 2 for i in range(1000)}


def test_long_and_equally_long_words(spark):
    texts = [f"{'a' * 300} {'b' * 300} {'a' * 300} c", f"{'b' * 300} {'a' * 299} {'a' * 300}", "aa bb aa bb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.split("text", " ").alias(grams.WRITTEN)).repartition(3)
    got = grams.summed(rows, 3, "df").collect()
    want = Counter(g for _, g in {(i, g) for i, t in enumerate(texts) for g in runs(t.split())})
    assert {r.gram: r.df for r in got} == want and len(got) == len(want) and all(r.n == len(r.gram.split()) for r in got)


@pytest.mark.parametrize("most", [10, 1 << 40, (1 << 63) - 1])
def test_numbers_in_order(most):
    rng = grams.np.random.default_rng(1)
    for numbers in (rng.integers(0, most, 3000), rng.integers(most - 3, most, 3000), grams.np.empty(0, grams.np.int64)):
        order, of = grams.in_order(numbers, most)
        assert (order == grams.np.argsort(numbers, kind="stable")).all() and (of == numbers[order]).all()


def test_longer_grams_are_sent_as_their_last_word(spark):
    """Two documents of 20,000 words each, dealt in one block; whole n-grams took some 12 bytes each."""
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(20_000)) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).select("id", F.split("text", " ").alias(grams.WRITTEN))
    sent = [bytes(r.data) for r in grams.sent(rows, [grams.WRITTEN], 3, ["df"], [(1, 5)]).collect()]
    found = sum(grams.opened(d, 2)[0][0].size for d in sent)
    assert found > 150_000 and sum(map(len, sent)) < 3 * found
    got = {r.gram: r.df for r in grams.summed(rows, 3, "df").collect()}
    assert got == Counter(g for t in texts for g in {*runs(t.split())}) and len(got) < found + 1


def test_sums_stand_beside_those_that_go_on_from_them(spark):
    """Parquet packs them well so: a row of four or five words follows one that it starts with, or one that starts as it does."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghijkl") for _ in range(300))) for i in range(4)], "id int, text string").select("id", F.split("text", " ").alias(grams.LOW))
    found = [r.gram.split() for r in grams.summed(rows, 1, "count").collect()]
    pairs = [(a, b) for a, b in zip(found, found[1:]) if len(b) > 3]
    assert len(pairs) > 1000 and all(a[:3] == b[:3] for a, b in pairs)


def test_candidates_stand_as_in_the_text(spark):
    """Parquet packs them well so: a document's candidates come by their first place, each before those that go on from it."""
    docs = spark.createDataFrame([(i, " ".join(f"Word{(7 * i + j) % 50}" for j in range(50))) for i in range(3)], "id int, text string")
    rows = keywords.candidates(docs).collect()
    by = {i: [r.key.split() for r in rows if r.id == i] for i in range(3)}
    want = [[f"word{(7 * i + j + k) % 50}" for k in range(n)] for i in range(3) for j in range(50) for n in range(1, 6) if j + n <= 50]
    assert [k for i in range(3) for k in by[i]] == want and all(r.display == r.key.title() and r.n == len(r.key.split()) for r in rows)


def test_a_block_goes_when_it_is_done(spark):
    """A worker held every block that it had made until a full collection of garbage."""
    import gc
    import weakref

    words = grams.pa.array([["a", "b", "a", "b", "c"], ["b", "c"]])
    gc.disable()
    try:
        block = grams.Block.made(grams.pa.array([1, 2]), grams.np.arange(2), {grams.LOW: words})
        assert [len(first) for *_, first in block.levels()] == [3, 3, 3, 2, 1]
        held = weakref.ref(block)
        del block
        assert held() is None
    finally:
        gc.enable()


def test_keywords_are_picked_in_their_block(docs):
    """One Python stage makes candidates and picks keywords: no second one beside it, with workers of its own and rows for each candidate."""
    df = keywords.extract(docs)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.id, r.key, r.score) for r in df.collect()} < {(r.id, r.key, r.score) for r in keywords.scored(docs).collect()}
