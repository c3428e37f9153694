"""The existence index against lists in memory, and what a batch reads of it."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import existence, ingest
from newsloom.operators.dedup import insert_status

KIND = "pos int, url string, content_hash string"


def records_read(spark, after):
    """Records that stages after a number read of files, and the last stage's number."""
    g = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    found = [(stages.apply(i).stageId(), stages.apply(i).inputRecords()) for i in range(stages.size())]
    return sum(n for s, n in found if s > after), max((s for s, _ in found), default=-1)


def test_batches_decide_as_one_by_one(spark, tmp_path):
    """Batches of 20 over a growing history: the same statuses as inserting row by row."""
    rng, root = random.Random(5), str(tmp_path / "index")
    urls, hashes = set(), set()
    for number in range(10):
        batch = [(i, f"u{rng.randrange(900)}" if i % 3 else f"new{number}-{i}", None if i == 7 else f"h{rng.randrange(900)}") for i in range(20)]
        want = {}
        for i, u, h in batch:
            want[i] = "DUPLICATE_URL" if u in urls else "DUPLICATE_CONTENT" if h in hashes else "CREATED"
            if want[i] == "CREATED":
                urls.add(u)
                hashes.add(h)
        existence.merge(spark, root, number, fanout=3, capacity=64)
        rows = spark.createDataFrame(batch, KIND).coalesce(1)
        decided = insert_status(rows, existence.known(rows, root, number))
        assert {r.pos: r.status for r in decided.collect()} == want, number
        for _ in range(1 + (number == 5)):  # a batch that is repeated replaces itself
            existence.append(decided.where("status = 'CREATED'"), root, number, capacity=64)
    found = existence.runs(spark, root)
    assert [(r.first, r.last) for r in found] == [(0, 8), (9, 9)]
    stored = sum(spark.read.parquet(f"{r.path(root)}/keys").count() for r in found)
    assert stored == len(urls) + len(hashes) and max(r.depth for r in found) > 0


def test_a_batch_reads_what_it_asks_for(spark, tmp_path):
    """What a lookup reads is bounded by its keys and the size of a folder, and does not grow with the history; fresh keys read (but for the filter's few errors) words only."""
    ask = [(f"u{i}", f"h{i}") for i in range(0, 9000, 900)]
    fresh = [(f"fresh{i}", f"x{i}") for i in range(10)]
    read = {}
    for n in (10_000, 40_000):
        root = str(tmp_path / f"index{n}")
        old = spark.range(n).selectExpr("concat('u', id) url", "concat('h', id) content_hash")
        existence.append(old, root, 0, capacity=256)
        (run,) = existence.runs(spark, root)
        assert 2 * n / 256 <= 1 << run.depth < 4 * n / 256
        for name, keys, hits in (("ask", ask, 10), ("fresh", fresh, 0)):
            batch = spark.createDataFrame(keys, "url string, content_hash string").coalesce(1)
            _, last = records_read(spark, -1)
            have = existence.known(batch, root)
            read[name, n], _ = records_read(spark, last)
            assert [have[c].count() for c in existence.COLUMNS] == [hits, hits]
    # 20 keys: words of at most 20 folders (some 50 each), and of those that are stored the keys of their folders (some 156).
    assert all(read["ask", n] < 20 * (64 + 200) + 500 and read["fresh", n] < 20 * 64 + 3 * 200 + 100 for n in (10_000, 40_000)), read
    assert read["ask", 40_000] < 1.3 * read["ask", 10_000], read


def test_filter_lets_few_through(spark, tmp_path):
    """Words let all stored keys through, and under 2 % of others."""
    root = str(tmp_path / "index")
    existence.append(spark.range(20_000).selectExpr("concat('u', id) url", "concat('h', id) content_hash"), root, 0, capacity=1000)
    (run,) = existence.runs(spark, root)
    words = spark.read.schema(existence.WORD).parquet(f"{run.path(root)}/words")

    def passed(rows):
        k = existence.keys_of(rows).withColumn("slot", existence._prefix(run.size)).withColumn("mask", existence._mask())
        return words.join(k, "slot").where("(bits & mask) = mask").count()

    assert passed(spark.range(20_000).selectExpr("concat('u', id) url", "concat('h', id) content_hash")) == 40_000
    assert passed(spark.range(20_000).selectExpr("concat('v', id) url", "concat('g', id) content_hash")) < 800


def test_edges(spark, tmp_path):
    root, none = str(tmp_path / "index"), spark.createDataFrame([], "url string, content_hash string")
    one = spark.createDataFrame([("a", None), ("", "h")], "url string, content_hash string")
    assert existence.runs(spark, root) == [] and existence.known(one, root)["url"].count() == 0
    existence.append(none, root, 0)
    assert existence.runs(spark, root) == []
    existence.append(one, root, 1)
    got = existence.known(spark.createDataFrame([(None, None), ("", "a")], "url string, content_hash string"), root)
    assert [r[0] for r in got["url"].collect()] == [""] and [r[0] for r in got["content_hash"].collect()] == [None]
    assert existence.known(none, root)["url"].count() == 0
    with pytest.raises(ValueError):
        existence.append(one, root, 0)


def test_a_writer_that_dies_leaves_the_old_runs(spark, tmp_path):
    """A merged run without its words does not count; the next merge makes it anew."""
    root = str(tmp_path / "index")
    for n in range(4):
        existence.append(spark.createDataFrame([(f"u{n}", f"h{n}")], "url string, content_hash string"), root, n)
    dead = existence.Run(0, 3, 0, 1)
    spark.createDataFrame([("url", "lost", 1, 0)], existence.KEY).write.partitionBy("bucket").parquet(f"{dead.path(root)}/keys")
    ask = spark.createDataFrame([("u2", "h9"), ("lost", "h3")], "url string, content_hash string")
    for _ in range(2):
        have = existence.known(ask, root)
        assert [r[0] for r in have["url"].collect()] == ["u2"] and [r[0] for r in have["content_hash"].collect()] == ["h3"]
        existence.merge(spark, root, 4, fanout=4)
    assert [r[:2] for r in existence.runs(spark, root)] == [(0, 3)]


def test_candidates_by_the_index(spark, tmp_path):
    """The check before fetching gives the same by the index as by the stored rows."""
    kind = "pos int, url string, title string, content string, published_at timestamp_ntz"
    items = spark.createDataFrame([(i, f"http://a/{i % 7}", "t", f"c{i}", None) for i in range(20)], kind).selectExpr("pos", "url", "title", "content", "timestamp'2024-01-05 00:00:00' published_at")
    old = ingest.candidates(items, spark.createDataFrame([], "url string, content_hash string")).where("pos in (1, 2, 12)").select("url", "content_hash")
    existence.append(old, str(tmp_path / "index"), 0)
    want = sorted(r.pos for r in ingest.candidates(items, old).collect())
    assert want and sorted(r.pos for r in ingest.candidates(items, str(tmp_path / "index")).collect()) == want


def test_stream_batches(spark, tmp_path):
    """Batches stored by the stream's function: a table without an index gets one, repeats replace themselves, another stream's are refused."""
    from newsloom.streaming import ingest as stream

    path = str(tmp_path / "news")
    store = stream.store_batches(path)

    def items(*names):
        return spark.createDataFrame([(f"http://{n}", n, "c", "s") for n in names], "url string, title string, content string, source string").selectExpr("*", "timestamp'2024-01-01 00:00:00' published_at")

    store(items("a", "b"), 0)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "-known"), True)
    store(items("b", "c", "d"), 1)
    store(items("b", "c", "d"), 1)
    store(items("a", "d", "e"), 2)
    got = sorted((r.url, r.batch) for r in spark.read.parquet(path).collect())
    assert got == [("http://a", 0), ("http://b", 0), ("http://c", 1), ("http://d", 1), ("http://e", 2)]
    status = spark.read.parquet(path + "-status").orderBy("batch").collect()
    assert [(r.batch, r.articles_parsed, r.articles_created, r.articles_duplicate) for r in status] == [(0, 2, 2, 0), (1, 3, 2, 1), (2, 3, 1, 2)]
    assert set(spark.read.parquet(path).columns) == {"url", "title", "content", "source", "published_at", "content_hash", "batch"}
    with pytest.raises(ValueError):
        store(items("z"), 1)


def test_counts_in_the_job_that_writes(spark, tmp_path):
    """One job over the items writes what is kept and counts all; no items give zeros."""
    kind = "id int, fate string, content_source string"
    items = spark.createDataFrame([(1, "CREATED", "fulltext"), (2, "DUPLICATE_URL", "rss_fallback"), (3, "DATE", None), (4, "KNOWN", None), (5, "SKIPPED", "fulltext"), (6, None, None)], kind)
    spark.sparkContext.setJobGroup("counted", "counted")
    counts = ingest.write_counted(items, str(tmp_path / "a"), F.col("fate") == "CREATED")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) == 1 and [r.id for r in spark.read.parquet(str(tmp_path / "a")).collect()] == [1]
    assert tuple(counts[c] for c in ingest.ARTICLE_COUNTS) == (6, 1, 1, 2, 3, 1, 2, 1)
    assert ingest.counters(spark, counts).first().asDict() == items.agg(*ingest.article_counts()).first().asDict()
    for none in (items.where("id < 0"), items.where("false")):
        assert not any(ingest.write_counted(none, str(tmp_path / "b"), F.col("fate") == "CREATED").values())
