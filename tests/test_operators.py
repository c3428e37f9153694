import pytest
from pyspark.sql import functions as F

from newsloom.operators import classify, dedup, evaluate, filters, graph, ingest, keywords, prepare
from newsloom.sources import files


def test_schema(spark):
    rows = spark.range(1).selectExpr("id", "'a' AS title", "'b' AS content", "'c' AS label", "1 AS more")
    prepare.validate_schema(rows)
    for lost in prepare.REQUIRED:
        with pytest.raises(ValueError, match=f"the table lacks {lost}$"):
            prepare.validate_schema(rows.drop(lost))


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a x"), (2, "a x"), (3, "b y")], "pos int, clean_text string")
    assert sorted(r.pos for r in dedup.deduplicate(df).collect()) == [1, 3]
    df = spark.createDataFrame([(1, "http://a", "a x"), (2, "http://a", "a y"), (3, "", "b z"), (4, "", "c w"), (5, None, "a x")], "pos int, url string, clean_text string")
    assert sorted(r.pos for r in dedup.deduplicate(df).collect()) == [1, 3, 4]


def test_class_minimum(spark):
    ok = spark.createDataFrame([("A",)] * 5 + [("B",)] * 5, "label string")
    prepare.check_class_min_samples(ok, 3)
    with pytest.raises(ValueError, match="fewer than 3 rows in: A has 2"):
        prepare.check_class_min_samples(spark.createDataFrame([("A",)] * 2 + [("B",)] * 10, "label string"), 3)


def test_split(spark, monkeypatch):
    """Whole numbers of each class by largest remainder, the same whatever the slices, and the rows by their hashes."""
    df = spark.range(331).withColumn("label", F.when(F.col("id") % 5 == 0, "x").when(F.col("id") % 3 == 0, None).otherwise("z")).withColumns({"rank": F.lit("r"), "class": F.lit("c")})
    got = prepare.stratified_split(df)
    assert got.columns == [*df.columns, "split"]
    rows = sorted(map(tuple, got.collect()), key=str)
    counts = {(r.split, r.label): r["count"] for r in got.groupBy("split", "label").count().collect()}
    assert sum(n for (s, _), n in counts.items() if s == "test") == 50 and sum(n for (s, _), n in counts.items() if s == "validation") == 50
    for label, n in (("x", 67), (None, 88), ("z", 176)):
        assert sum(c for (_, x), c in counts.items() if x == label) == n
        assert abs(counts["test", label] - 50 * n / 331) < 1 and abs(counts["train", label] - 231 * n / 331) < 1
    monkeypatch.setattr(prepare, "SLICE", 4)
    assert sorted(map(tuple, prepare.stratified_split(df.repartition(7)).collect()), key=str) == rows
    assert prepare.stratified_split(df.where("id < 0")).count() == 0
    monkeypatch.setattr(prepare, "MOST_CLASSES", 2)
    with pytest.raises(ValueError, match="more than 2 classes"):
        prepare.stratified_split(df)


def test_published_sizes(spark):
    s = prepare.stratified_split(spark.range(3246).withColumn("label", F.lit("A"))).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 2272, "validation": 487, "test": 487}


@pytest.mark.parametrize(("test", "val", "match"), [(1.5, 0.15, "between 0 and 1"), (0.15, -0.1, "between 0 and 1"), (0.6, 0.4, "nothing to train on")])
def test_split_arguments(test, val, match):
    prepare.validate_split_arguments(0.15, 0.15)
    with pytest.raises(ValueError, match=match):
        prepare.validate_split_arguments(test, val)


def test_filter_arguments():
    with pytest.raises(ValueError):
        filters.check_days("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        filters.within(0, 1, 100, "limit")


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)] + [(500, 500 + i) for i in range(1, 60)], "left long, right long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200 and all(got[500 + i] == 500 for i in range(60))
    assert graph.connected_components(e.where("left > 1000")).count() == 0


def test_insert_status(spark):
    old = spark.createDataFrame([("u1", "h1")], "url string, content_hash string")
    new = spark.createDataFrame([(1, "u1", "h9"), (2, "u2", "h1"), (3, "u3", "h3"), (4, "u3", "h4"), (5, "u5", "h3"), (6, "u2", "h6"), (7, "u7", "h9")], "pos int, url string, content_hash string")
    got = {r.pos: r.status for r in dedup.insert_status(new, old).collect()}
    assert got == {1: "DUPLICATE_URL", 2: "DUPLICATE_CONTENT", 3: "CREATED", 4: "DUPLICATE_URL", 5: "DUPLICATE_CONTENT", 6: "CREATED", 7: "CREATED"}


def test_insert_status_row_by_row(spark):
    import random

    rng = random.Random(3)
    old = [("u1", "h1"), ("u2", "h2")]
    batch = [(1, "a", "x"), (2, "b", "x"), (3, "b", "y")] + [(i, f"u{rng.randint(0, 40)}", f"h{rng.randint(0, 40)}") for i in range(4, 150)]
    urls, hashes, want = {u for u, _ in old}, {h for _, h in old}, {}
    for i, u, h in batch:
        want[i] = "DUPLICATE_URL" if u in urls else "DUPLICATE_CONTENT" if h in hashes else "CREATED"
        if want[i] == "CREATED":
            urls.add(u)
            hashes.add(h)
    kind = "url string, content_hash string"
    rows = spark.createDataFrame(batch, f"pos int, {kind}").repartition(3)
    assert want[3] == "CREATED" and {r.pos: r.status for r in dedup.insert_status(rows, spark.createDataFrame(old, kind)).collect()} == want
    assert dedup.insert_status(rows.where("pos < 0"), spark.createDataFrame([], kind)).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "news_id int, keyword string, n int")
    new = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 6, 2), (2, "c", 7, 1)], "news_id int, keyword string, n int, at int")
    got = dedup.upsert(old, new, ["news_id", "keyword"], "at").collect()
    assert {(r.news_id, r.keyword): r.n for r in got} == {(1, "a"): 6, (1, "b"): 2, (2, "c"): 7}


def test_fetch_whole_page(spark):
    page = "<p>" + "x" * 60_000
    assert files.fetch(spark.createDataFrame([("u",)], "url string"), lambda url: page).first().page == page


def test_feeds_and_fetch(spark):
    t = ingest.feeds(spark)
    assert [r.name for r in ingest.resolve_feeds(t, [" TuoiTre "]).collect()] == ["tuoitre"]
    with pytest.raises(ValueError, match="nope"):
        ingest.resolve_feeds(t, ["nope"])

    def get(url):
        if url == "bad":
            raise OSError
        return url * 10

    rows = spark.createDataFrame([("ab",), ("bad",), (None,)], "url string")
    got = {r.url: r.page for r in files.fetch(rows, get, retries=1, backoff=0.0, most_chars=5).collect()}
    assert got == {"ab": "ababa", "bad": None, None: None}


def test_predictions_are_checked(spark):
    batch = spark.createDataFrame([(1,), (2,)], "id int")
    ingest.check_predictions(batch, spark.createDataFrame([(1, "a", "OK"), (2, None, "UNKNOWN")], "id int, label string, status string"))
    for bad in ([(1, "a", "OK")], [(1, None, "OK"), (2, "b", "OK")], [(1, "a", "?"), (2, "b", "OK")]):
        with pytest.raises(ValueError):
            ingest.check_predictions(batch, spark.createDataFrame(bad, "id int, label string, status string"))


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "tàu vũ trụ bay lên. tàu vũ trụ đáp xuống", "Tàu Vũ Trụ"), (2, "giá vàng tăng và giá vàng giảm", ""), (3, "giá vàng hôm nay", None)], "id int, text string, title string")
    got = keywords.extract(docs, 3).collect()
    best = {i: max((r for r in got if r.id == i), key=lambda r: r.score) for i in (1, 2)}
    assert best[1].title_boost == 1.25 and "vũ trụ" in best[1].key
    assert all(not r.key.startswith("và ") and not r.key.endswith(" và") for r in got)
    assert all(sum(1 for r in got if r.id == i) <= 3 for i in (1, 2, 3))
    kept = keywords.occurrences(keywords.extract(docs))
    assert kept.count() == kept.select("news_id", "keyword").distinct().count() > 0
    with pytest.raises(ValueError):
        keywords.tfidf(docs.limit(1))


def test_confusion_and_averages(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "ground_truth string, prediction string").withColumn("correct", F.col("ground_truth") == F.col("prediction"))
    got = {r.label: (r.tp, r.fp, r.fn, r.precision) for r in evaluate.per_class(p).collect()}
    assert got["a"] == (1, 0, 1, 1.0) and got["b"][:3] == (1, 2, 0) and got["c"] == (0, 0, 1, 0.0)
    m = {r.ground_truth: r.b for r in evaluate.confusion_matrix(p).collect()}
    assert m == {"a": 1, "b": 1, "c": 1}


def test_classifier(spark):
    rows = [(i, ("cat dog pet fur " if i % 2 else "car road wheel fuel ") * 3, "pet" if i % 2 else "car") for i in range(40)] + [(99, "", "car"), (98, "zzz", "car")]
    df = spark.createDataFrame(rows, "id int, text string, label string").coalesce(1)
    model = classify.train(classify.with_tokens(df.where("id < 40")), min_df=2, rounds=5)
    got = {r.id: r for r in classify.predict(model, df).collect()}
    assert all(got[i].prediction == ("pet" if i % 2 else "car") and got[i].status == "OK" for i in range(40))
    assert got[99].status == got[98].status == "UNKNOWN" and got[99].prediction is None


def test_classifier_options(spark, tmp_path):
    """Labels by rank, two classes, sublinear frequencies, and a model that is saved and read again."""
    from pyspark.ml import PipelineModel

    words = {"pet": "cat dog pet fur ", "car": "car road wheel fuel ", "sky": "sun cloud rain wind "}
    rows = [(i, words[k] * (1 + i % 4), k) for i, k in enumerate(list(words) * 14)]
    df = spark.createDataFrame(rows, "id int, text string, label string").coalesce(1)
    model = classify.train(classify.with_tokens(df), min_df=2, rounds=5, sublinear=True)
    model.save(str(tmp_path / "model"))
    for m in (model, PipelineModel.load(str(tmp_path / "model"))):
        got = classify.predict(m, df, top=3).collect()
        for r in got:
            assert [x.label for x in r.labels][0] == r.prediction == r.label and len({x.label for x in r.labels}) == 3
            scores = [x.score for x in r.labels]
            assert scores == sorted(scores, reverse=True) and r.score == scores[0] and r.margin == pytest.approx(scores[0] - scores[1])
    two = df.where("label <> 'sky'")
    for r in classify.predict(classify.train(classify.with_tokens(two), min_df=2, rounds=5), two).collect():
        assert r.prediction == r.label and (r.score > 0) == (r.label == "pet") and r.margin == abs(r.score)
    assert len(classify.GRID) == 18
    best = classify.grid(classify.with_tokens(df), df, settings=[(1, 1, False), (2, 2, True)])
    assert best[0]["macro_f1"] == 1.0 and {b["sublinear"] for b in best} == {False, True}


def test_damped_counts(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.sparse(9, [1, 4], [1.0, 3.0]),), (Vectors.sparse(9, [], []),)], ["counts"])
    got = [r.damped.toArray().tolist() for r in classify.Sublinear(inputCol="counts", outputCol="damped").transform(df).collect()]
    assert got[0] == pytest.approx([0, 1, 0, 0, 2.09861228866811, 0, 0, 0, 0]) and got[1] == [0] * 9


def test_requests(spark):
    ok = spark.createDataFrame([("x",), ("y" * 20_000,)], "text string")
    ingest.check_requests(ok)
    for bad in ([], [("",)], [(None,)], [("z" * 20_001,)], [("x",)] * 101):
        with pytest.raises(ValueError):
            ingest.check_requests(spark.createDataFrame(bad, "text string"))


def test_stopword_files(spark, tmp_path):
    p = tmp_path / "stop.txt"
    p.write_text("\ufeffVà\n\n  # a note\n  của nhà \nvà\n", encoding="utf-8")
    assert files.read_stopwords(spark, str(p)) == ["của nhà", "và"]
    assert files.read_stopwords(spark, str(p), lines=False) == sorted({"và", "#", "a", "note", "của", "nhà"})
    p.write_text(" \n")
    assert files.read_stopwords(spark, str(p)) == [] and "và" in files.read_stopwords(spark, str(p), lines=False)
    p.write_text("a b c")
    with pytest.raises(ValueError):
        files.read_stopwords(spark, str(p), lines=False, most=2)


def test_fetch_rules(spark):
    """429 and 5xx are tried again, other failures are not; long pages are refused."""
    import tempfile

    log = tempfile.mkdtemp()

    def get(url):
        with open(f"{log}/{url}", "a") as f:
            f.write("x")
        with open(f"{log}/{url}") as f:
            n = len(f.read())
        return {"busy": (429, "", 0.0) if n < 3 else (200, "late"), "gone": (404, "no"), "down": (503, ""), "big": (200, b"y" * 100), "bytes": (200, "é".encode())}[url]

    rows = spark.createDataFrame([(u,) for u in ("busy", "gone", "down", "big", "bytes")], "url string").coalesce(1)
    found = files.fetch(rows, get, retries=2, backoff=0.0, most_bytes=50).collect()
    assert {r.url: r.page for r in found} == {"busy": "late", "gone": None, "down": None, "big": None, "bytes": "é"}
    tries = {u: len(open(f"{log}/{u}").read()) for u in ("busy", "gone", "down")}
    assert tries == {"busy": 3, "gone": 1, "down": 3}


def test_prepared_and_written(spark, tmp_path):
    """Raw rows to splits, their description, and sinks."""
    raw = spark.createDataFrame([(i, str(i), f" t{i} ", f"<p>text {i}</p>", "a" if i % 2 else "b", f"u{i}") for i in range(40)] + [(40, "40", None, None, "a", "u40"), (41, "41", "x", "y", None, "u41")], "pos int, no string, title string, content string, label string, url string")
    rows = prepare.prepare(raw, {"no": "id"})
    assert rows.count() == 40 and rows.where("clean_text <> concat('t', id, ' text ', id)").isEmpty()
    told = prepare.metadata(raw, rows, "v7").first()
    assert (told.raw_rows, told.kept_rows, told.categories, told.train_rows, told.version) == (42, 40, ["a", "b"], 28, "v7")
    files.write_splits(rows, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).where("split = 'test'").count() == 6
    files.write_csv(rows.select("id", "title"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "id string, title string").count() == 40
    files.write_json(rows.select("id"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 40
    files.replace(rows.select("id"), str(tmp_path / "t"))
    files.replace(rows.select("id").limit(3), str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).count() == 3
    train, test = (rows.where(f"split = '{s}'") for s in ("train", "test"))
    assert prepare.disjoint(train, test) and not prepare.disjoint(rows, test)
    prepare.require_labels(rows, "label")
    with pytest.raises(ValueError):
        prepare.require_labels(rows.withColumn("label", F.lit(" ")), "label")


def test_candidates(spark):
    items = spark.createDataFrame([(1, "http://a/?utm_x=1", "t", "c", "2024-01-05 00:00:00"), (2, "http://b", "t", "c", "2024-01-05 00:00:00"), (3, "http://c", "t", "new", "2024-02-05 00:00:00"), (4, "http://d", "t", "other", "2024-01-06 00:00:00")], "pos int, url string, title string, content string, published_at string").withColumn("published_at", F.to_timestamp("published_at"))
    import hashlib

    old = spark.createDataFrame([("http://a/", "-"), ("-", hashlib.sha256(b"t\nc").hexdigest())], "url string, content_hash string")
    assert [r.pos for r in ingest.candidates(items, old, "2024-01-01", "2024-01-31").collect()] == [4]


def test_few_values(spark):
    assert filters.few_values(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")) == ["a", "b"]
    with pytest.raises(ValueError):
        filters.few_values(spark.range(5), 4)


def test_scratch_goes_with_the_driver(tmp_path):
    """Nothing is left in the shared folder once the driver ends, and a cluster without one is refused."""
    import os
    import subprocess
    import sys

    code = """
from newsloom import session
spark = session.get_session("x", "local[2]", **{"spark.checkpoint.dir": "file://%s", "spark.ui.enabled": "false"})
a = session.materialize(spark.range(10), "a")
b = session.materialize(a, "b")
session.release(a)
assert b.count() == 10 and sum(x.startswith("newsloom-") for x in os.listdir("%s")) == 1 and [x[0] for x in os.listdir(session.scratch_dir(spark)[7:])] == ["b"]
""" % (tmp_path, tmp_path)  # fmt: skip
    subprocess.run([sys.executable, "-c", "import os" + code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("newsloom-")]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from newsloom import session

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none", master="spark://x"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        session.scratch_dir(cluster)


def test_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿id,title,content,label\n1,"a\nb","c ""q""",L\n', encoding="utf-8")
    (r,) = files.read_csv(spark, str(p)).collect()
    assert (r.id, r.title, r.content, r.label) == ("1", "a\nb", 'c "q"', "L")
    docs = spark.createDataFrame([(1, "a b")], "id int, text string")
    files.write_token_cache(docs, str(tmp_path / "c"), "v1")
    assert files.read_token_cache(docs, str(tmp_path / "c"), "v1").first().tokens == ["a", "b"]
    for d, v in ((docs, "v2"), (docs.union(spark.createDataFrame([(2, "x")], "id int, text string")), "v1")):
        with pytest.raises(ValueError):
            files.read_token_cache(d, str(tmp_path / "c"), v)


def test_stream(spark, tmp_path):
    from newsloom.streaming import ingest as stream

    (tmp_path / "in").mkdir()
    lines = ['{"url":"http://a/?utm_x=1","title":"t","content":"c","source":"s","published_at":"2024-01-01T00:00:00Z"}', '{"url":"http://a/","title":"t2","content":"c2","source":"s","published_at":"2024-01-01T00:01:00Z"}', '{"url":"http://b","title":"t","content":"c","source":"s","published_at":"2024-01-01T00:02:00Z"}']
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    q = stream.run(stream.read_items(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    (tmp_path / "in" / "2.json").write_text(lines[0])
    q = stream.run(stream.read_items(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["http://a/"]


def test_medians(spark):
    import random
    import statistics

    from newsloom.operators import evaluate

    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [rng.choice([1.0, 1.0 + 2**-52, 1e300, -1e300]) for _ in range(400)], "c": [5.0], "d": [1.5, -2.5], "e": [float("inf"), float("-inf"), 3.0, 4.0, 4.5], "f": [5e-324, 0.0, 1e-323] * 3, None: [2.0, 7.0, 7.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("a", float("nan")), ("z", None)]
    rng.shuffle(rows)
    got = {r.g: r.median for r in evaluate.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v", 8).collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}
    assert evaluate.medians(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_parts_are_cleaned_apart(spark):
    from newsloom.operators import prepare

    df = spark.createDataFrame([(1, "tin <script>x", "nội dung"), (2, None, " <b>a</b>\n&amp; b "), (3, "x <!-- ", "--> y"), (4, "", None)], "id int, title string, content string")
    got = {r.id: (r.title, r.content, r.text, r.clean_text) for r in prepare.add_clean_text(df).collect()}
    assert got[1] == ("tin", "nội dung", "tin nội dung", "tin nội dung")
    assert got[2][2] == "a & b" and got[3][3].endswith("y") and got[4] == ("", "", "", "")


def test_keywords_are_normalised_before_the_gate(spark):
    from newsloom.functions import text

    cases = [("giá ５ ３", 3, False), ("giá 5 3", 3, False), ("giá ５", 2, True), ("m² x", 2, True), ("x ² ３", 3, False), ("845.100 tệ ３ 3", 4, False), ("tin tức", 2, True), ("", 0, False)]
    df = spark.createDataFrame(cases, "p string, n int, want boolean")
    assert all(r.got == r.want for r in df.select("p", "want", text.is_valid_keyword(F.col("p"), F.col("n")).alias("got")).collect())


def test_substring_index(spark):
    import random
    import re

    from newsloom.operators import substring

    rng = random.Random(6)
    values = ["".join(rng.choice("abÄßc%_ ") for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "ab", "ABC abc"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(3)
    path = substring.build(df, "v")
    for pattern in ["%abc%", "abc%", "%ab_c%a%", "%ab\\%c%", "%äa%", "%a%", "abc", "%abcabcabc%", "", "%\\_ab%", "%bäc %"]:
        parts = re.findall(r"\\.|.", pattern.lower(), re.S)
        want = re.compile("".join({"%": ".*", "_": "."}.get(p, re.escape(p[-1])) for p in parts), re.S)
        got = {r.i for r in substring.search(df, "v", pattern, path).collect()}
        assert got == {i for i, v in enumerate(values) if v is not None and want.fullmatch(v.lower())}, pattern
    wanted = substring.fixed_grams(spark, "%abc%bca%")
    plan = substring.candidates(spark, path, wanted)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(wanted) == 2


def test_rewritten_documents_make_new_keywords(spark, small, tmp_path):
    from newsloom.sources import tables

    d = spark.read.parquet(f"{small}/documents.parquet")
    d.where("doc_id % 2 = 0").write.parquet(f"{tmp_path}/documents.parquet")
    first = tables.keyword_occurrences(spark, str(tmp_path)).select("news_id").distinct().count()
    d.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert tables.keyword_occurrences(spark, str(tmp_path)).select("news_id").distinct().count() > first
