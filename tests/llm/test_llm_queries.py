"""The registered queries against their SQL, and the pipeline against its stages, on the smallest tables."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.llm import queries, toxicity


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"pipeline"}))
def test_query(spark, small, duck, name):
    df = queries.queries()[name](spark, small)
    rows = df.collect()
    assert len(rows) == {"op7_warc": 50, "op11_collocations": len(rows), "op12_filter_audit": 2400}.get(name, 200)
    if name in queries.SQL:
        r = duck.execute(queries.SQL[name])
        columns = sorted(c[0] for c in r.description)
        at = [[c[0] for c in r.description].index(c) for c in columns]
        assert columns == sorted(df.columns)
        assert sorted(tuple(norm(x[c]) for c in columns) for x in rows) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def odd_documents(spark, small):
    """The documents, with rows that have nulls, empty texts, repeats and further columns."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    some = docs.orderBy("doc_id").limit(3)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0), (None, "some words without an identifier", None, None, 5), (9004, "tiny", "en", None, 4)], docs.schema)
    return docs.unionAll(some).unionAll(odd).withColumns({c: F.lit(c) for c in ("row", "key", "rank", "copies", "_toxic_probability")})


def test_stages(spark, small):
    """Each stage of the pipeline against a plain version of what it keeps, on documents with odd rows."""
    import corpus_pipeline

    docs = odd_documents(spark, small)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        before = [tuple(r) for r in docs.collect()]
        docs = stages[name](spark, docs, small).cache()
        assert docs.columns == columns
        return before, [tuple(r) for r in docs.collect()]

    text, doc_id, source = columns.index("text"), columns.index("doc_id"), columns.index("source")
    verdicts = {(r.doc_id, r.toxic) for r in toxicity.classify(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    before, after = step("toxicity")
    assert Counter(after) == Counter(r for r in before if (r[doc_id], False) in verdicts)

    before, after = step("exact dedup")
    best = {}
    for r in before:
        best[r[text] or ""] = max(best.get(r[text] or "", -1), -1 if r[doc_id] is None else r[doc_id])
    assert sorted((r[text] or "", -1 if r[doc_id] is None else r[doc_id]) for r in after) == sorted(best.items())

    before, after = step("simhash near-dedup")
    order = sorted(before, key=lambda r: (r[doc_id] is None, r[doc_id] or 0))
    sets = []
    for r in order:
        w = (r[text] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(order)))
    near = [(i, j) for i in group for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in order:
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
    assert Counter(after) == Counter(order[i] for i in set(group))

    before, after = step("mixing")
    size = lambda r: len((r[text] or "").split())
    of = Counter()
    for r in before:
        of[r[source]] += size(r)
    names = sorted(s for s in of if s is not None) + [None] * (None in of)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(of.values()), set(names), {}
    while over := {s for s in free if left * weight[s] / sum(weight[t] for t in free) >= 2 * of[s]}:
        total = sum(weight[t] for t in free)
        for s in over:
            target[s] = 2 * of[s]
        left, free = left - sum(target[s] for s in over), free - over
        assert free or not total
    target |= {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
    want = Counter()
    for s in names:
        rows = sorted((r for r in before if r[source] == s), key=lambda r: (hashlib.md5(f"42:{'' if r[doc_id] is None else r[doc_id]}".encode()).hexdigest(), size(r)))
        cut = int(target[s] + 0.5)
        whole = cut // of[s] if of[s] else 0
        rest = cut - whole * of[s]
        for r in rows:
            want[r] += whole + (2 * rest > size(r))
            rest -= size(r)
    assert Counter(after) == +want

    out = stages["bpe"](spark, docs, small)
    assert out.count() == len(after)
    empty = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < -1")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, docs.collect()))
