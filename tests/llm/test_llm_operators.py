"""Each operator against a plain version, on cases with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import bpe, collocations, exact_dedup, filter_audit, fingerprint, hyper_minhash, licenses, mixing, near_copies, sharding, simhash, substring_dedup, toxicity, warc

#: Names that operators use inside, or that one could take for such; what is in these columns has to pass through.
EXTRA = "row none hot salt hash start rank null sha winner number copies rows times fp bits first component_id keep_id _id _key _hash _rank _start _none _toxic_probability toxic_probability low_quality_probability".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size string, part string, `order` string, " + ", ".join(f"`{c}` string" for c in EXTRA)


def rows(seed=1, n=120):
    """Documents with shared passages, copies, near copies and odd ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(70)] for _ in range(4)]
    texts = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            p = rng.choice(passages)
            a, b = rng.randint(0, 15), rng.randint(52, 70)
            t[len(t) // 2 : len(t) // 2] = p[a:b]
        texts.append(" ".join(t))
    texts += [texts[3]] * 5 + [texts[6] + " tail"] + [None, "", "  \t\n", "A B", "Ünï  cödé\x0bx 日本 🙂", "w1 " * 5000, None, ""]
    out = [(i, t, "en", f"s{i % 5}" if i % 7 else None, 0, i, "k", "z", "p", "o", *EXTRA) for i, t in enumerate(texts)]
    return out + [out[3], (None, texts[3], *out[3][2:]), (None, None, *out[3][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in rows()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def passes_through(docs, kept):
    """Rows of kept are rows of docs, whatever their columns are called."""
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()} and rows
    return rows


def test_sharding(docs, plain, empty):
    got = sharding.byte_shards(docs).collect()
    last = float("inf")
    ordered = sorted(((last if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in plain))
    total, at, slots, want = sum(r[2] for r in ordered), 0, defaultdict(int), []
    for i, crc, size in ordered:
        shard = 16 * (2 * at + size) // (2 * total)
        want.append((None if i == last else i, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        at += size
    same(got, want)
    assert sharding.byte_shards(empty).count() == 0


@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup(docs, plain, empty, largest, monkeypatch):
    for least in (1000, 3):  # 3: some texts are hot
        monkeypatch.setattr(exact_dedup, "HOT_LEAST", least)
        groups = defaultdict(list)
        for i, t in plain:
            groups[t or ""].append(i)
        key = lambda i: (i is not None, i or 0)
        want = []
        for t, ids in groups.items():
            keep = (max if largest else min)(ids, key=key)
            first = True
            for i in ids:
                want.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
                first &= i != keep
        same(exact_dedup.duplicate_groups(docs, largest=largest).collect(), want)
        kept = exact_dedup.drop_duplicates(docs, largest=largest)
        passes_through(docs, kept)
        same(kept.select("doc_id", F.coalesce("text", F.lit(""))).collect(), [((max if largest else min)(ids, key=key), t) for t, ids in groups.items()])
    assert exact_dedup.duplicate_groups(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0


@pytest.mark.parametrize("length", [50, 7])
def test_substring_dedup(docs, plain, empty, length):
    top = float("inf")
    first = {}
    split = [(top if i is None else i, (t or "").encode().split()) for i, t in plain]
    for i, w in split:
        for k in range(len(w) - length + 1):
            h = tuple(w[k : k + length])
            first[h] = min(first.get(h, top), i)
    want = []
    for i, w in split:
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        want.append((None if i == top else i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    same(substring_dedup.remove_repeats(docs, length).collect(), want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    out = {f: f for f in fps}

    def find(f):
        while out[f] != f:
            f = out[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                out[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs, plain, empty):
    prints = {t: brute_fingerprint(t) for _, t in plain}
    of = brute_components({*prints.values()})
    least = {}
    for i, t in plain:
        c = of[prints[t]]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    same(simhash.near_duplicates(docs).collect(), [(i, f"{prints[t]:016x}", least[of[prints[t]]]) for i, t in plain])
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in passes_through(docs, kept)) == sorted(least.values())
    assert simhash.near_duplicates(empty).count() == 0


def near_texts(seed=2):
    """Texts with edited copies of all degrees, chains of them, and a line that most share."""
    rng = random.Random(seed)
    words, line = [f"w{i}" for i in range(400)], " ".join(f"hot{i}" for i in range(12))
    texts = [None, "", " \t", "one two", "One two", "one two three", "a b c d e f", "a b c d e g"]
    for _ in range(12):
        t = [rng.choice(words) for _ in range(rng.randint(5, 160))]
        for _ in range(8):
            texts.append(" ".join([*t, line] if rng.random() < 0.6 else t))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            t = t[: len(t) - rng.randint(0, 2)] or ["x"]
    return texts


def plain_groups(texts):
    """(the least place reachable from each text, the links)"""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(texts)))
    linked = [(i, j) for i in least for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    return least, [p for p in linked if len(sets[p[0]] ^ sets[p[1]]) > 2]


def test_near_copies(spark):
    import corpus_pipeline

    texts = near_texts()
    least, links = plain_groups(texts)
    assert len(links) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.id: r.component_id for r in near_copies.components(docs).collect()} == dict(enumerate(least))
    kept = corpus_pipeline.drop_near(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least))
    assert near_copies.components(docs.where("doc_id < 0")).count() == 0


def test_near_copies_by_leaders(spark, monkeypatch):
    """As in very large groups: further leaders, and what a fingerprint has alone, are needed."""
    monkeypatch.setattr(near_copies, "PAIRS", 0)
    texts = near_texts(3)[:34]
    least, links = plain_groups(texts)
    assert links
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {r.id: r.component_id for r in near_copies.components(docs).collect()} == dict(enumerate(least))


@pytest.mark.parametrize(("crowd", "groups"), [(256, 4), (256, 8), (2, 4)])
def test_near_pairs(spark, crowd, groups):
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:40]:
        for _ in range(12):
            f ^= 1 << rng.randrange(64)
            f ^= rng.choice([0, 1 << rng.randrange(64), 1 << rng.randrange(64) | 1 << rng.randrange(64)])
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    pairs = simhash.near_pairs(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), crowd, groups).collect()
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in pairs)
    want, got = brute_components(fps), {f: f for f in fps}

    def find(f):
        while got[f] != f:
            f = got[f]
        return f

    for a, b in pairs:
        got[find(a & mask)] = find(b & mask)
    shape = lambda m: {frozenset(f for f in fps if m(f) == r) for r in {m(f) for f in fps}}
    assert shape(find) == shape(want.__getitem__)


def test_mixing(docs, plain, empty, monkeypatch):
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    source = {}
    for r in rows():
        source[r[3]] = source.get(r[3], 0) + size(r[1])
    names = sorted((s for s in source if s), key=str) + [None] * (None in source)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(source.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * source[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * source[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    of = {(r[0], size(r[1])): r[3] for r in rows()}
    taken = defaultdict(int)
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.target == pytest.approx(target[s]) and r.source_size == source[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows()) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    same(got, map(tuple, mixing.mix(docs.repartition(3)).collect()))
    for rows_a_slice in (64, 2):  # the slices change nothing
        monkeypatch.setattr(mixing, "SLICE", rows_a_slice)
        same(got, map(tuple, mixing.mix(docs).collect()))
    many = mixing.mixed_documents(docs)
    passes_through(docs, many)
    words = many.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    longest = max(size(r[1]) for r in rows())
    assert all(abs(r.n - target[r.source]) <= longest for r in words)
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_warc(spark):
    rng = random.Random(3)
    long = ["".join(rng.choice("abcdefgh <>") for _ in range(1000 + 10 * i)) for i in range(30)]
    pages = [(i, f"http://a/{i}", long[i % 30] if i % 4 else "short", "x") for i in range(200)] + [(500, None, None, "x"), (501, "u", "", "x"), (502, "u\r\nX: y", "é" * 600, "x"), (503, "u", "é" * 600, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    last = {}
    for i, _, h, _ in pages:
        last[h or ""] = max(i, last.get(h or "", -1))
    want = []
    for i, _, h, _ in pages:
        data = (h or "").encode()
        again = len(data) >= 1000 and last[h] != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    same(warc.archive_pages(df).drop("url").collect(), want)
    assert warc.archive_pages(df.where("page_id < 0")).count() == 0
    twice = warc.archive_pages(df.where("page_id = 503").unionAll(df.where("page_id = 503"))).collect()
    assert sorted((r.record_type, r.refers_to) for r in twice) == [("response", None), ("revisit", 503)]
    odd = [(9, "b", long[0]), (9, "a", long[0]), (9, "a", long[0]), (9, None, long[0]), (9, None, long[0]), (3, "a", long[0]), (None, "n", long[0]), (None, "n", long[1]), (None, "m", long[1]), (4, "x", "y" * 999), (4, "x", "y" * 999)]
    got = warc.archive_pages(spark.createDataFrame(odd, "page_id long, url string, html string").repartition(3)).collect()
    same([(r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in got], [
        (9, "", 1000, "response", None), (9, "", 1000, "revisit", 9), (9, "a", 1000, "revisit", 9), (9, "a", 1000, "revisit", 9), (9, "b", 1000, "revisit", 9), (3, "a", 1000, "revisit", 9), (None, "n", 1000, "revisit", 9),
        (None, "n", 1010, "response", None), (None, "m", 1010, "response", None), (4, "x", 999, "response", None), (4, "x", 999, "response", None),
    ])


def test_warc_join_can_be_split(spark):
    """Nothing but the join uses how the pages were dealt by payload, so Spark may split a hot payload's partition; nor is there a window."""
    pages = spark.createDataFrame([(i, "u", "x" * 2000 if i % 2 else "y" * (1000 + i)) for i in range(300)], "page_id long, url string, html string").repartition(7)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = warc.decide(pages)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Window" not in plan and "SortMergeJoin(skew=true)" in plan


def test_archive_bytes():
    records = [warc.record(i, f"http://a/{i}", f"<html>{i} common text of many pages {i * i}</html>" * 5, "d", "response", None) for i in range(300)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICT_FRAME
    assert [h["WARC-Record-ID"] for h, _ in warc.read_archive(data)] == [f"<urn:page:{i}>" for i in range(300)]
    assert [b for _, b in warc.read_archive(warc.archive(records[:3]))][2].endswith(b"</html>")
    for few in (records[:1], [records[0]] * 40, [b"WARC/1.1\r\nContent-Length: 0\r\n\r\n"], [warc.record(1, "u", "z" * 5_000_000, "d", "response", None)] * 3):
        data = warc.archive(few)  # too few or too alike to train on: still a dictionary, and all comes back
        assert int.from_bytes(data[:4], "little") == warc.DICT_FRAME and len(list(warc.read_archive(data))) == len(few)
    assert warc.archive([]) == b"" and list(warc.read_archive(b"")) == []


def brute_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_edit_distances():
    rng = random.Random(5)
    pairs = [(bytes(rng.choice(b"ABC") for _ in range(rng.randint(1, 64))), bytes(rng.choice(b"ABC") for _ in range(rng.randint(1, 64)))) for _ in range(200)]
    assert list(fingerprint.edit_distances(pairs)) == [brute_distance(a, b) for a, b in pairs]


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def plain_signature(data):
    """The fingerprint byte by byte: chunks end where the rolling hash says, and each chunk's polynomial gives a letter."""
    if not data:
        return (3, "", "")
    hashes = []
    for i in range(len(data)):
        h = sum((data[i - j] + 1) * (1 if not j else 0x85EBCA6B * (2 * j + 1)) for j in range(min(7, i + 1))) & M32
        h = (h ^ h >> 15) * 0xC2B2AE35 & M32
        hashes.append(h ^ h >> 13)

    def letters(block, most):
        chunks, start = [], 0
        for i, h in enumerate(hashes):
            if h % block == block - 1:
                chunks.append((start, i + 1))
                start = i + 1
        if start < len(data):
            chunks.append((start, len(data)))
        if len(chunks) > most:  # the last letter is of all that is left
            chunks[most - 1 :] = [(chunks[most - 1][0], len(data))]
        out = ""
        for a, z in chunks:
            v = sum((data[k] + 1) * pow(0x9E3779B97F4A7C15, k - a, 1 << 64) for k in range(a, z)) & M64
            out += LETTERS[((v ^ v >> 32) * 0xD6E8FEB86659FD93 & M64) >> 58]
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(h % block == block - 1 for h in hashes) < 31:
        block //= 2
    return (block, letters(block, 64), letters(2 * block, 32))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for x, s in ((a[0], a[1]), (2 * a[0], a[2])):
        for y, t in ((b[0], b[1]), (2 * b[0], b[2])):
            if x == y and s and t:
                best = max(best, 1 - brute_distance(s, t) / max(len(s), len(t)))
    return best


def test_signatures_byte_by_byte():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abcd efgh") for _ in range(n)) for n in (1, 2, 6, 7, 8, 50, 191, 192, 193, 1000, 5000)] + [b"a" * 3000, b"ab" * 700, "é日".encode() * 200]
    for t in texts:
        assert str(fingerprint.signature(t)) == ":".join(map(str, plain_signature(t)))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_fingerprints(spark, docs, plain, empty, partitions):
    """Every document against its successor, nulls and repeated identifiers too, in order of the identifier and the texts' hash."""
    texts = [(i, (t or "")[:3000]) for i, t in plain]
    texts += [(7, "second text of seven"), (7, ""), (7, "second text of seven"), (-5, "first")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    prints = {t: plain_signature(t.encode()) for _, t in order}
    want = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        changed = t[: len(t) - k] + following[:k]
        sign = plain_signature(changed.encode())
        near = [round(plain_likeness(prints[t], x), 9) for x in (sign, prints[following])]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), ":".join(map(str, prints[t])), ":".join(map(str, sign)), *near))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint.compare_successors(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    same(got, want)
    assert fingerprint.compare_successors(docs).count() == len(plain)
    assert fingerprint.compare_successors(empty).count() == 0
    one = fingerprint.compare_successors(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_edits_stay_alike():
    rng = random.Random(2)
    texts = [" ".join(str(rng.random()) for _ in range(300)).encode() for _ in range(20)]
    a = [fingerprint.signature(t) for t in texts]
    b = [fingerprint.signature(t[:2000] + b"an edit" + t[2000:]) for t in texts]
    assert min(fingerprint.likeness(list(zip(a, b, strict=True)))) > 0.8 and max(fingerprint.likeness(list(zip(a, a[1:], strict=False)))) < 0.4


def test_licenses(docs, plain, empty):
    s = licenses.Scanner()
    n, base, first, last, labels, every, free, score = s.scan("x Under the MIT-license, under THE mit License; CC BY NC sa. SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND ISC) OR apache-2.0\nx")
    assert (base, first, last, labels, every, free) == (3, 1, 9, "cc-by-nc,mit", "apache-2,cc-by-nc,classpath-exception-2.0,gpl,isc,mit", True) and 0.9 < score <= 1
    assert s.scan("") == (0, 0, None, None, "", "", None, 0.0)
    assert s.scan("apache license version 2.0 apache license version 20")[1:4] == (1, 0, 0)
    assert s.scan("émit under the mit license")[:4] == (5, 1, 1, 1)
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    for bad in ("", "or a", "(a", "a)", "a and", "a or ( )"):
        with pytest.raises(ValueError):
            licenses.postfix(bad)
    assert licenses.evaluate("mit and gpl-3.0") == (frozenset({"mit", "gpl"}), False)
    assert licenses.evaluate("mit and or") == (frozenset({"mit"}), None)
    assert licenses.scan_documents(docs).count() == len(plain) and licenses.scan_documents(empty).count() == 0


def test_license_words():
    s, rng = licenses.Scanner(), random.Random(4)
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for _ in range(300):
        t = "".join(rng.choice([" under the MIT license ", "apache license\nversion 2", "cc-by-nc", "é", ".", "x", " ", "2", "mit license"]) for _ in range(rng.randint(0, 30)))
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p := phrase.split())] == p]
        n, base, first, last, labels, *_ = s.scan(t)
        assert (n, base) == (len(w), len(places))
        assert (first, last) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert labels == ",".join(sorted({x[1] for x in places}))


def plain_expression(text):
    """(labels, permissive) of an expression by recursive descent; labels only where it is none."""
    import re

    tokens = re.findall(r"[()]|[^()\s]+", text)
    at = 0

    def kind(t):
        return next(((label, free) for start, label, free in licenses.FAMILIES if re.match(re.escape(start) + r"(?:[-+.]|$)", t)), None)

    def either():
        nonlocal at
        labels, free = both()
        while at < len(tokens) and tokens[at] == "or":
            at += 1
            more, other = both()
            labels, free = labels | more, True if True in (free, other) else None if None in (free, other) else False
        return labels, free

    def both():
        nonlocal at
        labels, free = one()
        while at < len(tokens) and tokens[at] == "and":
            at += 1
            more, other = one()
            labels, free = labels | more, False if False in (free, other) else None if None in (free, other) else True
        return labels, free

    def one():
        nonlocal at
        labels, free = atom()
        while at < len(tokens) and tokens[at] == "with":
            at += 1
            labels = labels | atom()[0]
        return labels, free

    def atom():
        nonlocal at
        if at >= len(tokens) or tokens[at] in ("or", "and", "with", ")"):
            raise ValueError
        t = tokens[at]
        at += 1
        if t == "(":
            found = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError
            at += 1
            return found
        known = kind(t)
        return ({known[0]}, known[1]) if known else ({t} if "exception" in t else set(), None)

    try:
        found = either()
        if at < len(tokens) and tokens[at] == ")":
            raise ValueError
        return found
    except ValueError:
        return {k[0] for t in tokens if (k := kind(t))}, None


def test_expressions():
    rng = random.Random(12)
    words = ["mit", "gpl-3.0", "apache-2.0", "bsd-3-clause", "and", "or", "with", "(", ")", "classpath-exception-2.0", "nothing-1", "and", "or", "with"]
    whole = 0
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
        labels, free = licenses.evaluate(text)
        want = plain_expression(text)
        if want[1] is None and "(" in text:  # which labels a broken nesting leaves is not the point
            assert free is None, text
            continue
        assert (set(labels), free) == want, text
        whole += free is not None
    assert whole > 100


def test_labels_and_scores():
    """All of a scan by searching for each phrase in the joined words, and each tag in the text."""
    import re

    rng, s = random.Random(13), licenses.Scanner()
    parts = [" under the MIT license ", "SPDX-License-Identifier: Apache-2.0 OR GPL-2.0-only\n", "GNU  general, public license", "Mozilla Public License", "all rights reserved.", "words", "spdx-license-identifier: (mit\n", "SPDX-License-Identifier: ISC and\n", "é", "cc by nc"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        low = "".join(c.lower() if c.isascii() else c for c in text)
        words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
        places = sum(len(re.findall(f"(?= {p} )", words)) for p in licenses.BASE)
        base = {label for p, label in licenses.BASE.items() if f" {p} " in words}
        others = {label for p, label in licenses.NOTICES.items() if f" {p} " in words}
        verdicts = []
        for m in re.finditer(r"(?<![a-z0-9\x80-\U0010ffff])spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]*)", low):
            labels, free = plain_expression(m[1].strip())
            others |= set(labels)
            verdicts.append(free)
        free = None if not verdicts or None in verdicts else all(verdicts)
        score = 1 - (0.1 if verdicts else 1) * 0.5**places * 0.7 ** len(others - base)
        _, n_base, _, _, base_labels, labels, permissive, got = s.scan(text)
        assert (n_base, base_labels, labels, permissive) == (places, ",".join(sorted(base)), ",".join(sorted(base | others)), free), text
        assert got == pytest.approx(score) and 0 <= got <= 1


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe(docs, plain, empty, vocabulary):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary)
    lib.no_padding()
    lib.no_truncation()
    e = bpe.Encoder(vocabulary)
    d = bpe.Decoder(e)
    rng = random.Random(6)
    parts = [t.replace("</w>", "") for t in e.vocab if t.isascii() and not t.startswith("<|")]
    texts = [t or "" for _, t in plain] + ["a" * 5000, "ab" * 3000 + "é" * 700, "<|endoftext|>a<|startoftext|>", "İ Σας \x1cx\x85y it's 12½", "thethethe" * 500]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 600))) for _ in range(60)]
    for t in texts:
        ids = e.encode(t)
        want = lib.encode(t, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want
        assert "".join(d.joined(ids)) == lib.decode(want, skip_special_tokens=False)
    assert "".join(d.plain(e.encode("naïve 日本 X"))) == "naïve 日本 x "
    for t in texts:  # in pieces of any size
        transducer, at, out = bpe.Transducer(e), 0, b""
        while at < len(t):
            size = rng.choice([1, 2, 3, 10, 100, 1000])
            out, at = out + transducer.feed(t[at : at + size]), at + size
        assert out + transducer.finish() == e.encode(t)
    m = bpe.ByteToText()
    assert [m.feed(b"\xf0\x9f"), m.feed(b"\x99\x82"), m.feed(b"\xff"), m.feed(b"\xc3"), m.finish()] == ["", "🙂", "�", "", "�"]
    got = bpe.encode_documents(docs, vocabulary).collect()
    want = [(i, len(x := lib.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t in plain]
    same(got, want)
    assert bpe.encode_documents(empty, vocabulary).count() == 0


def plain_merges(merges, symbols):
    """BPE by its definition: the lowest rank first, the leftmost of equals."""
    rank = {p: i for i, p in enumerate(merges)}
    symbols = list(symbols)
    while pairs := [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]:
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


@pytest.mark.parametrize("seed", range(40))
def test_transducer_equals_merging(seed):
    """Random merge lists over few symbols, with many ties and overlaps; the tokens come before the word's end once the lookahead is past."""
    rng = random.Random(seed)
    tokens, merges = list("ab") if seed % 2 else list("abc"), []
    symbols = list(tokens)
    while len(merges) < 12:
        pair = (rng.choice(tokens), rng.choice(tokens))
        if pair not in merges and pair[0] + pair[1] not in tokens and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    m = bpe.Merges(merges, symbols)
    lookahead = bpe.sufficient_lookahead(merges, dict.fromkeys(symbols, 1))
    for _ in range(60):
        text = "".join(rng.choice(symbols) for _ in range(rng.randint(1, 200)))
        w = bpe.Word(m, "", lookahead, bpe.Sizes(m.made, ""))
        early = list(w.push(text))
        assert early + w.finish() == plain_merges(merges, text)
        assert w.most <= 2 * lookahead + len(max(tokens, key=len)) and (early or len(text) <= 2 * lookahead + len(max(tokens, key=len)))


def test_every_token_comes_from_the_transducer(vocabulary, small, monkeypatch):
    import pyarrow.parquet as pq

    given, finish, push = [], bpe.Word.finish, bpe.Word.push
    monkeypatch.setattr(bpe.Word, "finish", lambda w: given.extend(out := finish(w)) or out)
    monkeypatch.setattr(bpe.Word, "push", lambda w, s: (given.append(t) or t for t in push(w, s)))
    monkeypatch.setattr(bpe, "SHORT", 0)  # nothing is remembered
    e, n = bpe.Encoder(vocabulary), 0
    for text in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist()[:60]:
        n += len(e.encode(text or "")) // 4
    assert len(given) == n > 10000


def test_transducer_memory(vocabulary):
    """What a very long word holds doesn't grow with it."""
    import tracemalloc

    e, peaks = bpe.Encoder(vocabulary), []
    for pieces in (8, 64):
        t, n = bpe.Transducer(e), 0
        tracemalloc.start()
        for _ in range(pieces):
            n += len(t.feed("antidisestablish" * 256)) // 4
        held = (len(t.held), len(t.open.text), len(t.open.raw), len(t.open.word.held))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n > pieces * 256 and max(held) <= 2 * e.lookahead + 64
    assert peaks[1] < 1.5 * peaks[0] + 100_000


def test_every_code_point(vocabulary):
    from tokenizers import Tokenizer

    lib, e = Tokenizer.from_file(vocabulary), bpe.Encoder(vocabulary)
    lib.no_padding()
    lib.no_truncation()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC10 or 0xF900 <= c < 0x1FFFF or c % 97 == 0)]
    for c in points:
        t = f"a{chr(c)}b{chr(c)}1"
        assert list(memoryview(e.encode(t)).cast("I")) == lib.encode(t, add_special_tokens=False).ids, hex(c)


def test_toxicity(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfghjkl" for b in ("ab", "ec", "id", "of", "ug")]
    table = []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic = i % 5 == 0
        if toxic:
            t[1:1] = rng.sample(["vilest", "vilely", "nasty"], 2)
        table.append((i, " ".join(t), 0 if i % 11 == 0 else 1, int(toxic)))
    df = spark.createDataFrame(table, "doc_id long, text string, quality int, toxic int")
    docs = df.select("doc_id", "text", F.lit("x").alias("toxic_probability"), F.lit(1).alias("quality")).unionByName(spark.createDataFrame([(None, None, "x", 1), (1000, "", "x", 1), (1001, "bab " * 300_000 + "vilest nasty", "x", 1)], "doc_id long, text string, toxic_probability string, quality int"))
    labels = df.where("doc_id < 300").select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame([(3, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs.select("doc_id", "text"), labels).collect()}
    assert all(got[i] == bool(x) for i, _, _, x in table) and not got[None] and not got[1000] and got[1001]
    docs = docs.withColumns({c: F.lit(c) for c in EXTRA if c != "toxic_probability"})
    kept = toxicity.drop_toxic(docs, labels)
    passes_through(docs, kept)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if not x}
    none = toxicity.classify(docs.select("doc_id", "text"), labels.where("doc_id < 0")).collect()
    assert len(none) == 603 and not any(r.toxic for r in none)
    assert toxicity.classify(docs.select("doc_id", "text").where("doc_id < 0"), labels).count() == 0


def plain_fit(rows, y, earlier):
    """A logistic regression with dense rows: (weights of features, of the length, of earlier, intercept)."""
    features = sorted({f for r in rows for f in r[0]})
    n, ones, scores = len(y), sum(y), {}
    for f in features:
        k = sum(f in r[0] for r in rows)
        pos = sum(f in r[0] and c for r, c in zip(rows, y, strict=True))
        if 3 <= k < n:
            scores[f] = n * (pos * n - k * ones) ** 2 / (k * (n - k) * ones * (n - ones))
    chosen = sorted(f for f, x in scores.items() if x >= 12)
    x = np.array([[r[0].get(f, 0) for f in chosen] + [np.log1p(r[1]) / 5, *e, 1.0] for r, e in zip(rows, earlier, strict=True)], float)
    w, g = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    share = np.where(np.array(y) == 1, 0.5 / ones, 0.5 / (n - ones))
    for _ in range(300):
        d = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) - y)) + 1e-4 * w
        g += d * d
        w -= 0.3 * d / np.sqrt(g)
    return dict(zip(chosen, w, strict=False)), w[len(chosen)], w[len(chosen) + 1 : -1], w[-1]


def plain_probability(model, row, earlier):
    weights, length, before, bias = model
    z = sum(weights.get(f, 0) * c for f, c in row[0].items()) + length * np.log1p(row[1]) / 5 + float(np.dot(before, earlier)) + bias
    return 1 / (1 + np.exp(-z))


def test_chain_against_dense_rows():
    """The chain as a plain version trains it: out-of-fold probabilities of the first category are the second's features."""
    import re
    from zlib import crc32

    rng = random.Random(14)
    stems = ["nice", "calm", "vile", "vilest", "nasty", "garbled", "garbage", "story", "stories", "weather"]
    texts, labels = [], []
    for _ in range(160):
        t = " ".join(rng.choice(stems) + rng.choice(["", "", "r", "ly"]) for _ in range(rng.randint(1, 12)))
        texts.append(t.upper() if rng.random() < 0.3 else t)
        labels.append([int("garb" in t), int("vile" in t and rng.random() < 0.95)])
    rows = []
    for t in texts:
        words, counts = set(re.findall(r"[a-z]+", t.lower())), defaultdict(int)
        for w in words:
            for f in [w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n)]:
                counts[crc32(f.encode()) % (1 << 22)] += 1
        rows.append((counts, len(words)))
    y0, y1 = ([x[k] for x in labels] for k in (0, 1))
    nothing = [[]] * len(rows)
    first = plain_fit(rows, y0, nothing)
    out = [[0.0]] * len(rows)
    for f in range(4):
        inside = [i for i in range(len(rows)) if i % 4 != f]
        part = plain_fit([rows[i] for i in inside], [y0[i] for i in inside], [[] for _ in inside])
        for i in range(f, len(rows), 4):
            out[i] = [plain_probability(part, rows[i], [])]
    second = plain_fit(rows, y1, out)
    words = [toxicity.distinct_words(t) for t in texts]
    chain = toxicity.fit_chain(toxicity.Design.of_words(words), np.array(labels))
    for t, w, r in zip(texts, words, rows, strict=True):
        p = plain_probability(first, r, [])
        q = plain_probability(second, r, [p])
        own = chain[0].probability(sum(map(chain[0].word, w)), len(w), [])
        assert own == pytest.approx(p, abs=1e-4), t
        assert chain[1].probability(sum(map(chain[1].word, w)), len(w), [own]) == pytest.approx(q, abs=1e-3), t


def test_chain_learns_from_what_came_before():
    rng = np.random.default_rng(8)
    rows_ = [{f"word{c}" * 2 for c in map(chr, rng.integers(97, 117, 6))} for _ in range(400)]
    y = np.array([["worda" * 2 in r, ("worda" * 2 in r) ^ (rng.random() < 0.02)] for r in rows_], int)
    design = toxicity.Design.of_words(rows_)
    chain = toxicity.fit_chain(design, y)
    assert chain[1].earlier[0] > 0.5
    first = design.probabilities(chain[0], np.empty((400, 0)))
    p = design.probabilities(chain[1], first[:, None])
    assert ((p >= 0.5) == y[:, 1]).mean() > 0.95
    one = chain[1].probability(sum(map(chain[1].word, rows_[7])), len(rows_[7]), [first[7]])
    assert one == pytest.approx(p[7], abs=1e-5)


def test_filter_audit(spark, docs, empty):
    from itertools import permutations

    plain = [(r[0], r[1] or "", r[2]) for r in rows()] + [(500, "LOUD # words", None), (501, "LOUD # words", ""), (None, "LOUD # words", "en"), (502, " ".join(f"w{i}" for i in range(120)), "de")]
    more = spark.createDataFrame([(i, t, p, *[None] * (len(docs.columns) - 3)) for i, t, p in plain[-4:]], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (501, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    good, toxic = {1, 2, 501}, {2, 501}
    least = {}
    for i, t, _ in plain:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    fails = []
    for i, t, part in plain:
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if x]
        capitals = sum("A" <= c <= "Z" for c in t)
        again = t in least and (i is None or i > least[t])
        fails.append((part or "", i, {k for k, f in zip("ABCDE", (len(w) < 100, 100 * len({*w}) < 80 * len(w), 100 * capitals > 10 * len(t), bool({*"#$%&*|"} & {*t}), again)) if f}))
    want = []
    for part in {p for p, _, _ in fails}:
        own, removed = [(i, f) for p, i, f in fails if p == part], defaultdict(int)
        table = []
        for order in permutations("ABCDE"):
            for s, x in enumerate(order):
                before = {*order[:s]}
                gone = [(i, f) for i, f in own if x in f and not f & before]
                removed[x] += len(gone)
                table.append((part, "".join(order), s + 1, sum(not f & (before | {x}) for _, f in own), len(gone), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        want += [(*r, removed[r[1][r[2] - 1]]) for r in table]
    same(filter_audit.audit(docs.unionAll(more), labels).collect(), want)
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(docs, labels.where("doc_id < 0")).agg(F.sum("good_lost")).first()[0] == 0


def plain_components(plain, words=4):
    """(id, set size, least id reachable) by comparing all pairs; None is the last of identifiers."""
    sets = []
    for _, t in plain:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for n, (i, _) in enumerate(plain):
        least[top(n)] = min(least.get(top(n), float("inf")), float("inf") if i is None else i)
    found = [least[top(n)] for n in range(len(plain))]
    return [(i, len(s), None if c == float("inf") else int(c)) for (i, _), s, c in zip(plain, sets, found, strict=True)]


def varied(seed=5):
    """Documents of sentences from a few templates, near copies of one, and some of very few words."""
    rng = random.Random(seed)
    sentences = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(8)) for _ in range(30)]
    texts = [". ".join(rng.sample(sentences, 10)) for _ in range(60)]
    long = [f"x{rng.randint(0, 500)}" for _ in range(300)]
    for _ in range(60):
        t = list(long)
        for _ in range(rng.randint(0, 16)):
            t[rng.randrange(len(t))] = f"y{rng.randint(0, 99)}"
        texts.append(" ".join(t))
    for n in range(40):
        words = [f"z{i}" for i in range(rng.randint(0, 12))]
        texts.append(" ".join(words + ["end"] * (n % 2)))
    return [(1000 + 3 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowded", [False, True])
def test_hyper_minhash(spark, docs, empty, crowded, monkeypatch):
    if crowded:  # a round of leaders, and all sets at their rarest shingles, before what is left is compared
        run = hyper_minhash.Search.run

        def turns(search):
            search.lead(0)
            search.lead(1)
            assert search.sets.select("component").distinct().count() < search.sets.count()
            before = search.rows.count()
            monkeypatch.setattr(hyper_minhash, "PAIRS", 0)
            search.refine()
            assert 0 < search.rows.count() != before
            run(search)

        monkeypatch.setattr(hyper_minhash.Search, "run", turns)
    plain = [(r[0], r[1]) for r in rows()] + varied()
    more = spark.createDataFrame([(i, t, *[None] * (len(docs.columns) - 2)) for i, t in varied()], SCHEMA)
    want = [(i, n, c, i == c) for i, n, c in plain_components(plain)]
    same(hyper_minhash.near_duplicates(docs.unionAll(more)).collect(), want)
    assert len({c for _, _, c, _ in want}) < len(want) - 30
    if not crowded:
        assert hyper_minhash.near_duplicates(empty).count() == 0


def test_hyper_minhash_crowd_just_under(spark, monkeypatch):
    """Copies of one text, changed in places of their own, are less similar to it and each other than is looked for; few of their pairs are compared, and those that share changes are found."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]

    def changed(words, times):
        words = list(words)
        for at in rng.sample(range(150), times):
            words[at] = f"y{rng.randint(0, 1)}"
        return words

    copies = [changed(base, rng.randint(6, 8)) for _ in range(240)]
    copies += [changed(c, 1) for c in copies[::8]] + [changed(base, rng.randint(1, 3)) for _ in range(20)]
    plain = [(7 * i, " ".join(c)) for i, c in enumerate(copies)]
    made, real = [], hyper_minhash.meeting

    def meeting(rows, bands):
        made.append(real(rows, bands).count())
        return real(rows, bands)

    monkeypatch.setattr(hyper_minhash, "meeting", meeting)
    want = [(i, n, c, i == c) for i, n, c in plain_components(plain)]
    same(hyper_minhash.near_duplicates(spark.createDataFrame(plain, "doc_id long, text string")).collect(), want)
    assert 100 < len({c for _, _, c, _ in want}) < 240
    assert made[0] < len(plain) ** 2 / 2  # rows, of which a pair may have several


def registers(bits):
    return hyper_minhash.sketch(bits).view(np.uint16)


def test_sketches():
    """Registers as defined, one by one; the estimate's collisions as they are counted over random sets."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 300, 20_000):
        bits = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        want = [0] * hyper_minhash.REGISTERS
        for h in bits.tolist():
            h %= 1 << 64
            bucket, rest = h >> 56, h % (1 << 32)
            digits = f"{rest:032b}".lstrip("0")
            low = (33 - len(digits)) << 10 | int((digits[1:] + "0" * 10)[:10], 2)
            old = want[bucket]
            if not old or (old >> 10, -(old & 1023)) < (low >> 10, -(low & 1023)):
                want[bucket] = low
        assert registers(bits).tolist() == want


@pytest.mark.parametrize("n", [40, 600, 6000])
def test_expected_collisions(spark, n):
    rng = np.random.default_rng(4)
    draw = lambda: registers(np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n)))
    tries = 2000
    sets = [draw() for _ in range(tries)]
    met = sum(int(((sets[i] == sets[i - 1]) & (sets[i] > 0)).sum()) for i in range(tries))
    want = spark.range(1).select(hyper_minhash.expected_collisions(F.lit(n), F.lit(n))).first()[0] * tries
    assert abs(met - want) < 5 * want**0.5 + 1


def plain_collocations(plain, least, best):
    import re
    from collections import Counter

    count, n = Counter(), Counter()
    for t, lang in plain:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    often = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    longer = defaultdict(int)
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    for (lang, w), a in often.items():
        score, _, left, right = min((2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        if 100 * longer[lang, w] < 80 * a:
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:best])]


def test_collocations(spark, docs, empty, monkeypatch):
    rng = random.Random(8)
    odd = ["New York\x01 city, new york\tCITY! new  york; x\x0cy a.b ünï ÜNÏ", "a a a a a a, a a", ". , ;", "\x7f\x00 b \x7f\x00 b \x7f\x00 b"] * 4
    odd += [" ".join(rng.choice(["in", "the", "case", "of", "fire,", "break", "glass."]) for _ in range(60)) for _ in range(20)]
    plain = [(r[1], r[2]) for r in rows()] + [(t, rng.choice([None, "en", "", "und"])) for t in odd]
    more = spark.createDataFrame([(i, *p, *[None] * (len(docs.columns) - 3)) for i, p in enumerate(plain[-len(odd) :])], SCHEMA)
    monkeypatch.setattr(collocations, "BLOCK", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # runs go over several batches
    try:
        for least, best in ((3, 40), (12, 2000)):
            same(collocations.collocations(docs.unionAll(more), least, best).collect(), plain_collocations(plain, least, best))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert collocations.collocations(empty).count() == 0


def test_radix_order():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 1 << 32, 3000).astype(np.uint32) >> rng.integers(0, 32) for _ in range(3)]
    got, counts = collocations.runs(words)
    want = defaultdict(int)
    for w in zip(*(w.tolist() for w in words), strict=True):
        want[w] += 1
    assert list(zip(*(w.tolist() for w in got), counts.tolist(), strict=True)) == [(*w, n) for w, n in sorted(want.items())]
