"""Keyword extraction against a plain version of it, word by word; addresses against urllib."""

import math
import random
import re
import time
import unicodedata
from collections import Counter
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.functions.scores import growth_label
from newsloom.functions.text import STOPWORDS
from newsloom.operators import keywords

WORD = re.compile(r"[^\W]+(?:[./:&+#-][^\W]+)*")
WEIGHT = {1: 0.55, 2: 1.0, 3: 1.06, 4: 1.12, 5: 1.15}


def corpus(seed=5, n=24):
    rng = random.Random(seed)
    words = "giá vàng tăng Hà Nội iPhone 15 2024 và của thị trường AI ở 3.5 covid-19 đội tuyển Việt Nam lãi suất 90 x y_z từ thì".split()
    docs = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        docs.append((i, " ".join(x + rng.choice(["", "", "", ".", ",", " -"]) for x in t), " ".join(t[:3]) if i % 3 else None))
    docs += [(100, None, "x"), (101, "", None), (102, " \n \t", "giá vàng"), (103, "giá vàng giá_vàng (giá vàng)", "Giá Vàng"), (104, "... !!!", None), (105, "GIÁ VÀNG TĂNG", "tăng")]
    return docs


def split(t):
    return WORD.findall((t or "").replace(" ", " ").replace("_", " "))


def runs(words, most=5):
    return [(i, tuple(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_scores(docs):
    """{(id, key): every factor} of all candidates that are features."""
    full = [(i, t.strip(), title) for i, t, title in docs if t and t.strip()]
    features = {i: Counter(" ".join(g) for _, g in runs(WORD.findall(t))) for i, t, _ in full}
    df = Counter(f for c in features.values() for f in c)
    counts = Counter(g for _, t, _ in full for _, g in runs([w.lower() for w in split(t)]))
    total = sum(len(split(t)) for _, t, _ in full)
    of_length = {1: total} | {n: max(total - (n - 1) * len(full), 0) for n in range(2, 6)}
    number = lambda w: w.replace(",", "").replace(".", "").isdigit()
    letter = lambda w: any(map(str.isalpha, w))
    name = lambda w: letter(w) and (any(map(str.isdigit, w)) or w[0].isupper())
    out = {}
    for i, t, title in full:
        weight = {f: (1 + math.log(c)) * (math.log((1 + len(full)) / (1 + df[f])) + 1) for f, c in features[i].items() if df[f] <= 0.9 * len(full)}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        found = {}
        for _, g in sorted(runs(split(t)), key=lambda r: r[0]):
            low = [w.lower() for w in g]
            if {low[0], low[-1]} & {*STOPWORDS} or not any(map(letter, g)) or sum(map(number, g)) > 1 or (len(g) == 1 and len(g[0]) <= 2 and not name(g[0])):
                continue
            found.setdefault(" ".join(low), []).append(g)
        head = f" {' '.join(w.lower() for w in split(title))} "
        for key, forms in found.items():
            if key not in weight:
                continue
            g, low, n = forms[0], tuple(key.split()), len(forms[0])
            pmi = boost = 0.0
            if n > 1:
                p = counts[low] / max(of_length[n], 1)
                pmi = math.log2(p) - sum(math.log2(counts[(w,)] / total) for w in low)
                npmi = max(-1.0, min(1.0, pmi / max(-math.log2(max(p, 1e-12)), 1e-9)))
                boost = max(0.76, min(1.24, 1 + 0.24 * math.tanh(2 * npmi) * min(1.0, math.sqrt(counts[low] / 3))))
            boost = boost or 1.0
            inner = sum(w in STOPWORDS for w in low[1:-1])
            quality = (max(0.78, 1 - 0.07 * inner) if inner else 1.0) * {2: 1.02, 3: 1.04, 4: 1.05, 5: 1.06}.get(n, 1.0) * (1.06 if all(map(name, g)) else 1.0)
            quality = max(0.45, min(quality, 1.2))
            often = min(1.24, 1 + 0.08 * math.log1p(len(forms)))
            titled = 1.25 if f" {key} " in head else 1.0
            tfidf = weight[key] / norm
            out[i, key] = (" ".join(g), n, len(forms), tfidf, pmi, boost, quality, often, titled, tfidf * WEIGHT[n] * boost * quality * often * titled)
    return out


def plain_reduction(rows, k):
    """rows of one document, (display, freq, score, key): best first, nested and like ones reduced."""
    chosen = []
    for display, _, score, key in sorted(rows, key=lambda r: (-r[2], -len(r[0].split()), -r[1], r[3])):
        words, refused = display.casefold().split(), False
        holds = lambda a, b: len(b) < len(a) and any(a[j : j + len(b)] == b for j in range(len(a)))
        for other in list(chosen):
            theirs = other[0]
            if holds(words, theirs) and score >= 0.7 * other[1]:
                chosen.remove(other)
                continue
            alike = len({*words} & {*theirs}) / len({*words} | {*theirs}) >= 0.85 and abs(len(words) - len(theirs)) <= 1 and score <= 1.1 * other[1]
            if (holds(theirs, words) and other[1] >= 0.7 * score) or alike:
                refused = True
                break
        if not refused:
            chosen.append((words, score, key))
    return [key for _, _, key in sorted(chosen, key=lambda c: (-c[1], -len(c[0]), c[2]))[:k]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "id int, text string, title string").repartition(3)


def test_scores(docs):
    want = plain_scores(corpus())
    got = {(r.id, r.key): r for r in keywords.scored(docs).collect()}
    assert {*got} == {*want} and len(want) > 300
    for k, w in want.items():
        r = got[k]
        assert (r.display, r.n, r.freq) == w[:3]
        assert [r.tfidf, r.pmi, r.association_boost, r.phrase_quality, r.frequency_boost, r.title_boost, r.score] == pytest.approx(w[3:], abs=1e-9), k


def test_extraction(docs):
    want = plain_scores(corpus())
    found = keywords.extract(docs, 10).collect()
    for i in {i for i, _ in want}:
        rows = sorted(((w[0], w[2], w[9], k, w[3]) for (d, k), w in want.items() if d == i), key=lambda r: (-round(r[2], 12), -r[4], -r[1], r[3]))[:350]
        assert {r.key for r in found if r.id == i} == {*plain_reduction([r[:4] for r in rows], 10)}, i
    stored = keywords.occurrences(keywords.extract(docs, 10)).collect()
    kept = {}
    for r in found:
        words = r.display.split()
        bad = len(words) != r.n or not any(map(str.isalpha, r.display)) or sum(bool(re.fullmatch(r"[\d.,]+", w)) for w in words) > 1 or re.search(r"\b\d+[.,\d]*\s+\S+\s+\d+\s+\d+\b", r.display)
        keyword = " ".join(unicodedata.normalize("NFKC", r.display).split()).casefold()
        if not bad:
            kept[r.id, keyword] = min(kept.get((r.id, keyword), math.inf), r.score)
    assert {(r.news_id, r.keyword): r.final_score for r in stored} == pytest.approx(kept)


def test_blank_documents_change_nothing(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate([None, "", "  ", " \n"] * 15)], "id int, text string, title string"))
    same = lambda df: sorted(map(repr, df.select("id", "key", F.round("score", 12)).collect()))
    assert same(keywords.scored(more)) == same(keywords.scored(docs))
    assert keywords.totals(more).first() == keywords.totals(docs).first()


def test_stats(docs):
    full = [[w.lower() for w in split(t)] for _, t, _ in corpus() if t and t.strip()]
    kinds = Counter(len(g) for g in {g for w in full for _, g in runs(w)})
    got = keywords.stats(docs).first()
    assert (got.documents, got.tokens) == (len(full), sum(map(len, full)))
    assert [got[f"grams_{n}"] for n in range(1, 6)] == [kinds[n] for n in range(1, 6)]


def test_token_edges(spark):
    df = spark.createDataFrame([("“Giá_Vàng”,",), ("(x)",), ("...",), ("a.b",)], "t string")
    assert [r[0] for r in df.select(text.normalize_token(F.col("t"))).collect()] == ["giá vàng", "x", "", "a.b"]


def test_growth_labels(spark):
    """Against whole numbers: tenths of a percent, halves away from 0."""
    pairs = [(r, p) for r in range(45) for p in range(45)]
    df = spark.createDataFrame(pairs, "r long, p long")
    got = {(x.r, x.p): x.label for x in df.select("r", "p", growth_label(F.col("r"), F.col("p")).alias("label")).collect()}
    for r, p in pairs:
        tenths = (abs(r - p) * 2000 + p) // (2 * p) if p else 0
        assert got[r, p] == (f"{'-' if r < p else '+'}{tenths // 10}.{tenths % 10}%" if p else "NEW"), (r, p)


def plain_url(url):
    """The parts by urllib; parameters that only track are left out, the others written again."""
    parts = urlsplit(url.strip())
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in urls.TRACKING]
    out = parts._replace(fragment="", query=urlencode(kept)).geturl()
    return out.rstrip("/") if out.endswith("/") and len(out) > len(f"{parts.scheme}://{parts.netloc}/") else out


def test_addresses(spark):
    rng = random.Random(11)
    bits = ["a", "B", "%", "%4", "%zz", "%41", "%C3%A9", "%C3", "%ff%fe", "%E2%82", "é", "+", " ", "~", "*", "=", "&", "&&", "utm_x=1", "UTM_Source=q", "%75tm_a=2", "ref=z", "REF", "x=", "=y", "/", ";", "?", "q=100%&x=1"]
    made = ["http://h/p?" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    made += ["HTTP://Host/", "http://h", "http://h/", "http://h//", "http://h/a/", "http://h/a/#f/", " http://h/a?b#c ", "http://h/?q=100%&x=1", "http://h/a\tb?c\n=d", "http://h/a?", "", "  ", "http://h/%zz?" + quote("ü") + "=1"]
    got = {r.u: r.n for r in spark.createDataFrame([(u,) for u in made], "u string").select("u", urls.normalize_url(F.col("u")).alias("n")).collect()}
    wrong = [(u, got[u], plain_url(u)) for u in made if got[u] != plain_url(u)]
    assert not wrong, wrong[:5]


def test_best_candidates_are_all_among_those_left(spark):
    """What a block leaves out is none of a document's best, ties included, whatever the last digits of a score are."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("Aa b C d ee f2 g 7 và".split()) for _ in range(rng.choice([0, 3, 40, 90]))), "b C d") for i in range(30)], "id int, text string, title string")
    every, some = keywords.scored(docs).collect(), keywords.scored(docs, best=5).collect()
    assert {*some} < {*every}
    for i in range(30):
        own = sorted(r.score for r in every if r.id == i)
        assert {r for r in every if r.id == i and r.score >= own[-5:][0]} <= {*some}
    assert keywords.leading(keywords.np.array([0, 1, 0, 0]), keywords.np.array([3.0, 0.1, 1.0, 3.0 - 1e-12]), 1).tolist() == [True, True, False, True]


def test_long_lists_of_phrases_are_reduced_by_lookup():
    """Phrases that share a word with all others; comparing each with all chosen ones took minutes."""
    rows = [{"display": f"x a{i} b{i}", "key": f"x a{i} b{i}", "score": 1.0, "freq": 1} for i in range(8000)] + [{"display": "a5 b5", "key": "a5 b5", "score": 1.2, "freq": 1}, {"display": "b7 a7 x", "key": "b7", "score": 1.0, "freq": 1}]
    began = time.process_time()
    best = [rows[i]["display"] for i in keywords.reduce_phrases(rows, 9000)]
    assert time.process_time() - began < 5
    assert len(best) == 8000 and "a5 b5" not in best and best.count("x a5 b5") == 1 and ("b7 a7 x" in best) + ("x a7 b7" in best) == 1
