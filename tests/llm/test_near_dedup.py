import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from palisade.llm import near_dedup as N
from palisade.llm import shingles as S
from palisade.llm.components import components
from palisade.llm.suffix_dedup import utf8


def brute_words(text):
    return re.findall(rb"[0-9a-z_\x80-\xff]+", (text or "").encode().lower() if text and text.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def vectors(texts, idf):
    words = S.Words()
    out = []
    for t in texts:
        got = (np.zeros(0, np.uint64), np.zeros(0))
        for at, to, h, text in words.parts(*utf8(pa.array([t], pa.string()))):
            of, s, w = S.weighted(h, text, to - at, idf)
            got = (s, w)
        out.append(got)
    return out


def test_words_do_not_cross_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB_é .,\n") for _ in range(rng.randrange(30))) for _ in range(300)]
    words = S.Words()
    (at, to, hashes, text), = words.parts(*utf8(pa.array(texts)))
    assert Counter(text.tolist()) == Counter({i: len(brute_words(t)) for i, t in enumerate(texts) if brute_words(t)})
    by = defaultdict(set)
    flat = [w for t in texts for w in brute_words(t)]
    for w, h in zip(flat, hashes.tolist(), strict=True):
        by[w].add(h)
    assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h in x}) == len(by)


def test_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(S, "MOST", 64)
    texts = ["short one", "many words in a text that is longer than the stretch by far and goes on and on", "", "end"]
    words = S.Words()
    got = defaultdict(list)
    for at, _, h, text in words.parts(*utf8(pa.array(texts))):
        for x, t in zip(h.tolist(), text.tolist(), strict=True):
            got[at + t].append(x)
    monkeypatch.setattr(S, "MOST", 1 << 16)
    whole = S.Words()
    for i, t in enumerate(texts):
        own = [x for _, _, h, _ in whole.parts(*utf8(pa.array([t]))) for x in h.tolist()]
        assert got[i] == own


def test_weighted_jaccard():
    idf = np.ones(S.BUCKETS)
    a, b, c = vectors(["a b c d e f", "a b c d e g", "x"], idf)
    assert S.weighted_jaccard(a, b) == 1 / 3 and S.weighted_jaccard(a, a) == 1 and S.weighted_jaccard(a, c) == 0


def test_samples_agree_with_the_similarity():
    rng = np.random.default_rng(2)
    sampler = N.Sampler()
    x = np.unique(rng.integers(1, 1 << 63, 400, np.uint64))
    w = rng.uniform(1, 4, len(x))
    v = w.copy()
    v[:80] *= 1.7
    a, b = (x[:360], w[:360]), (x[40:], v[40:])
    both = sampler.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 360, 720]))
    # 48 samples of one pair: within four standard errors
    s = S.weighted_jaccard(a, b)
    assert abs((both[0] == both[1]).mean() - s) < 4 * (s * (1 - s) / 48) ** 0.5


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60) if i % 13] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(500, 500 + i) for i in range(1, 40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[find(max(find(a), find(b)))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.randint(1, 12)):
            t = base[:]
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = N.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = Counter(b for t in texts for b in {h % S.BUCKETS for h in S.Words().of(np.frombuffer(t.encode(), np.uint8))[0].tolist()})
    df = np.zeros(S.BUCKETS, np.int64)
    for b, n in counts.items():
        df[b] = n
    vs = vectors(texts, S.inverse_frequencies(df, len(texts)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if S.weighted_jaccard(vs[i], vs[j]) >= N.SIMILAR:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in range(len(texts))}
    assert sum(r["kept"] for r in got) == len({find(i) for i in range(len(texts))})


def test_messy_rows(spark, messy, messy_docs, no_docs):
    got = N.classes(spark, messy_docs).collect()
    assert len(got) == len(messy)
    text = {r[0]: r[1] for r in messy}
    assert all(n == 1 for n in Counter(r["class_id"] for r in got if r["kept"] and brute_words(text[r["doc_id"]])).values())
    by = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and brute_words(text[r["doc_id"]]) and r["doc_id"] != 7:
            by[tuple(brute_words(text[r["doc_id"]]))].add(r["class_id"])
    assert {k[:2]: x for k, x in by.items() if len(x) > 1} == {}  # the same words, one class
    near = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] in (5, 9)}
    assert near[5] == near[9] == 5
    assert N.classes(spark, no_docs).count() == 0
    left = N.drop_near_copies(spark, messy_docs)
    assert left.columns == messy_docs.columns and left.count() == sum(r["kept"] for r in got)
