import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from palisade.llm import suffix_dedup as S
from palisade.llm.anchors import Anchors
from palisade.llm.lyndon import common_prefixes, suffix_array


def brute(texts, w=S.WINDOW):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + w] for b in data for i in range(len(b) - w + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(600):
        t = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(50))]
        order = suffix_array(t)
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        for r, n in enumerate(common_prefixes(t, order)):
            if r:
                a, b = t[order[r - 1] :], t[order[r] :]
                assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 256, 900, np.uint8)
    texts = [np.concatenate([rng.integers(0, 256, n, np.uint8), passage, rng.integers(0, 256, 77, np.uint8)]) for n in (0, 13, 500)]
    anchors = Anchors()
    places = []
    for t in texts:
        _, first, last, _, place = anchors.runs(t, np.array([0]), np.array([len(t)]))
        places.append({s: p - s for a, z, p in zip(first, last, place, strict=True) for s in range(a, z + 1)})
    for s in range(len(passage) - S.WINDOW + 1):
        assert places[0][s] == places[1][s + 13] == places[2][s + 500]


@pytest.mark.parametrize("large", [S.LARGE, 2])
def test_messy_rows(spark, messy, messy_docs, large):
    got = S.without_repeats(spark, messy_docs, large).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((r[0], *x) for r, x in zip(messy, brute([r[1] for r in messy]), strict=True))


@pytest.mark.parametrize("large", [S.LARGE, 2])
def test_edited_copies_and_periods(spark, large):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) + passage[a : a + n] + "é" * rng.randrange(5) for a, n in [(0, 1500), (100, 1400), (37, 800), (500, 399), (501, 401), (700, 640), (0, 420)]]
    for _ in range(12):
        t = list(passage)
        t[rng.randrange(1500)] = "#"
        texts.append("".join(t))
    texts += ["xyz" * 400, "xyz" * 140, "zxy" * 140, "q" * 900, "q" * 399 + "r" + "q" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.without_repeats(spark, df, large).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_long_text_in_stretches(spark, monkeypatch):
    offsets = np.array([0, 10, 10, S.MOST + 500, S.MOST + 900])
    seen = []
    for at, to, lo, hi in S.pieces(offsets):
        for i in range(at, to):
            a, z = max(int(offsets[i]), lo), min(int(offsets[i + 1]), hi)
            seen += range(a, z - S.WINDOW + 1)
    assert len(seen) == len(set(seen)) == S.MOST + 490 - S.WINDOW + 1 + 1


def test_empty(spark, no_docs):
    assert S.without_repeats(spark, no_docs).count() == 0
