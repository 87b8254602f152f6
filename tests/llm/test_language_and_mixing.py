import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import language_id as L
from palisade.llm import mixing as M


def brute_length(samples, text):
    """Code length in bits, from plain context dictionaries."""
    counts = [Counter(), Counter(), Counter()]
    for t in samples:
        b = b"  " + t
        for i in range(2, len(b)):
            for k in range(3):
                counts[k][b[i - k : i], b[i]] += 1
    tables = [{} for _ in range(3)]
    for k in range(3):
        for (c, s), n in counts[k].items():
            tables[k].setdefault(c, {})[s] = n

    def p(k, c, s):
        if k < 0:
            return 1 / 256
        own = tables[k].get(c)
        if not own:
            return p(k - 1, c[1:], s)
        weight = sum(own.values()) + len(own)
        return own[s] / weight if s in own else len(own) / weight * p(k - 1, c[1:], s)

    b = b"  " + text
    return sum(-math.log2(p(2, b[i - 2 : i], b[i])) for i in range(2, len(b)))


def test_code_lengths():
    rng = random.Random(1)
    samples = {"x": [b"the cat sat on the mat", b"a cat"], "y": ["über öde höhen".encode(), b"der hut"]}
    model = L.fit(samples)
    texts = [bytes(rng.choice(b"thecasmou \xc3\xbc~") for _ in range(rng.randrange(30))) for _ in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = L.code_lengths(model, data, offsets)
    for row, t in zip(got, texts, strict=True):
        for at, k in enumerate(model.languages):
            assert row[at] / L.UNIT == pytest.approx(brute_length(samples[k], t), abs=0.001 * (len(t) + 1))


def test_batches_do_not_matter(monkeypatch):
    model = L.fit({"x": [b"one two three"], "y": [b"eins zwei drei"]})
    texts = [b"two", b"", b"zwei drei eins " * 9, b"o", b"ne"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    one = L.code_lengths(model, data, offsets)
    monkeypatch.setattr(L, "SCORED", 4)
    assert (L.code_lengths(model, data, offsets) == one).all()


def test_letters_and_nulls():
    model = L.fit({"x": [b"abc"], "y": [b"xyz"]})
    lang, score, _ = L.predict(model, pa.array([None, "", "123 !?", "abc", "é", "中", "²½", "xyz xyz"]))
    assert lang[:3] == ["und"] * 3 and lang[3] == "x" and lang[4] != "und" and lang[5] != "und" and lang[6] == "und" and lang[7] == "y"
    assert (score >= 0).all() and (score <= 1).all() and score[0] == 0


def test_languages(spark, messy, messy_docs, no_docs):
    rng = random.Random(2)
    parts = {"aa": ["ba", "be", "lo"], "bb": ["zu", "xi", "qo"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(12)), k) for i in range(300) for k in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in L.languages(spark, df).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    found = L.languages(spark, messy_docs).collect()
    assert len(found) == len(messy) and Counter(r["lang_pred"] == "und" for r in found)[True] == sum(not any(map(str.isalpha, r[1] or "")) for r in messy)
    assert L.languages(spark, no_docs).count() == 0
    kept = L.keep_languages(spark, messy_docs)
    assert kept.columns == messy_docs.columns and kept.count() <= len(messy)
    assert {r["lang_pred"] for r in L.languages(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_shares():
    assert M.natural_weights({"a": 90, "b": 5, "c": 5, "d": 5, "e": 5}, 0.25) == {"a": Fraction(1, 4)} | {k: Fraction(3, 16) for k in "bcde"}
    assert M.natural_weights({"a": 3, "b": 1}, 0.25) == {"a": Fraction(1, 2), "b": Fraction(1, 2)}
    assert M.natural_weights({}) == {} and M.natural_weights({None: 4}) == {None: 1}
    q = M.quotas({k: Fraction(1, 3) for k in "abc"}, 16)
    assert sum(q.values()) == 16 and max(q.values()) - min(q.values()) <= 1
    assert M.quotas({"a": Fraction(10**6), "b": Fraction(1)}, 8) == {"a": 7, "b": 1}
    with pytest.raises(ValueError, match="slots"):
        M.quotas({str(i): Fraction(1) for i in range(9)}, 8)


def test_lag_is_below_one_block():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        quota = M.quotas({str(i): Fraction(rng.randint(1, 100)) for i in range(n)}, 128)
        had = Counter()
        for slot, (k, j) in enumerate(M.frame_schedule(quota)):
            assert had[k] == j
            had[k] += 1
            for s, q in quota.items():
                assert abs(had[s] - Fraction(q * (slot + 1), 128)) < 1
        assert had == Counter(quota)


def test_mixture(spark, messy, messy_docs, no_docs):
    rows = [(i, "s%d" % (0 if i % 3 == 0 else i % 5)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"s0": 0.5, "s1": 0.25, "s2": 0.125, "s3": 0.125, "gone": 1.0}
    got = M.mixture(spark, df, weights, block=4).collect()
    assert len(got) == 2_000
    taken = sorted((r["slot"], r["place"], r["source"]) for r in got if r["selected"])
    had, seen = Counter(), Counter()
    for slot, _, s in taken:
        seen[slot] += 1
        had[s] += 1
    slots = sorted(seen)
    assert slots == list(range(len(slots)))
    runs = Counter()
    for slot, s in sorted({(a, c) for a, _, c in taken}):
        runs[s] += 1
        for k, w in (("s0", 0.5), ("s1", 0.25), ("s2", 0.125), ("s3", 0.125)):
            assert abs(runs[k] - w * (slot + 1)) < 1
    assert {r["source"] for r in got if r["slot"] is None} == {"s4"}
    places = [(r["source"], r["place"]) for r in got]
    assert len(set(places)) == 2_000
    found = M.mixture(spark, messy_docs).collect()
    assert len(found) == len(messy) and {r["source"] for r in found} == {r[3] for r in messy}
    assert M.mixture(spark, no_docs).count() == 0
    mixed = M.mix(spark, messy_docs)
    assert mixed.columns == messy_docs.columns and mixed.count() == sum(r["selected"] for r in found)
