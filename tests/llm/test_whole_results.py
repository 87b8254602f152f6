"""Whole results of mixing, packing and the pipeline against plain programmes."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from palisade.llm import mixing, near_dedup, packing, shingles
from palisade.llm.suffix_dedup import utf8

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES = P.path("byte_bpe_50k.json")


def test_mix_is_earliest_deadline_first(spark):
    sizes = {None: 13, "a": 90, "b": 41, "c": 8, "d": 1}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mixture(spark, spark.createDataFrame(rows, "doc_id long, source string"), block=4).collect()
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    total, taken, order = sum(blocks.values()), dict.fromkeys(blocks, 0), []
    for slot in range(total):
        ready = [(-(-(taken[s] + 1) * total // n), k, s) for k, (s, n) in enumerate(blocks.items()) if taken[s] < n and taken[s] * total // n <= slot]
        s = min(ready, key=lambda x: x[:2])[2]
        order.append((s, taken[s]))
        taken[s] += 1
    assert {(r["source"], r["block"]): r["slot"] for r in got} == {b: slot for slot, b in enumerate(order)}
    assert all(r["selected"] for r in got) and Counter(r["source"] for r in got) == sizes
    for s, n in sizes.items():
        assert sorted(r["place"] for r in got if r["source"] == s) == list(range(n))


def test_packing_of_long_documents_is_optimal(spark):
    rng = random.Random(9)
    texts = [" ".join(["word"] * rng.choice([1, 2, 3, 40, 300, 2_100, 2_101, 2_130, 2_500, 3_000, 5_000, 9_000])) for _ in range(150)] + [None, ""]
    rows = packing.pack(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, buckets=4, budget=20_000).collect()
    lengths = [len(e.ids) for e in tokenizers.Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == dict(enumerate(lengths))
    distinct = sorted(set(lengths))
    best = min(sum(min(t for t in [*c, distinct[-1]] if t >= n) - n for n in lengths) for k in range(4) for c in combinations(distinct[:-1], k))
    assert sum(r["padding"] for r in rows) == best
    members = defaultdict(list)
    for r in rows:
        assert r["bucket_length"] - r["n_tokens"] == r["padding"] >= 0
        members[r["bucket"], r["bucket_length"], r["batch"]].append(r["place"])
    last = {b: max(k for x, _, k in members if x == b) for b, _, _ in members}
    for (bucket, length, batch), places in members.items():
        fit = max(1, 20_000 // max(length, 1))
        assert sorted(places) == list(range(len(places))) and (len(places) == fit or batch == last[bucket] and len(places) < fit)


def test_the_pipeline_keeps_what_plain_programmes_keep(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ing", "es", "tion"]) for _ in range(3)) + str(rng.randrange(90))
    texts = [None, "", "12 34", "..."]
    for _ in range(25):
        base = [word() for _ in range(80)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 9])):
                other[rng.randrange(80)] = word()
            texts.append((" " * rng.randrange(3)).join([" ".join(other), ""]))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {i: t for i, t in enumerate(texts) if t and any(map(str.isalpha, t))}
    groups = defaultdict(list)
    for i, t in left.items():
        groups[re.sub(r"[ \t\n\x0b\f\r]", "", t)].append(i)
    left = {i: left[i] for own in groups.values() for i in [min(own, key=lambda i: (-len(left[i]), i))]}
    ids, words = sorted(left), shingles.Words()
    found = [next(words.parts(*utf8(pa.array([left[i]]))))[2] for i in ids]
    df = np.zeros(shingles.BUCKETS, np.int64)
    for h in found:
        df[np.unique((h % np.uint64(shingles.BUCKETS)).astype(np.int64))] += 1
    idf = shingles.inverse_frequencies(df, len(ids))
    vectors = [shingles.weighted(h, np.zeros(len(h), np.int64), 1, idf)[1:] for h in found]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(zip(ids, vectors, strict=True), 2):
        if shingles.weighted_jaccard(x, y) >= near_dedup.SIMILAR:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {find(i) for i in ids}
    count = tokenizers.Tokenizer.from_file(BYTES).encode_batch([left[i] for i in sorted(want)], add_special_tokens=False)
    assert got == {i: len(e.ids) for i, e in zip(sorted(want), count, strict=True)}
