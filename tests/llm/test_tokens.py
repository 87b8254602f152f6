"""Token counts, the token store and packing."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from palisade.llm import packing, token_count, token_store  # noqa: E402

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  two  spaces ", "a\n\n b\t c", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "don't we'll I'M", "é€𝄞 ﬁ Å İ ß ΑΣ", "!!!???...", "a.b,c d. e, f.. g,,", "1234567 12.5", "z" * 3000, "  x　y", "日本語 テキスト", "<|startoftext|>q", "word.\nWord,\nWORD"]


def library(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(spark, messy, messy_docs, no_docs):
    rows = [*enumerate(ODD), *((r[0], r[1]) for r in messy)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_count.token_counts(spark, df, BYTES).collect()
    want = Counter((i, len((t or "").encode()), len(ids), len(ids) > 1024) for (i, t), ids in zip(rows, library(BYTES, [t or "" for _, t in rows]), strict=True))
    assert Counter(map(tuple, got)) == want
    assert token_count.token_counts(spark, no_docs, BYTES).count() == 0


def test_both_counters_agree():
    with open(BYTES, encoding="utf-8") as f:
        file = f.read()
    own, lib = token_count.Counter(token_count.Merges(file)), token_count.Counter(token_count.LibraryMerges(file))
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab é\n.,'sT1 ") for _ in range(rng.randrange(60)))
        assert own.count(t) == lib.count(t) == len(library(BYTES, [t])[0])


def test_store_round_trip(spark, messy, tmp_path):
    rows = [*enumerate(ODD, 100), *((r[0], r[1]) for r in messy)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with open(WORDS, encoding="utf-8") as f:
        store = token_store.write_store(spark, df, f.read(), 2, rows_in_file=20)
    ids = [x + [2] for x in library(WORDS, [t or "" for _, t in rows])]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = token_store.read_checksums(spark, store).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for (i, _), x in zip(rows, ids, strict=True))
    # starts follow the order of ids, nulls first, without gaps
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    back = {r["start"]: list(r["ids"]) for r in token_store.read_ids(spark, store).collect()}
    assert all(crc(back[r["start"]]) == r["ids_crc32"] for r in got)
    names = [r["name"] for r in store.chunks(spark).collect()]
    assert len(names) == len(set(names))
    assert store.manifest(spark).groupBy().sum("documents").first()[0] == len(rows)


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "some words to keep"), (2, "others")], "doc_id long, text string")
    with open(WORDS, encoding="utf-8") as f:
        store = token_store.write_store(spark, df, f.read(), 2)
    bad = store.chunks(spark).selectExpr("name AS key", "concat(data, X'0000') AS data").collect()
    spark.createDataFrame(bad, "key binary, data binary").write.mode("overwrite").parquet(f"{store.path}/chunks")
    with pytest.raises(Exception, match="does not verify"):
        token_store.read_checksums(spark, store).collect()


def test_empty_store(spark, no_docs):
    assert token_store.token_store(spark, no_docs, WORDS).count() == 0


def test_cuts_follow_contents():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 20_000)
    for n in (1, 63, 64, 65, 2048, 20_000):
        ends = token_store.cuts(ids[:n])
        sizes = np.diff([0, *ends])
        assert ends[-1] == n and sizes.max() <= token_store.MOST and all(s >= token_store.LEAST for s in sizes[:-1])
    a, b = token_store.cuts(ids), token_store.cuts(np.concatenate([rng.integers(0, 40_000, 777), ids]))
    assert len({x + 777 for x in a} & set(b)) > 0.8 * len(a)
    assert max(np.diff([0, *token_store.cuts(np.zeros(10_000, int))])) <= token_store.MOST


def test_crc_shift():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(40)), rng.randbytes(rng.randrange(2000))
        got = token_store.shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
        assert got == zlib.crc32(a + b)


def padding(lengths, counts, tops):
    return sum(c * (min(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_against_all_choices():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        tops = packing.boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
        assert len(tops) <= k and tops[-1] == lengths[-1] and padding(lengths, counts, tops) == best
    assert packing.boundaries(np.zeros(0), np.zeros(0)) == []


def test_packing(spark, messy, messy_docs, no_docs):
    rows = packing.pack(spark, messy_docs, BYTES, buckets=4, budget=2_000).collect()
    assert len(rows) == len(messy)
    batches = {}
    for r in rows:
        assert r["padding"] == r["bucket_length"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for members in batches.values():
        length = members[0]["bucket_length"]
        assert len(members) == 1 or len(members) * length <= 2_000
        assert sorted(m["place"] for m in members) == list(range(len(members)))
    assert packing.pack(spark, no_docs, BYTES).count() == 0
