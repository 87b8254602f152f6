import hashlib
import re
from collections import Counter, defaultdict

from palisade.llm import exact_dedup as E


def wanted(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    out = []
    for text, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if keep[1] else keep[2], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def test_messy_rows(spark, messy, messy_docs):
    got = E.exact_copies(spark, messy_docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == wanted(messy)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})


def test_more_rounds_give_the_same(spark, messy_docs, monkeypatch):
    one = Counter(map(tuple, E.exact_copies(spark, messy_docs).collect()))
    monkeypatch.setattr(E, "rounds_for", lambda rows: 3)
    monkeypatch.setattr(E, "RUN", 2)
    two = Counter(map(tuple, E.exact_copies(spark, messy_docs).collect()))
    key = lambda c: Counter({(k[0], k[1], k[2], k[4]): n for k, n in c.items()})
    assert sum(one.values()) == sum(two.values()) and set(key(one)) == set(key(two))


def test_empty_and_plain_frames(spark, no_docs, messy):
    assert E.exact_copies(spark, no_docs).count() == 0
    df = spark.createDataFrame([(2, "a b"), (1, "ab"), (3, "c")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in E.exact_copies(spark, df).collect()} == {(2, 2, True), (1, 2, False), (3, 3, True)}


def test_drop_keeps_columns(spark, messy_docs):
    left = E.drop_copies(spark, messy_docs)
    assert left.columns == messy_docs.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in messy_docs.collect()})


def test_merge_is_multiway():
    rec = lambda d, n, i, size=1: d * 32 + n.to_bytes(8, "big") + b"\0" + i.to_bytes(8, "big") + b"u" * 16 + size.to_bytes(8, "big")
    runs = [[rec(b"a", 5, 1), rec(b"b", 1, 9)], [rec(b"a", 4, 7)], [rec(b"a", 4, 3), rec(b"c", 2, 2)]]
    import heapq

    got = list(E.merged(heapq.merge(*runs)))
    assert [(x[:1], int.from_bytes(x[41:49], "big"), int.from_bytes(x[-8:], "big")) for x in got] == [(b"a", 3, 3), (b"b", 9, 1), (b"c", 2, 1)]
