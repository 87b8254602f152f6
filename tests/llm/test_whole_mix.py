"""The default mix takes every document, whatever the sources' sizes and number."""

from collections import Counter

from palisade.llm import mixing as M


def sources(spark, sizes):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string").repartition(4)


def kept(spark, sizes, **more):
    got = M.mixture(spark, sources(spark, sizes), **more).groupBy("selected").count().collect()
    return {r["selected"]: r["count"] for r in got}.get(True, 0) / sum(sizes.values())


def test_uneven_sources_are_kept(spark):
    for sizes in ({"a": 4800, "b": 2400, "c": 800}, {"a": 2720, "b": 2640, "c": 2400, "d": 240}, {"a": 8000, None: 5}):
        assert kept(spark, sizes) > 0.97


def test_rounding_loses_nothing(spark):
    sizes = {f"s{i}": 2000 for i in range(20)} | {"few": 960}
    assert kept(spark, sizes, frame=64) == 1


def test_more_sources_than_a_frame_has_slots(spark):
    sizes = {"large": 3000, "half": 1500, None: 17} | {f"s{i}": 1 + i % 30 for i in range(200)}
    got = M.mixture(spark, sources(spark, sizes), frame=64).collect()
    assert all(r["selected"] for r in got) and len(got) == sum(sizes.values())
    slots = {r["slot"]: (r["source"], r["block"]) for r in got}
    blocks = {s: -(-n // M.BLOCK) for s, n in sizes.items()}
    assert sorted(slots) == list(range(sum(blocks.values()))) and len(set(slots.values())) == len(slots)
    had = Counter()
    for slot in sorted(slots):
        s, b = slots[slot]
        assert had[s] == b  # a source's blocks come in their order
        had[s] += 1
        assert all(abs(had[k] - n * (slot + 1) / len(slots)) < 2 for k, n in blocks.items() if n * 64 >= len(slots))


def test_weights_over_frames(spark):
    sizes = {"a": 4000, "b": 900, "c": 800, "d": 50}
    weights = {"a": 0.7, "b": 0.1, "c": 0.195, "d": 0.005}
    got = M.mixture(spark, sources(spark, sizes), weights, frame=64).collect()
    assert all(r["slot"] is not None for r in got)
    slots = {r["slot"]: r["source"] for r in got if r["selected"]}
    assert sorted(slots) == list(range(len(slots))) and len(slots) > 0.9 * min(n / M.BLOCK / weights[s] for s, n in sizes.items())
    had = Counter()
    for slot in sorted(slots):
        had[slots[slot]] += 1
        assert all(abs(had[k] - w * (slot + 1)) < 2 for k, w in weights.items() if w * 64 >= 1)
