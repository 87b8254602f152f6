import math
import random
from collections import defaultdict

import numpy as np
import pytest

from palisade.llm import nearest as N


def brute(rows, every, k=5):
    use = []
    for at, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            use.append((at, i, np.array(v, float)))
    out = {}
    for at, i, v in use:
        if i is not None and i % every == 0:
            s = [(-float(v @ w / math.sqrt(v @ v) / math.sqrt(w @ w)), j) for b, j, w in use if b != at]
            out.setdefault(i, []).append(sorted(s, key=lambda x: (round(x[0], 12), x[1]))[:k])
    return out


def answers(df):
    got = defaultdict(dict)
    for r in df.collect():
        got[r["query_id"]].setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return got


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 24))
    x = np.concatenate([rng.standard_normal((1500, 24)), centres[rng.integers(0, 10, 1500)] + 0.05 * rng.standard_normal((1500, 24))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(N.neighbours(spark, df)), brute(rows, 50)
    hits = sum(len({v for _, v in want[q][0]} & {a[0] for r in got[q].values() for a in r}) for q in want)
    assert set(got) == set(want) and hits / (5 * len(want)) >= 0.95
    for q, ranks in got.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        for a in ranks.values():
            v, w = x[q], x[a[0][0]]
            assert a[0][1] == pytest.approx(v @ w / math.sqrt(v @ v) / math.sqrt(w @ w), abs=1e-12)


def test_many_cells_and_shards(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    monkeypatch.setattr(N, "QUERY_ROWS", 3)
    monkeypatch.setattr(N, "MOST_CELLS", 8)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(800)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = answers(N.neighbours(spark, df)), brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 50)
    hits = sum(len({v for _, v in want[q][0]} & {a[0] for r in got[q].values() for a in r}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    # among equal vectors the smallest ids are found
    assert [got[1050][r][0][0] for r in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [float("nan"), 1.0]), (250, [None, 1.0]), (300, [1e300, 1e300]), (7, [0.5]), (None, [0.0, 1.0])]
    got = answers(N.neighbours(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert set(got) == {0, 300}
    assert [x[0] for x in got[0][1]] == [0, 0] and [x[0] for x in got[0][2]] == [7, 7] and len(got[0]) == 4
    assert [got[300][r][0][0] for r in (1, 2, 3, 4)] == [0, 0, 7, None]
    assert N.neighbours(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantile():
    assert N.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert N.chi_square_quantile(0.99, 12) == pytest.approx(26.217, abs=1e-2)
