import random
from collections import Counter

import numpy as np
import pytest

from vertexloom.llm import heavy_hitters as hh


def frame(spark, values):
    return spark.createDataFrame([(v, 1, "x") for v in values], "v long, n int, value string").repartition(3)


def test_estimates_are_never_low_and_the_heavy_ones_are_found(spark):
    rng = random.Random(2)
    values = [rng.choice([7, 7, 7, 8, 8, -9]) if rng.random() < 0.5 else rng.randrange(10**6) for _ in range(20_000)] + [None] * 500
    truth = Counter(v for v in values if v is not None)
    for width, keep in ((1 << 16, 4096), (1 << 10, 64)):
        got = {r["value"]: r["approx_count"] for r in hh.candidates(frame(spark, values), "v", parts=3, width=width, keep=keep).collect()}
        assert len(got) <= 3 * keep and all(n >= truth[v] for v, n in got.items())
        assert {7, 8, -9} <= set(got)
        assert all(got[v] <= truth[v] + 2.72 * len(values) / width for v in (7, 8, -9))
    top = [(r["value"], r["approx_count"]) for r in hh.most_frequent(frame(spark, values), "v", 3).collect()]
    assert [v for v, _ in top] == [v for v, _ in truth.most_common(3)]


@pytest.mark.parametrize("most", [hh.MOST_BROADCAST, 0])
def test_holders_at_the_border(spark, monkeypatch, most):
    monkeypatch.setattr(hh, "MOST_BROADCAST", most)
    values = [1] * 5 + [2] * 4 + list(range(100, 1991)) + [None] * 100  # 5 of 1900 rows are less, 4 of 1600 exactly one in 400
    assert {r["value"] for r in hh.holders(frame(spark, values), "v", 400).collect()} == {1}
    values = [1] * 5 + [2] * 4 + list(range(100, 1691))
    assert {r["value"]: r["n"] for r in hh.holders(frame(spark, values), "v", 400).collect()} == {1: 5, 2: 4}


def test_empty_null_and_ties(spark):
    assert hh.candidates(frame(spark, [1]).limit(0), "v").count() == 0
    assert hh.holders(frame(spark, [None, None]), "v", 400).count() == 0
    assert [r["value"] for r in hh.most_frequent(frame(spark, [3, 2, 1, 1, 2, 3]), "v", 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        hh.holders(frame(spark, [1]), "v", 400, keep=100)
    with pytest.raises(ValueError):
        hh.most_frequent(frame(spark, [1]), "v", 10**6)


def test_sketch_in_batches_keeps_the_bound():
    rng = np.random.default_rng(4)
    sketch, truth = hh.Sketch(width=256, candidates=32), Counter()
    for _ in range(30):
        v, n = np.unique(rng.zipf(1.3, 2000) % 5000, return_counts=True)
        truth.update(dict(zip(v.tolist(), n.tolist())))
        sketch.add(v.astype(np.int64), n.astype(np.int64))
    kept = dict(zip(sketch.values.tolist(), sketch.estimates.tolist()))
    assert len(kept) == 32 and all(e >= truth[v] for v, e in kept.items())
    assert {v for v, _ in truth.most_common(8)} <= set(kept)
