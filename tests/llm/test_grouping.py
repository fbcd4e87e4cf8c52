import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vertexloom.llm import grouping

NO = 4294967295


def brute(tables):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for rows in tables:
        for a, b in rows:
            ends = [x for x in (a, b) if x is not None and 0 <= x < NO]
            for x in ends:
                top(x)
            if len(ends) == 2:
                a, b = sorted(map(top, ends))
                up[b] = a
    return {v: top(v) for v in up}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "a long, b long, v int, component_root string")


def got(spark, *tables):
    out = grouping.components([(frame(spark, t), "a", "b") for t in tables]).collect()
    assert len({r["vert"] for r in out}) == len(out)
    return {r["vert"]: r["component_root"] for r in out}


@pytest.fixture(params=[grouping.LAST, 3])
def last(request, monkeypatch):
    """With 3, nearly all rounds of the propagation run distributed."""
    monkeypatch.setattr(grouping, "LAST", request.param)
    monkeypatch.setattr(grouping, "GAIN", 500 if request.param == 3 else grouping.GAIN)
    monkeypatch.setattr(grouping, "CHUNK", 50 if request.param == 3 else grouping.CHUNK)


def test_random_graph(spark, last):
    rng = random.Random(8)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(500, 500 + rng.randrange(1, 60)) for _ in range(150)]
    pairs += [(None, 3), (7, NO), (NO, None), (-5, 900), (901, 901)] + pairs[:20] + [(b, a) for a, b in pairs[:20]]
    states = [(rng.randrange(420), rng.randrange(420)) for _ in range(30)] + [(1000, None), (1001, NO)]
    assert got(spark, pairs, states) == brute([pairs, states])


def test_long_chains(spark, last):
    chain = [(i, i + 1) for i in range(1000, 1200)]
    down = [(i + 1, i) for i in range(5000, 5150)]
    star = [(3, i) for i in range(10, 300)] + [(299, 400), (400, 401), (401, 402)]  # the giant with a thin tail
    assert got(spark, chain + down + star, []) == brute([chain + down + star])


def test_no_links(spark):
    assert got(spark, [(5, 5), (None, 6), (NO, None)], []) == {5: 5, 6: 6}
    assert got(spark, [], []) == {}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-1, 9)), st.integers(0, 9)), max_size=12))
def test_any_small_graph(spark, pairs):
    assert got(spark, pairs) == brute([pairs])


def test_a_search_that_gains_little_ends(spark, monkeypatch):
    """A shuffled path, of which a level of the search finds two vertices: it is left to the propagation within few jobs."""
    monkeypatch.setattr(grouping, "CHUNK", 50)
    rng = random.Random(5)
    names = list(range(20_000))
    rng.shuffle(names)
    pairs = list(zip(names, names[1:]))
    rng.shuffle(pairs)
    levels, cut = [], grouping.Workspace.cut_measured
    monkeypatch.setattr(grouping.Workspace, "cut_measured", lambda self, df, **m: levels.append(1) or cut(self, df, **m))
    out = grouping.components([(spark.createDataFrame(pairs, "a long, b long").repartition(8), "a", "b")])
    assert out.where("component_root = 0").count() == 20_000 == out.count()
    assert len(levels) <= 30


def test_the_search_starts_at_the_highest_degree_of_the_input(spark, monkeypatch):
    """Repeated rows count: 5 has more rows than the larger component's 100."""
    tops, peel = [], grouping._peel
    monkeypatch.setattr(grouping, "_peel", lambda ws, edges, n, top: tops.append(top.first()["v"]) or peel(ws, edges, n, top))
    pairs = [(100, i) for i in range(101, 130)] + [(5, 6), (5, 7)] * 20 + [(6, 7)]
    assert got(spark, pairs) == brute([pairs]) and tops == [5]
