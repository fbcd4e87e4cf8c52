import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vertexloom.operators import hierarchy as H


def brute(parents):
    out = {}
    for start in parents:
        path, at = [start], start
        while True:
            up = parents[at]
            if up is None or up not in parents:
                out[start] = (at, len(path) - 1)
                break
            if up in path:
                out[start] = (min(path[path.index(up):]), -1)
                break
            path.append(up)
            at = up
    return out


def links(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id long, parent long")


def solved(df):
    return {r["id"]: (r["root"], r["depth"]) for r in df.collect()}


def forest(n, seed, far):
    rng = random.Random(seed)
    parents = {i: (rng.randrange(max(0, i - far), i) if i and rng.random() < 0.97 else None) for i in range(n)}
    for i in rng.sample(range(n), 6):
        parents[i] = min(n - 1, i + rng.randrange(5))  # loops, some of one
    parents[n - 2] = 10**9  # not an id of the table
    return parents


@pytest.mark.parametrize("far", [1, 3, 200])
def test_solve_equals_brute_force(spark, far):
    parents = forest(300, far, far)
    want = brute(parents)
    for rows, base in ((10_000, 1000), (40, 20)):  # one level; several
        assert solved(H.solve(links(spark, parents), rows_per_part=rows, base=base)) == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 12), st.one_of(st.none(), st.integers(0, 14)), max_size=12))
def test_any_small_forest(spark, parents):
    assert solved(H.solve(links(spark, parents), rows_per_part=5, base=3)) == brute(parents)


def test_current_links(spark):
    rows = [(1, 5, 2), (1, 7, 3), (1, 7, 3), (2, 4294967295, 1), (3, None, 1), (None, 3, 9), (4, 1, None), (4, 2, 0), (5, 1, None), (6, -3, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "id long, predecessor long, superstep int, parent string, _o int")
    assert {r["id"]: r["parent"] for r in H.current_links(df).collect()} == {1: 7, 2: None, 3: None, 4: 2, 5: 1, 6: None}
    assert H.solve(H.current_links(df.limit(0))).count() == 0
    assert H.hierarchy(H.current_links(df.limit(0))).count() == 0


@pytest.mark.parametrize("rows", [10_000, 60])
def test_paths_and_descendants(spark, rows):
    parents = forest(200, 11, 4)
    want = brute(parents)
    nodes = H.hierarchy(links(spark, parents), rows_per_part=rows, base=rows).cache()
    got = {r["id"]: r for r in nodes.collect()}
    assert {i: (r["root"], r["depth"]) for i, r in got.items()} == want

    def path(i):
        return path(parents[i]) + [i] if want[i][1] > 0 else [i]

    trees = [i for i in parents if want[i][1] >= 0]
    below = {i: {j for j in trees if j != i and i in path(j)} for i in trees}
    assert all(got[i]["size"] == len(below[i]) + 1 for i in trees)
    assert all(got[i]["size"] is None and got[i]["chain"] is None for i in parents if i not in trees)
    members = {i: sorted((r["pos"], r["id"]) for r in got.values() if r["chain"] == i) for i in trees}
    hops = {r["id"]: r["hops"] for r in H.path_hops(nodes).collect()}
    assert {i: [m for c, upto in h for _, m in members[c][: upto + 1]] for i, h in hops.items()} == {i: path(i) for i in trees}
    assert max(map(len, hops.values())) <= 8
    ids = spark.createDataFrame([(i,) for i in [*parents, 5, 10**7]], "id long")
    assert {r["id"]: r["path"] for r in H.full_paths(nodes, ids).collect()} == {i: path(i) for i in trees}
    found = {i: set() for i in trees}
    for r in H.descendants(nodes, ids).collect():
        found[r["id"]].add(r["below"])
    assert found == below
    chains = H.chains(nodes, block=8).collect()
    assert sum(len(r["members"]) for r in chains) == len(trees) and max(len(r["members"]) for r in chains) <= 8
    for r in chains:  # a chain's members follow each other downwards
        for a, b in zip(r["members"], r["members"][1:]):
            assert parents[b] == a


def test_a_long_chain(spark):
    n = 3000
    got = solved(H.solve(links(spark, {i: i - 1 if i else None for i in range(n)}), rows_per_part=300, base=100))
    assert got == {i: (0, i) for i in range(n)}


def test_a_star_with_one_hot_parent(spark):
    got = solved(H.solve(links(spark, {i: 0 if i else None for i in range(2000)}), rows_per_part=300, base=100))
    assert got == {i: (0, min(i, 1)) for i in range(2000)}


def _two_id_loops(n):
    """Loops of one to three ids, of which the most have two, each with a tail, beside a few trees."""
    parents = {}
    for i in range(n):
        a = 10 * i
        parents |= {a: a + 1, a + 1: a, a + 5: a + 1, a + 6: a + 5}
        if i % 9 == 0:
            parents |= {a + 1: a + 2, a + 2: a, a + 7: a + 7, a + 8: a + 7}
        if i % 7 == 0:
            parents |= {a + 3: None, a + 4: a + 3, a + 9: a + 4}
    return parents


def test_many_small_loops_leave_the_quotient(spark, monkeypatch):
    levels, solve = [], H._solve

    def counted(ws, t, n, rows, base, level=0):
        levels.append((level, n))
        assert level < 40, "the loops are never solved"
        return solve(ws, t, n, rows, base, level)

    monkeypatch.setattr(H, "_solve", counted)
    parents = _two_id_loops(60)
    assert solved(H.solve(links(spark, parents), rows_per_part=5, base=3)) == brute(parents)
    assert len(levels) > 2 and levels[-1][1] <= 3


def test_contraction_shrinks_with_many_partitions(spark, monkeypatch):
    """A shuffled chain, of whose links no partition holds more than a few by chance."""
    sizes, solve = [], H._solve
    monkeypatch.setattr(H, "_solve", lambda ws, t, n, *rest: sizes.append(n) or solve(ws, t, n, *rest))
    n = 2000
    parents = {i * 7919 % n: (i - 1) * 7919 % n if i else None for i in range(n)}
    got = solved(H.solve(links(spark, parents), rows_per_part=50, base=800))
    assert got == {i * 7919 % n: (0, i) for i in range(n)}
    assert all(b < 0.85 * a for a, b in zip(sizes[1:], sizes[2:]))


def test_hot_parents_with_inner_children(spark, monkeypatch):
    """A parent of a third of all nodes, each with a child: its children aren't gathered, neither to contract nor to expand."""
    hot, inner = [], H._inner
    monkeypatch.setattr(H, "_inner", lambda *a: hot.append(inner(*a)) or hot[-1])
    parents = {0: None, 1: 0} | {i: 1 for i in range(2, 700)} | {700 + i: i for i in range(2, 700)} | {2000 + i: 700 + i for i in range(2, 600)}
    nodes = H.hierarchy(links(spark, parents), rows_per_part=100, base=30)
    want = brute(parents)
    got = {r["id"]: r for r in nodes.collect()}
    assert {i: (r["root"], r["depth"]) for i, r in got.items()} == want
    assert got[1]["size"] == len(parents) - 1 and got[5]["size"] == 3
    assert any(h is not None for _, _, h in hot)
