import random

import pytest

from vertexloom.llm import mixing
from vertexloom.llm.mixing import Node


def sizes(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, n_tokens long, before int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def tree(spec):
    """{source: (weight, {lang: (weight, supply)})}"""
    root = Node(())
    for s, (w, langs) in spec.items():
        root.children[s] = Node((s,), w, sum(x for _, x in langs.values()), {k: Node((s, k), lw, x) for k, (lw, x) in langs.items()})
    root.supply = sum(c.supply for c in root.children.values())
    return root


def test_a_shortage_goes_to_siblings_before_ancestors():
    root = tree({"a": (0.5, {"en": (1, 10), "de": (1, 1000)}), "b": (0.5, {"en": (1, 1000)})})
    mixing.distribute(root, 400)
    a = root.children["a"]
    assert (a.budget, a.children["en"].budget, a.children["de"].budget, root.children["b"].budget) == (200, 10, 190, 200)
    root = tree({"a": (0.5, {"en": (1, 10), "de": (1, 20)}), "b": (0.5, {"en": (1, 1000)})})
    mixing.distribute(root, 400)
    assert (root.children["a"].budget, root.children["b"].budget) == (30, 370)
    mixing.distribute(root, 10**6)
    assert root.budget == 1030


def test_budgets_are_whole_and_add_up():
    root = tree({c: (1 / 3, {"en": (1, 100)}) for c in "abc"})
    mixing.distribute(root, 100)
    assert sorted(c.budget for c in root.children.values()) == [33, 33, 34]
    assert mixing.largest_even_total(list(tree({"a": (0.2, {"en": (1, 10)}), "b": (0.6, {"en": (1, 90)}), "c": (0.2, {})}).children.values())) == 40


def test_shares_and_repeats(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aaaabbc"), rng.choice(["en", "EN", "de", None, "und"]), rng.randrange(0, 60)) for i in range(3000)] + [(9000, None, "en", 50), (9001, "other", "en", 50)]
    goals = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 4), (None, 0.1, 1)]
    mix = mixing.mix(sizes(spark, rows), targets(spark, goals))
    shares = {r["source"]: r for r in mix.shares.collect()}
    assert set(shares) == {"a", "b", "c", "none", "other", None}
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert shares[s]["actual_share"] == pytest.approx(want, abs=0.01)
        assert abs(shares[s]["tokens"] - shares[s]["budget"]) <= 3 * 30
    assert shares["none"]["tokens"] == shares["other"]["tokens"] == shares[None]["tokens"] == 0
    picked = mix.selected.collect()
    limit = {"a": 1, "b": 2, "c": 3}
    assert len({r["doc_id"] for r in picked}) == len(picked) and all(1 <= r["uses"] <= limit[r["source"]] for r in picked)
    again = mixing.mix(sizes(spark, rows).repartition(7), targets(spark, goals))
    assert sorted(map(tuple, again.selected.collect())) == sorted(map(tuple, picked))
    other = mixing.mix(sizes(spark, rows), targets(spark, goals), seed=18).selected
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, picked))


def test_a_prefix_in_the_leaf_s_order(spark):
    """A leaf takes a prefix of its seeded order, whatever the number of buckets."""
    rows = [(i, "a", "en", 10) for i in range(200)] + [(i, "b", "en", 1) for i in range(200, 400)]
    goals = [("a", 0.5, 1), ("b", 0.5, 1)]
    few, many = (mixing.mix(sizes(spark, rows), targets(spark, goals), buckets=n).selected for n in (2, 1024))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert few.where("source = 'a'").count() == 20 and few.where("source = 'b'").count() == 200


def test_a_larger_total(spark):
    rows = [(1, "a", "en", 10), (2, "b", "en", 100)]
    mix = mixing.mix(sizes(spark, rows), targets(spark, [("a", 0.5, 3), ("b", 0.5, 1)]), total=120)
    got = {r["source"]: (r["tokens"], r["most_uses"]) for r in mix.shares.collect()}
    assert got == {"a": (30, 3), "b": (100, 1)}


def test_domains_and_languages_fall_short(spark):
    """Languages ask for their share of the corpus; what a source lacks is made up in its domain before another gives more."""
    rows = [(i, "a", "en", 10) for i in range(50)] + [(100 + i, "a", "de", 10) for i in range(5)] + [(200 + i, "b", "de", 10) for i in range(100)] + [(400 + i, "c", "en", 10) for i in range(95)]
    goals = [("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.25, 1)]
    even = mixing.mix(sizes(spark, rows), targets(spark, goals))
    leaves = {(r["source"], r["lang"]): r for r in even.leaves.collect()}
    # 1,450 tokens are en, 1,050 de: of a's 550, de is asked for 231 and has 50.
    assert leaves["a", "de"]["asked"] == pytest.approx(550 * 1050 / 2500) and leaves["a", "de"]["budget"] == 50 and leaves["a", "en"]["budget"] == 500
    assert {r["source"]: r["budget"] for r in even.shares.collect()} == {"a": 550, "b": 275, "c": 275}
    mix = mixing.mix(sizes(spark, rows), targets(spark, goals), total=1600, domains={"a": "x", "b": "x", "c": "y"})
    got = {r["source"]: r["tokens"] for r in mix.shares.collect()}
    assert got == {"a": 550, "b": 650, "c": 400}  # a lacks 250 of its 800: b, of its domain, gives them
    twice = mixing.mix(sizes(spark, rows), targets(spark, goals), stretch=2.0, domains={"a": "x", "b": "y", "c": "x"})
    assert {r["source"]: r["budget"] for r in twice.shares.collect()} == {"a": 550, "b": 700, "c": 950}  # x can't give its 1,650


def test_empty(spark):
    none = mixing.mix(sizes(spark, [(1, "a", "en", 5)]).limit(0), targets(spark, [("a", 1.0, 1)]))
    assert none.selected.count() == 0 and none.shares.count() == 1
    none = mixing.mix(sizes(spark, [(1, "a", "en", 5)]), targets(spark, [("a", 1.0, 1)]).limit(0))
    assert none.selected.count() == 0 and [r["available"] for r in none.shares.collect()] == [5]
    none = mixing.mix(sizes(spark, [(1, "a", "en", 0), (None, "a", None, None)]), targets(spark, [("a", None, None), ("a", 0.5, 1)]))
    assert none.selected.count() == 0
