import random

from vertexloom.operators import prefix, salted

NO = 4294967295


def brute(rows):
    out = {}
    for name, pairs in (("src_vert", rows), ("dest_vert", [(b, a) for a, b in rows])):
        for vert, other in pairs:
            if vert is not None and 0 <= vert < NO:
                out.setdefault((name, vert), []).append(other if other is not None and 0 <= other < NO else None)
    return {k: (len(v), len({x for x in v if x is not None}), min((x for x in v if x is not None), default=None)) for k, v in out.items()}


def stats(df, **kw):
    return {(r["endpoint"], r["vert"]): (r["degree"], r["distinct_neighbours"], r["smallest_neighbour"]) for r in salted.endpoint_stats(df, **kw).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "src_vert long, dest_vert long, _salt int, vert string")


def test_equals_brute_force(spark):
    rng = random.Random(1)
    ends = [None, NO, -4, 7, 7, 7, 7, *range(40)]
    rows = [(rng.choice(ends), rng.choice(ends)) for _ in range(2000)] + [(7, 7)] * 50 + [(99, None), (None, None)]
    for salts, share in ((64, 0.001), (3, 0.05), (1, 2.0)):
        assert stats(frame(spark, rows), salts=salts, share=share) == brute(rows)


def test_empty(spark):
    assert stats(frame(spark, [(1, 2)]).limit(0)) == {}
    assert salted.heavy_endpoints(salted.endpoint_stats(frame(spark, [(1, 2)]).limit(0)), 50).count() == 0


def test_heavy_endpoints_at_the_border(spark):
    rows = [(1, 0)] * 7 + [(i, 0) for i in range(100, 443)]  # 7 of 350 rows are exactly 1/50
    got = {(r["endpoint"], r["vert"]) for r in salted.heavy_endpoints(salted.endpoint_stats(frame(spark, rows)), 50).collect()}
    assert got == {("src_vert", 1), ("dest_vert", 0)}


def test_hot_key_is_spread(spark):
    rows = frame(spark, [(1, i) for i in range(5000)] + [(i, 1) for i in range(2, 2000)])
    hot = {r["src_vert"] for r in salted.heavy_keys(rows, ["src_vert"], 0.01).collect()}
    assert hot == {1}


def test_prefix_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.getrandbits(64) - 2**63, i, rng.choice([None, 1, 5])) for i in range(500)]
    rows += [("a", rows[0][1], 1000 + i, 2) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "g string, h long, id long, v long")
    got = {r["id"]: r["before"] for r in prefix.prefix_sums(df, ["g"], "h", "id", "v", buckets=16).collect()}
    sums = {}
    for g, h, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    assert prefix.prefix_sums(df.limit(0), ["g"], "h", "id", "v").count() == 0


def test_a_key_is_heavy_relative_to_the_tasks():
    assert salted.heavy_share(8) == salted.HEAVY_SHARE and salted.heavy_share(20_000) == 1 / 80_000
