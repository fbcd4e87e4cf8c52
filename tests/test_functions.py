import math

from pyspark.sql import functions as F

from vertexloom.functions import scalars, vertex_ids


def one(spark, df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_float_eq(spark):
    pairs = [(1.0, 1.0009), (1.0, 1.001), (1.0, 1.0011), (math.inf, math.inf), (math.nan, 1.0), (None, 1.0), (math.inf, 5.0)]
    df = spark.createDataFrame(pairs, "x double, v double")
    got = [r[0] for r in one(spark, df, scalars.float_eq(F.col("x"), F.col("v")))]
    assert got[0] is True and got[2:] == [False] * 5


def test_whole_numbers(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (255,), (256,), (-3,)], "i long")
    assert [r[0] for r in one(spark, df, scalars.log2up(F.col("i")))] == [0, 1, 2, 8, 9, 0]
    i = F.col("i")
    assert one(spark, df, scalars.segment(i, 4), scalars.lane(i, 4), scalars.round_up(i, 4), scalars.round_down(i, 4)) == [
        (0, 0, 0, 0), (0, 1, 4, 0), (0, 2, 4, 0), (63, 3, 256, 252), (64, 0, 256, 256), (-1, 1, 0, -4)
    ]


def test_vertex_domain(spark):
    df = spark.createDataFrame([(None,), (-1,), (0,), (4294967294,), (4294967295,), (2**40,)], "i long")
    got = one(spark, df, vertex_ids.is_vertex("i"), vertex_ids.vertex_or_null("i"), vertex_ids.export_sentinel("i"))
    assert [g[0] for g in got] == [False, False, True, True, False, False]
    assert [g[1] for g in got] == [None, None, 0, 4294967294, None, None]
    assert got[0][2] == 4294967295
