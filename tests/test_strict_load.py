import pytest

from vertexloom.operators.strict_load import load_edges

OK = object()
COMMENT = object()
CASES = [
    ("1 2", OK), (' 1\t"2"\r', OK), ('"1 2" 3', "src_vert"), ('1"2" 3', "quoting"), ('"1"2 3', "quoting"), ('"1', "quoting"), ("", "column_count"), (None, "column_count"),
    ("# x", COMMENT), ("#", COMMENT), (" # x", "src_vert"), ('"# 1" 2', "src_vert"), ("1 2 3", "column_count"), ("4294967295 1", "src_vert"), ("4294967294 0004294967294", OK),
    ("1 4294967295", "dst_vert"), ("-1 2", "src_vert"), ("+1 2", "src_vert"), ("1.0 2", "src_vert"), ("1 2", "column_count"), ("1 ٣", "dst_vert"), ('"" 5', "src_vert"),
    ('"1" "2"', OK), ("1 2\n", "dst_vert"), ("1" * 100_000 + " 2", "src_vert"), ("0" * 100_000 + "7 2", OK), ("a " * 50_000, "column_count"), ('1""2 3', "quoting"), ('"1""2"', "quoting"),
    ('"a"b" c"', "quoting"), ('x "', "quoting"), ('1 2"', "quoting"), ("0 0", OK), ('"00" "0"', OK), ("99999999999 1", "src_vert"), (" \t\r", "column_count"), ("1\x0b2 3", "src_vert"),
    ('"' * 30_001, "quoting"), ("1, 2", "src_vert"), ('" 1" 2', "src_vert"), ('" "', "column_count"), ('"a "b" c"', "quoting"), ("1 2 # c", "column_count"), ("1;2", "column_count"),
]


def frame(spark, lines, numbers=None):
    numbers = numbers or list(range(len(lines)))
    return spark.createDataFrame([(0, n, line, "x", 1, 2) for n, line in zip(numbers, lines)], "file_id int, line_no long, raw_line string, reason string, src_vert int, _key int")


def split(loaded):
    edges = {r["line_no"]: (r["src_vert"], r["dst_vert"]) for r in loaded.edges.collect()}
    return edges, {r["line_no"]: r["reason"] for r in loaded.rejected.collect()}


@pytest.fixture(scope="module")
def parts(spark):
    return split(load_edges(frame(spark, [line for line, _ in CASES])))


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(parts, n):
    edges, rejected = parts
    want = CASES[n][1]
    if want is OK:
        assert n in edges and n not in rejected
    elif want is COMMENT:
        assert n not in edges and n not in rejected
    else:
        assert rejected.get(n) == want and n not in edges


def test_values(parts):
    edges, _ = parts
    assert edges[0] == (1, 2) and edges[1] == (1, 2) and edges[14] == (4294967294, 4294967294)


def test_repeated_and_missing_offsets(spark):
    edges, rejected = split(load_edges(frame(spark, ["1 2", "x 2", "1 2"], [None, None, 5])))
    assert edges == {None: (1, 2), 5: (1, 2)} and rejected == {None: "src_vert"}


def test_empty_table(spark):
    assert split(load_edges(frame(spark, ["1 2"]).limit(0))) == ({}, {})
