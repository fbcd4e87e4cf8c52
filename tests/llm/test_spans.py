import random

import pytest
from pyspark.sql import functions as F

from vertexloom.llm import spans


def brute(docs, span):
    """All pairs with a common window, and per document the positions that another, or an earlier one, covers."""
    where = {}
    for i, text in docs:
        for p in range(len(text or "") - span + 1):
            where.setdefault(text[p : p + span], set()).add(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    shared, removable = {}, {}
    for i, text in docs:
        mine, earlier = set(), set()
        for p in range(len(text or "") - span + 1):
            ids = where[text[p : p + span]]
            if len(ids) > 1:
                mine.update(range(p, p + span))
            if min(ids) < i:
                earlier.update(range(p, p + span))
        shared[i], removable[i] = len(mine), len(earlier)
    return pairs, shared, removable


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, cls int, digest string")


def check(spark, docs, span, unit):
    found = spans.shared_runs(frame(spark, docs), span=span, unit=unit)
    pairs, shared, removable = brute(docs, span)
    assert {tuple(r) for r in spans.sharing_pairs(found).collect()} == pairs
    report = {r["doc_id"]: r for r in spans.sharing_report(frame(spark, docs), found).collect()}
    assert {i: r["shared_chars"] for i, r in report.items()} == shared
    assert {i: r["removable_chars"] for i, r in report.items()} == removable
    text = dict(docs)
    for r in spans.passages(found).collect():
        assert 0 <= r["start"] < r["end"] <= len(text[r["doc_id"]])


def noise(rng, n, letters="abcdefghij \n"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("span, unit", [(20, 10), (20, 20), (30, 17), (8, 1)])
def test_planted_runs(spark, span, unit):
    rng = random.Random(span + unit)
    docs = [(i, noise(rng, rng.randrange(0, 200))) for i in range(40)]
    for n in (span - 1, span, span + 1, span + 5, 3 * span) * 4:  # at any place, the borders included
        piece = noise(rng, n, "xyzäß€😀")
        for i in rng.sample(range(40), rng.choice([2, 2, 3, 6])):
            text = docs[i][1]
            at = rng.choice([0, len(text), rng.randrange(len(text) + 1)])
            docs[i] = (i, text[:at] + piece + text[at:])
    docs += [(100 + i, docs[3][1]) for i in range(4)] + [(200, ""), (201, "x" * (span - 1))]
    check(spark, docs, span, unit)


def test_periodic_texts(spark):
    docs = [(1, "a" * 500), (2, "q" + "a" * 300 + "r"), (3, "ab" * 200), (4, "zz" + "ba" * 30 + "y"), (5, "abc" * 40 + "q" + "ab" * 15), (6, "r" * 40 + "abc" * 9), (7, "-" * 19 + "a" * 19), (8, "a" * 20)]
    for unit in (5, 10, 19, 20):
        check(spark, docs, 20, unit)


def test_large_groups_are_narrowed_by_whole_spans(spark, monkeypatch):
    monkeypatch.setattr(spans, "GROUP", 3)
    rng = random.Random(4)
    passage, half = noise(rng, 45), noise(rng, 15)
    docs = [(i, noise(rng, 30) + (passage if i % 3 else half) + noise(rng, 30)) for i in range(25)]
    check(spark, docs, 20, 10)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 256)
    rng = random.Random(5)
    passage = noise(rng, 40)
    docs = [(i, noise(rng, 700 + i * 13) + passage + noise(rng, 500)) for i in range(6)] + [(9, noise(rng, 256)), (10, passage)]
    check(spark, docs, 20, 10)


def test_nulls_empty_and_repeats(spark):
    text = "the same text of more than twenty characters"
    df = frame(spark, [(None, text), (1, None), (2, text), (2, text), (3, text), (4, ""), (5, "short")])
    found = spans.shared_runs(df, span=20, unit=10)
    assert [tuple(r) for r in spans.sharing_pairs(found).collect()] == [(2, 3)]
    assert spans.sharing_report(df, found).count() == 6
    none = spans.shared_runs(df.limit(0), span=20, unit=10)
    assert spans.sharing_pairs(none).count() == spans.passages(none).count() == 0
    with pytest.raises(ValueError):
        spans.shared_runs(df, span=20, unit=21)


def test_very_long_text(spark):
    rng = random.Random(1)
    passage = noise(rng, 250)
    docs = [(1, noise(rng, 3_000_000) + passage), (2, passage + "tail"), (3, "b" * 2_500_000), (4, "b" * 210)]
    found = spans.shared_runs(frame(spark, docs))
    assert {tuple(r) for r in spans.sharing_pairs(found).collect()} == {(1, 2), (3, 4)}
    report = {r["doc_id"]: r["shared_chars"] for r in spans.sharing_report(frame(spark, docs), found).collect()}
    assert report[2] == 250 and report[1] == 250 and report[4] == 210


def test_every_group_as_a_large_one(spark, monkeypatch):
    """The same cases by the path of large groups: planted runs at all places, and periodic texts."""
    monkeypatch.setattr(spans, "GROUP", 1)
    rng = random.Random(12)
    docs = [(i, noise(rng, rng.randrange(0, 120))) for i in range(25)]
    for n in (19, 20, 21, 33, 70) * 3:
        piece = noise(rng, n, "xyzäß")
        for i in rng.sample(range(25), rng.choice([2, 3, 8])):
            text = docs[i][1]
            at = rng.choice([0, len(text), rng.randrange(len(text) + 1)])
            docs[i] = (i, text[:at] + piece + text[at:])
    check(spark, docs, 20, 10)
    docs = [(1, "a" * 100), (2, "q" + "a" * 60 + "r"), (3, "ab" * 50), (4, "zz" + "ba" * 30 + "y"), (5, "abc" * 20 + "q" + "ab" * 15), (6, "a" * 20)]
    check(spark, docs, 20, 10)
    check(spark, docs, 20, 20)


def _mixed_prefixes(rng, span):
    """Runs that reach over one end of a periodic stretch, which is longer in one text than in the other, behind several prefixes."""
    docs = []
    for tile in ("_", "-.", "abc"):
        for n in (span - 1, span, span + 3, 2 * span, 3 * span + 7):
            for before in ("", noise(rng, 3), noise(rng, span), noise(rng, 2 * span)):
                stretch = (tile * n)[:n]
                docs += [before + "\n" + stretch + noise(rng, rng.choice([0, 5, span]), "xyz"), before + noise(rng, 4) + stretch + "\n" + noise(rng, rng.choice([0, 5, span]), "xyz")]
    return [(i, d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("span, unit", [(20, 10), (21, 8), (20, 20), (9, 4)])
@pytest.mark.parametrize("group", [1024, 1])
def test_runs_over_the_end_of_a_longer_stretch(spark, monkeypatch, span, unit, group):
    monkeypatch.setattr(spans, "GROUP", group)
    check(spark, _mixed_prefixes(random.Random(span), span), span, unit)


def test_run_of_exactly_one_span_into_a_longer_stretch(spark):
    rng = random.Random(3)
    prefixes = ["", "q", noise(rng, 60), noise(rng, 150), noise(rng, 350)]
    docs = [(i, p + "\n" + "_" * 199 + "tail" + noise(rng, 120)) for i, p in enumerate(prefixes)] + [(10 + i, p[::-1] + "\n" + "_" * 400) for i, p in enumerate(prefixes)]
    check(spark, docs, 200, 100)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_hot_digests_are_spread_and_streamed(spark, monkeypatch, batch):
    """A passage in most texts, its rows marked in every block, and groups that span many batches."""
    monkeypatch.setattr(spans, "HOT", 5)
    monkeypatch.setattr(spans, "BLOCK", 1024)
    monkeypatch.setattr(spans, "GROUP", 4)
    rng = random.Random(6)
    passage, other = noise(rng, 33), noise(rng, 26)
    docs = [(i, noise(rng, rng.randrange(60)) + (passage if i % 3 else other) + noise(rng, rng.randrange(40))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(4)] + [(200, "_" * 150), (201, "q" + "_" * 90)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(spark, docs, 20, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_whose_hashes_clash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(spans, "_class", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    rng = random.Random(7)
    passage = noise(rng, 30)
    docs = [(i, noise(rng, 20) + (passage if i < 4 else "") + noise(rng, 20)) for i in range(12)] + [(50, noise(rng, 5))]
    docs += [(20, docs[0][1]), (21, docs[7][1])]
    check(spark, docs, 20, 10)
