"""Filling containers of fixed capacity with items of varying length: bulk-synchronous best fit.

Each round range-sorts the open items and the gaps by size, and deals them by their rank within the range: every stripe gets its
share of the items and gaps of every size. All stripes then sweep at once, from the largest size down: items of one size take the
smallest gaps that hold them (their successors), as many to a gap as it holds, and the k-th item of the size goes to the gap
whose running total covers k, so no two items meet in one place. What finds no gap opens new containers. A container that stays
half empty gives its items back; each stripe has at most one. Gaps are updated, and the next round begins with fewer stripes,
until what was given back is less than one container in a thousand.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import gather, slices
from vertexloom.operators.prefix import prefix_sums
from vertexloom.plans.lineage import Workspace
from vertexloom.plans.sizing import parts

#: Rows that one stripe sweeps, and the fewest stripes of the first round for each capacity.
ROWS_PER_RANGE, LEAST_STRIPES = 100_000, 4
#: More kinds of containers are refused: their names and stripes are the driver's.
MOST_KINDS = 1000
#: Rounds end once fewer containers than this share were given back.
ENOUGH = 0.001


def sweep(sizes: np.ndarray, spaces: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit from the largest item down: the gap of each item, and the space left of each gap.

    Gaps after those given are new containers of ``capacity``. All items of one size are placed at once, so the steps follow the
    number of different sizes and spaces met, not that of the items.
    """
    order = np.argsort(-sizes, kind="stable")
    took, used_spaces = np.empty(len(sizes), np.int64), []
    gaps_of: dict[int, np.ndarray] = {}

    def put(space: int, gaps: np.ndarray) -> None:
        if space in gaps_of:
            gaps_of[space] = np.concatenate([gaps_of[space], gaps])
        else:
            gaps_of[space] = gaps
            insort(used_spaces, space)

    seq = np.argsort(spaces, kind="stable")
    for gaps in np.split(seq, np.flatnonzero(np.diff(spaces[seq])) + 1) if len(seq) else []:
        put(int(spaces[gaps[0]]), gaps)
    fresh = len(spaces)
    ranked = sizes[order]
    ends = np.append(np.flatnonzero(np.diff(ranked)) + 1, len(ranked)) if len(ranked) else []
    start = 0
    for end in ends:
        size = int(ranked[start])
        while start < end:
            todo = int(end) - start
            at = bisect_left(used_spaces, size)
            if at < len(used_spaces):
                space = used_spaces.pop(at)
                gaps = gaps_of.pop(space)
            else:
                space = capacity
                gaps = np.arange(fresh, fresh + -(-todo // max(1, space // size)) if size else fresh + 1)
                fresh += len(gaps)
            each = space // size if size else todo
            n_gaps = min(len(gaps), -(-todo // each))
            n = min(todo, n_gaps * each)
            took[order[start : start + n]] = np.repeat(gaps[:n_gaps], each)[:n]  # the k-th item of the size in place k
            start += n
            last = n - (n_gaps - 1) * each
            for rest, some in ((space, gaps[n_gaps:]), (space - each * size, gaps[: n_gaps - 1]), (space - last * size, gaps[n_gaps - 1 : n_gaps])):
                if len(some):
                    put(rest, some)
    left = np.empty(fresh, np.int64)
    for space, gaps in gaps_of.items():
        left[gaps] = space
    return took, left


SWEPT = "con long, is_gap long, id long, size long, bin long, back long"
#: Bits of a container's number: the round above, then the stripe, then the place in the stripe.
STRIPE_BITS, PLACE_BITS = 24, 28


def _sweeper(round_: int, capacity: dict[int, int], last: set[int]):
    """One stripe. Items get their container; a row for each container has the space left. ``back``: given back for the next round."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = gather(batches)
        if not c or not len(c["id"]):
            return
        con = int(c["con"][0])  # a stripe is of one capacity
        rows = np.lexsort((c["id"], c["is_gap"]))
        items, gaps = rows[c["is_gap"][rows] == 0], rows[c["is_gap"][rows] == 1]
        took, left = sweep(c["size"][items], c["size"][gaps], capacity[con])
        new = np.arange(len(left) - len(gaps)) + (((round_ << STRIPE_BITS) + int(c["stripe"][0])) << PLACE_BITS)
        bins = np.concatenate([c["id"][gaps], new])
        open_ = np.zeros(len(left), np.int64)
        if con not in last:
            open_[len(gaps) :] = left[len(gaps) :] * 2 >= capacity[con]
        yield from slices({
            "con": np.full(len(items) + len(left), con), "is_gap": np.repeat([0, 1], [len(items), len(left)]), "id": np.concatenate([c["id"][items], bins]),
            "size": np.concatenate([c["size"][items], left]), "bin": np.concatenate([bins[took], bins]), "back": np.concatenate([open_[took], open_]),
        })

    return run


def _by_container(rows: DataFrame, **measures: Column) -> dict[int, dict]:
    """Aggregates of each container kind: as many rows as there are capacities."""
    return {r["con"]: r.asDict() for r in rows.groupBy("con").agg(*(c.alias(k) for k, c in measures.items())).collect()}


def _dealt(both: DataFrame, stripes: dict[int, int]) -> DataFrame:
    """Range-sorted by size, the rows of each range go to the stripes of their capacity in turn, by their rank in the range."""
    first, plan = 0, []
    for con, n in sorted(stripes.items()):
        plan.append((con, first, n))
        first += n
    of = F.broadcast(both.sparkSession.createDataFrame(plan, "con long, first long, stripes long"))  # at most MOST_KINDS rows
    ranged = both.repartitionByRange(first, "con", "size", F.xxhash64("id")).sortWithinPartitions("con", "is_gap", "size", "id")
    ranked = ranged.select("*", (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.spark_partition_id()).alias("_rank"))
    dealt = ranked.join(of, "con").select("con", "is_gap", "id", "size", (F.col("first") + F.col("_rank") % F.col("stripes")).alias("stripe"))
    return dealt.repartitionById(first, F.col("stripe").cast("int"))


def pack(items: DataFrame, capacities: dict[int, int], rows_per_range: int = ROWS_PER_RANGE, least_stripes: int = LEAST_STRIPES) -> DataFrame:
    """``(con, id, size, bin)``: the container number each item is put into, for each capacity number ``con``.

    ``items (con, id, size)`` have unique ids in a capacity and ``0 <= size <= capacity``. Items of size 0 fit anywhere.
    """
    ws = Workspace(items.sparkSession, "packing")
    placed: list[DataFrame] = []
    todo, gaps, stripes, round_ = items, None, {}, 0
    state = _by_container(items, n=F.count(F.lit(1)), v=F.sum("size"))
    few = {con: ENOUGH * r["v"] / capacities[con] for con, r in state.items()}  # of at least so many containers in all
    while state:
        offered = {con: 0 for con in state} if gaps is None else {con: r["n"] for con, r in _by_container(gaps, n=F.count(F.lit(1))).items()}
        for con, r in state.items():
            n = parts(r["n"] + offered.get(con, 0), rows_per_range)
            stripes[con] = max(least_stripes, n) if gaps is None else max(1, min(n, stripes[con] // 4))
        now = {con: stripes[con] for con in state}
        last = {con for con, n in now.items() if n == 1 or n <= few[con]}
        both = todo.select("con", F.lit(0).cast("long").alias("is_gap"), "id", "size")
        if gaps is not None:
            both = both.unionByName(gaps.select("con", F.lit(1).cast("long").alias("is_gap"), "id", "size"))
        swept = ws.cut(_dealt(both, now).mapInArrow(_sweeper(round_, capacities, last), SWEPT))
        placed.append(swept.where("is_gap = 0 AND back = 0").select("con", "id", "size", "bin"))
        round_ += 1
        todo = swept.where("is_gap = 0 AND back = 1").select("con", "id", "size")
        state = _by_container(todo, n=F.count(F.lit(1)), least=F.min("size")) if len(last) < len(now) else {}
        if state:
            # Only gaps that hold some item that is left are kept open.
            least = F.broadcast(items.sparkSession.createDataFrame([(con, r["least"]) for con, r in state.items()], "con long, least long"))
            open_ = swept.where("is_gap = 1 AND back = 0").select("con", "id", "size")
            gaps = ws.cut(open_.join(least, "con").where("size >= least").select("con", "id", "size"))
    return reduce(DataFrame.unionByName, placed) if placed else items.select("con", "id", "size", F.lit(0).cast("long").alias("bin"))


def fill(sizes: DataFrame, containers: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``(container, bin, doc_id, piece, start_token, n_tokens)`` for ``sizes (doc_id, n_tokens)`` and ``containers (container,
    capacity_tokens)``: every document of every capacity, in bins whose tokens never exceed it.

    Only a document longer than the capacity is split: into full pieces, each a bin of its own, and a last piece that is packed
    like any other item. Documents with a NULL id are left out; NULL and 0 tokens give an empty item, which goes into some bin;
    a repeated id is an item for each of its rows. Containers with a NULL name or without a positive capacity are left out; of
    equal names the greatest capacity counts. Empty tables give an empty result.
    """
    spark = sizes.sparkSession
    ws = Workspace(spark, "containers")
    boxes = containers.where("container IS NOT NULL AND capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("long").alias("capacity")).orderBy("container").limit(MOST_KINDS + 1).collect()
    if len(boxes) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    kinds = "container string, bin long, doc_id long, piece long, start_token long, n_tokens long"
    if not boxes:
        return spark.createDataFrame([], kinds)
    names = spark.createDataFrame([(i, b["container"], b["capacity"]) for i, b in enumerate(boxes)], "con long, container string, capacity long")
    docs = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")).where("doc_id IS NOT NULL")
    docs = ws.cut(docs.withColumn("id", F.monotonically_increasing_id()))
    each = docs.join(F.broadcast(names)).withColumn("full", F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / F.col("capacity")).cast("long"))
    rest = F.col("n_tokens") - F.col("full") * F.col("capacity")
    items = ws.cut(each.select("con", "id", rest.alias("size")))
    packed = pack(items, {i: b["capacity"] for i, b in enumerate(boxes)}, rows_per_range)
    last = packed.join(each.select("con", "id", "container", "doc_id", "full", "capacity"), ["con", "id"]).select(
        "container", "bin", "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token"), F.col("size").alias("n_tokens")
    )
    # Full pieces need no packing. Their bins are numbered downwards from -1.
    split = prefix_sums(each.where("full > 0").withColumn("_order", F.xxhash64("id")), ["container"], "_order", "id", "full")
    whole = split.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece")).select(
        "container", (-1 - F.col("before") - F.col("piece")).alias("bin"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens")
    )
    cols = ["container", "bin", "doc_id", "piece", "start_token", "n_tokens"]
    return last.select(cols).unionByName(whole.select(cols))


def fill_report(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: bins, items, tokens, the fewest bins possible by volume, and the share of the space that is unused."""
    size = containers.groupBy("container").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    bins = filled.groupBy("container", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    sums = bins.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return sums.join(F.broadcast(size), "container").select(
        "container", "capacity", "bins", "items", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"),
        (1 - F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("unused_share"),
    )
