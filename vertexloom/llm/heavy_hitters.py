"""The most frequent values of a column, in memory that doesn't depend on how many distinct values there are.

Batches of the input are counted before they are shuffled, so a value with a third of all rows sends one row for each batch.
The counts are hash-partitioned by value; each partition keeps a count-min sketch with conservative update and a bounded set
of its heaviest candidates. The partitions' values are disjoint, so their candidates are merged by union.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import Workspace
from vertexloom.plans.sizing import shuffle_parts

DEPTH, WIDTH, CANDIDATES = 4, 1 << 16, 4096
#: More candidates than this are joined without a broadcast.
MOST_BROADCAST = 100_000
# Fixed odd multipliers of the sketch's rows.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their summed counts."""
    if counts is None:
        return np.unique(values, return_counts=True)
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


class Sketch:
    """A count-min sketch with conservative update and a bounded set of heavy candidates."""

    def __init__(self, width: int = WIDTH, candidates: int = CANDIDATES):
        self.shift = np.uint64(64 - (width - 1).bit_length())
        self.cells = np.zeros((len(MULTIPLIERS), 1 << (width - 1).bit_length()), np.int64)
        self.most = candidates
        self.values, self.estimates = np.empty(0, np.int64), np.empty(0, np.int64)
        self.rows = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        """``values`` are distinct. Each cell rises to the estimate plus the count and no further, so no estimate is too low."""
        with np.errstate(over="ignore"):
            mixed = values.astype(np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * MULTIPLIERS[0]
            mixed ^= mixed >> np.uint64(29)
            at = [((mixed * m) >> self.shift).astype(np.int64) for m in MULTIPLIERS]
        fresh = np.minimum.reduce([row[i] for row, i in zip(self.cells, at)]) + counts
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, fresh)
        self.rows += int(counts.sum())
        # A candidate that occurs in this batch gets its new estimate; the heaviest remain.
        old = ~np.isin(self.values, values)
        v, e = np.concatenate([self.values[old], values]), np.concatenate([self.estimates[old], fresh])
        if len(v) > self.most:
            keep = np.argpartition(-e, self.most - 1)[: self.most]
            v, e = v[keep], e[keep]
        self.values, self.estimates = v, e


def _precount(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False))
        rows += len(held[-1])
        if rows >= 1 << 18:
            yield _batch(*_counted(np.concatenate(held)))
            held, rows = [], 0
    if rows:
        yield _batch(*_counted(np.concatenate(held)))


def _batch(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["value", "n"])


def _sketched(width: int, candidates: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width, candidates)
        for b in batches:
            sketch.add(*_counted(b.column(0).to_numpy(), b.column(1).to_numpy()))
        if len(sketch.values):
            out = [sketch.values, sketch.estimates, np.full(len(sketch.values), sketch.rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["value", "approx_count", "part_rows"])

    return run


def candidates(values: DataFrame, column: str, parts: int | None = None, width: int = WIDTH, keep: int = CANDIDATES) -> DataFrame:
    """``(value, approx_count, part_rows)``: at most ``keep`` heavy candidates of each of ``parts`` hash partitions.

    The column holds whole numbers; NULLs are not counted. ``approx_count`` is never below the true count, and above it by more
    than ``2.72 * part_rows / width`` with a probability of at most exp(-4); ``part_rows`` is the number of rows whose value
    falls into the same partition. A task holds ``4 * width`` cells, ``keep`` candidates and one batch. An empty column gives no row.
    """
    only = values.select(F.col(column).cast("long").alias("value")).where("value IS NOT NULL")
    parts = parts or shuffle_parts(values.sparkSession)
    counted = only.mapInArrow(_precount, "value long, n long")
    return counted.repartition(parts, "value").mapInArrow(_sketched(width, keep), "value long, approx_count long, part_rows long")


def most_frequent(values: DataFrame, column: str, k: int, **sizes: int) -> DataFrame:
    """``(value, approx_count)`` of the ``k`` values with the greatest approximate counts; of equal ones the smaller values."""
    if k > sizes.get("keep", CANDIDATES):
        raise ValueError("k exceeds the candidates kept in a partition")
    return candidates(values, column, **sizes).select("value", "approx_count").orderBy(F.desc("approx_count"), "value").limit(k)


def holders(values: DataFrame, column: str, one_in: int, **sizes: int) -> DataFrame:
    """``(value, n)`` of the values that hold at least one in ``one_in`` of the column's non-NULL rows, with exact counts.

    At most ``one_in`` values hold that share and no estimate is too low, so a holder could leave a partition's candidates only
    if ``keep`` others were estimated higher: ``keep`` must be at least twice and ``width`` 16 times ``one_in``, where the
    sketch's error is far below a holder's count. The candidates that pass by their estimate are then counted exactly in a second
    scan; they are broadcast to it if they turn out to be no more than ``MOST_BROADCAST``, as they are unless the sketches are far too narrow.
    """
    keep = sizes.get("keep", CANDIDATES)
    if keep < 2 * one_in or sizes.get("width", WIDTH) < 16 * one_in:
        raise ValueError("keep or width is too small for one_in")
    found = candidates(values, column, **sizes)
    only = values.select(F.col(column).cast("long").alias("value")).where("value IS NOT NULL")
    total = only.agg(F.count(F.lit(1)).alias("_all"))
    likely, seen = Workspace(values.sparkSession, "holders").cut_measured(
        found.join(F.broadcast(total), F.col("approx_count") * one_in >= F.col("_all")).select("value", "_all"), n=F.count(F.lit(1))
    )
    exact = only.join(F.broadcast(likely) if seen["n"] <= MOST_BROADCAST else likely, "value").groupBy("value", "_all").agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") * one_in >= F.col("_all")).select("value", "n")
