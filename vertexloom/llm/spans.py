"""Long exact spans shared between records, with their offsets.

Units are hashed, their digests grouped globally, and occurrences keep their offsets. Lines and paragraphs as units can't find
every run of 200 characters (a run may lie inside two longer paragraphs, or cross line breaks that differ elsewhere), so the
units are chosen by content: of every ``span - unit + 1`` consecutive windows of ``unit`` characters, the one with the smallest
hash. Each run of ``span`` characters holds at least one, and the same one in every text. Digests that more than one text
holds are then extended to both sides and compared character by character, so the result is exact.

Identical texts are one class throughout: they are compared once and expanded by their membership.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.arrow import gather, slices
from vertexloom.plans.lineage import Workspace
from vertexloom.plans.sizing import parts, shuffle_parts

SPAN, UNIT = 200, 100
#: Characters hashed at once; a position in them has to fit the low bits of a hash.
BLOCK, LOW_BITS = 1 << 21, 24
#: Texts a task remembers to leave out copies before anything is shuffled.
REMEMBERED = 1 << 20
#: Up to so many occurrences of a digest are compared pair by pair; more are first narrowed by the whole spans around them.
GROUP = 1024
#: Inner occurrences of periodic stretches are compared with the others in blocks of this many.
MIDDLES = 8192
#: A digest of so many edges in one block of texts is one of a large group: its rows in that block are spread over SALTS tasks.
HOT, SALTS = 64, 1024
#: Occurrences of digests, and excerpts, in a partition.
ROWS_PER_PART, EXCERPTS_PER_PART = 1_000_000, 100_000
#: So few classes whose hashes clash are told apart by a broadcast.
FEW_CLASHES = 100_000
# Fixed odd constants of the hash.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
        out[0], have = 1, 1
        with np.errstate(over="ignore"):
            while have < n:
                more = min(have, n - have)
                out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
    return up, down


def _window_hashes(chars: np.ndarray, unit: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        a ^= a >> np.uint64(31)
        a *= powers[0][: len(a)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a, dtype=np.uint64)])
        h = (sums[unit:] - sums[:-unit]) * powers[1][: len(a) - unit + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _recurs(h: np.ndarray, most: int) -> int:
    """The smallest distance up to ``most`` at which the first hash comes again; 0: none."""
    again = np.flatnonzero(h[1 : most + 1] == h[0])
    return int(again[0]) + 1 if len(again) else 0


def _repeats(h: np.ndarray, period: int) -> int:
    """How often in a row the first hash comes again at this distance."""
    h, done, more = h[::period], 1, 64
    while done < len(h):
        other = np.flatnonzero(h[done : done + more] != h[0])
        if len(other):
            return done + int(other[0]) - 1
        done, more = done + more, 2 * more
    return len(h) - 1


def _thinned(h: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows to keep in place of the selected ones ``at``, and whether each is an edge. ``first`` and ``last`` bound the windows of each one's text.

    A window that recurs at a distance of at most half a unit lies in periodic text. All its occurrences in that stretch count,
    selected or not, since which are selected depends on what precedes: the first two and last two are edges, and between them one in
    each half unit is kept. Elsewhere every window is an edge. Two windows that are no edges needn't be compared: a common run that
    leaves the stretch does so at the same end in both texts, where the edges are alike; one inside the stretch in both may be moved
    by periods until it meets an edge of one text, and the kept windows of the other are close enough that such runs cover it.
    """
    half = unit // 2
    periodic = np.zeros(len(at), bool)
    for d in range(1, half + 1):
        for there in (at - d, at + d):
            ok = (there >= first) & (there <= last)
            periodic[ok] |= h[there[ok]] == h[at[ok]]
    if not periodic.any():
        return at, np.ones(len(at), np.int8)
    rows = np.flatnonzero(periodic)
    rows = rows[np.lexsort((at[rows], h[at[rows]]))]
    a = at[rows]
    near = (h[a[1:]] == h[a[:-1]]) & (first[rows[1:]] == first[rows[:-1]]) & (a[1:] - a[:-1] <= half)
    places, edges, done = [at[~periodic]], [np.ones(np.count_nonzero(~periodic), np.int8)], set()
    for row in rows[np.concatenate([[True], ~near])]:
        x, lo, hi = int(at[row]), int(first[row]), int(last[row])
        ahead, behind = h[x : hi + 1], h[lo : x + 1][::-1]
        period = _recurs(ahead, half) or _recurs(behind, half)
        start = x - period * _repeats(behind, period)
        if start in done:
            continue
        done.add(start)
        most = _repeats(h[start : hi + 1], period)
        ends = np.unique(np.clip([0, 1, most - 1, most], 0, most))
        nth = np.unique(np.concatenate([ends, np.arange(0, most + 1, max(1, half // period))]))
        places.append(start + period * nth)
        edges.append(np.isin(nth, ends).astype(np.int8))
    return np.concatenate(places), np.concatenate(edges)


def fingerprints(texts: list[np.ndarray], span: int, unit: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, offset and digest of each kept window, and whether it is an edge. The texts, as code points, fill one block together."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    chars = np.concatenate(texts)
    width = span - unit + 1
    none = np.empty(0, np.int64)
    if len(chars) < span:
        return none, none, none, none.astype(np.int8)
    h = _window_hashes(chars, unit, powers)
    mask = np.uint64((1 << LOW_BITS) - 1)
    ranked = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))  # the rightmost of equal ones is the smallest
    low = _sliding_min(ranked, width)
    inside = np.zeros(len(low) + 1, np.int64)  # windows of windows that lie within one text
    long = lengths >= span
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, (ends - span + 1)[long], -1)
    at = (mask - (low[np.cumsum(inside[:-1]) > 0] & mask)).astype(np.int64)
    at = np.unique(at)
    doc = np.searchsorted(ends, at, side="right")
    at, edge = _thinned(h, at, starts[doc], ends[doc] - unit, unit)
    doc = np.searchsorted(ends, at, side="right")
    return doc, at - starts[doc], h[at].view(np.int64), edge


def _split_hot(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mark the rows of digests that HOT edges of several texts in this block have (``hot`` 2), and add a row for each such digest
    (``hot`` 1) that tells the task which gets its other rows."""
    order = np.argsort(rows["digest"], kind="stable")
    start, size = _runs(rows["digest"][order])
    edges = np.add.reduceat((rows["edge"][order] == 1).astype(np.int64), start)
    low, high = np.minimum.reduceat(rows["cls"][order], start), np.maximum.reduceat(rows["cls"][order], start)
    hot = (edges >= HOT) & (low != high)
    if not hot.any():
        return rows
    mark = np.zeros(len(order), np.int8)
    mark[order] = np.repeat(hot, size) * np.int8(2)
    first = order[start[hot]]
    return {k: np.concatenate([v if k != "hot" else mark, v[first] if k != "hot" else np.ones(len(first), np.int8)]) for k, v in rows.items()}


def _fingerprinter(span: int, unit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(BLOCK)
        seen: set[int] = set()
        texts: list[np.ndarray] = []
        keys: list[tuple[int, int]] = []
        size = 0

        def emit():
            doc, pos, digest, edge = fingerprints(texts, span, unit, powers)
            key, base = np.array([k for k, _ in keys], np.int64), np.array([b for _, b in keys], np.int64)
            rows = {"digest": digest, "cls": key[doc], "pos": (pos + base[doc]).astype(np.int32), "edge": edge, "hot": np.zeros(len(digest), np.int8)}
            return slices(_split_hot(rows) if len(digest) else rows)

        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if cls in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(cls)
                chars = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                step = BLOCK - span + 1
                for base in range(0, max(1, len(chars) - span + 1), step):  # pieces overlap by span - 1
                    piece = chars[base : base + BLOCK]
                    if size + len(piece) > BLOCK:
                        yield from emit()
                        texts, keys, size = [], [], 0
                    texts.append(piece)
                    keys.append((cls, base))
                    size += len(piece)
        if texts:
            yield from emit()

    return run


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return start, np.diff(np.append(start, len(sorted_keys)))


def _judged(c: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
    """Of whole groups of a digest, sorted, the occurrences of those that more than one class has; ``cells``: see ``shared_runs``."""
    digest, cls, pos, edge, hot = (c[n] for n in ("digest", "cls", "pos", "edge", "hot"))
    row = hot != 1
    start, size = _runs(digest)
    known = np.maximum.reduceat(hot, start) > 0  # in several classes, and large
    low, high = np.minimum.reduceat(cls, start), np.maximum.reduceat(cls, start)
    edges = np.add.reduceat(((edge == 1) & row).astype(np.int64), start)
    inner = np.add.reduceat(((edge != 1) & row).astype(np.int64), start)
    cells = np.where(known | (edges > GROUP), -1, -(-inner // MIDDLES))
    keep = np.repeat(known | (low != high), size) & row
    if not keep.any():
        return None
    rows = {"digest": digest, "cls": cls, "pos": pos, "edge": edge, "cells": np.repeat(cells, size).astype(np.int32)}
    return {k: v[keep] for k, v in rows.items()}


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition sorted by digest, class, position and edges first, group by group. A group is held until it is known to be a large
    one of several classes, and then passed on as it comes: what a task holds is bounded by GROUP texts."""
    names = ("digest", "cls", "pos", "edge", "hot")
    held: dict[str, np.ndarray] | None = None
    large: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {n: batch.column(n).to_numpy() for n in names}
        if held is not None:
            c = {n: np.concatenate([held[n], c[n]]) for n in names}
        same = (c["digest"][1:] == c["digest"][:-1]) & (c["cls"][1:] == c["cls"][:-1]) & (c["pos"][1:] == c["pos"][:-1]) & ((c["hot"][1:] == 1) == (c["hot"][:-1] == 1))
        c = {n: v[np.concatenate([[True], ~same])] for n, v in c.items()}  # copies from other tasks, and where pieces overlap: an edge in one is one
        if large is not None:
            on = c["digest"] == large
            if on.any():
                yield from slices({n: c[n][on & (c["hot"] != 1)] for n in names[:4]} | {"cells": np.full(int((on & (c["hot"] != 1)).sum()), -1, np.int32)})
            c = {n: v[~on] for n, v in c.items()}
            if not len(c["digest"]):
                held = None
                continue
            large = None
        cut = int(np.searchsorted(c["digest"], c["digest"][-1], side="left"))
        if cut and (rows := _judged({n: v[:cut] for n, v in c.items()})):
            yield from slices(rows)
        held = {n: v[cut:] for n, v in c.items()}
        rows = _judged(held)
        if rows and rows["cells"][0] < 0:
            yield from slices(rows)
            large, held = int(held["digest"][0]), None
    if held is not None and (rows := _judged(held)):
        yield from slices(rows)


def _excerpts(span: int, unit: int):
    side = span - unit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("digest", "cls", "pos", "edge", "cells", "lead", "excerpt")}
            for cls, text, places in zip(batch.column("cls").to_pylist(), batch.column("text"), batch.column("places").to_pylist()):
                text = text.as_py()
                for place in places:
                    pos = place["pos"]
                    at = max(0, pos - side)
                    for name, value in (*place.items(), ("cls", cls), ("lead", pos - at), ("excerpt", text[at : pos + span])):
                        out[name].append(value)
            if out["cls"]:
                kinds = {"digest": pa.int64(), "cls": pa.int64(), "pos": pa.int32(), "edge": pa.int8(), "cells": pa.int32(), "lead": pa.int32(), "excerpt": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return run


def _prefix(equal: np.ndarray) -> np.ndarray:
    """Length of the run of True from the left, per row."""
    if not equal.shape[1]:
        return np.zeros(len(equal), np.int64)
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))


def _compare(span: int, unit: int, most: int = 1 << 14):
    side = span - unit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        cols = {n: table.column(n).to_numpy() for n in ("digest", "cell", "cls", "pos", "edge", "lead")}
        order = np.lexsort((cols["cls"], -cols["edge"], cols["cell"], cols["digest"]))
        cols = {n: v[order] for n, v in cols.items()}
        excerpt = table.column("excerpt").combine_chunks().take(pa.array(order))
        changed = np.concatenate([[True], np.any([cols[n][1:] != cols[n][:-1] for n in ("digest", "cell")], axis=0)])
        start, size = _runs(np.cumsum(changed))

        def checked(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            ok = cols["cls"][i] != cols["cls"][j]
            i, j = i[ok], j[ok]
            for at in range(0, len(i), most):
                x, y = i[at : at + most], j[at : at + most]
                rows, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                chars = np.zeros((len(rows), side + span), np.uint32)
                tail = np.zeros(len(rows), np.int64)
                for r, row in enumerate(rows):
                    text = np.frombuffer(excerpt[int(row)].as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                    lead = cols["lead"][row]
                    chars[r, side - lead : side - lead + len(text)] = text
                    tail[r] = len(text) - lead - unit
                p, q = back[: len(x)], back[len(x) :]
                equal = chars[p] == chars[q]
                left = np.minimum.reduce([_prefix(equal[:, :side][:, ::-1]), cols["lead"][x], cols["lead"][y]])
                right = np.minimum.reduce([_prefix(equal[:, side + unit :]), tail[p], tail[q]])
                good = equal[:, side : side + unit].all(axis=1) & (left + unit + right >= span)
                x, y, left, right = x[good], y[good], left[good], right[good]
                if len(x):
                    yield from slices({
                        "cls_a": cols["cls"][x], "start_a": (cols["pos"][x] - left).astype(np.int32), "cls_b": cols["cls"][y],
                        "start_b": (cols["pos"][y] - left).astype(np.int32), "length": (left + unit + right).astype(np.int32),
                    })

        mixed = cols["cell"][start] > 0
        for at, n in zip(start[mixed], size[mixed]):
            edges = int(np.count_nonzero(cols["edge"][at : at + n]))
            middles = np.arange(at + edges, at + n)
            for i in range(at, at + edges):
                yield from checked(np.full(len(middles), i), middles)
        for n in np.unique(size[~mixed]):
            if n < 2:
                continue
            first, second = np.triu_indices(int(n), 1)
            groups = start[~mixed & (size == n)]
            step = max(1, (4 * most) // len(first))
            for at in range(0, len(groups), step):
                g = groups[at : at + step, None]
                yield from checked((g + first).ravel(), (g + second).ravel())

    return run


def _windows(span: int, unit: int):
    """For each occurrence of a large group, the hashes of all spans around it, with the characters at their sides.

    ``before`` and ``after`` are -1 where the excerpt or the text ends: no span further out is to be compared there.
    """
    side = span - unit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(side + span)
        for batch in batches:
            out: dict[str, list[np.ndarray]] = {k: [] for k in ("digest", "cls", "pos", "edge", "left", "hash", "before", "after")}
            for digest, cls, pos, edge, lead, text in zip(*(batch.column(n).to_pylist() for n in ("digest", "cls", "pos", "edge", "lead", "excerpt"))):
                chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                n = min(lead, len(chars) - span) + 1  # spans that start at 0 .. lead of the excerpt
                if n < 1:
                    continue
                wide = np.concatenate([[-1], chars.astype(np.int64), [-1]])
                rows = {"digest": digest, "cls": cls, "pos": pos, "edge": edge}
                for k, v in rows.items():
                    out[k].append(np.full(n, v))
                out["left"].append(lead - np.arange(n))
                out["hash"].append(_window_hashes(chars, span, powers)[:n].view(np.int64))
                out["before"].append(wide[:n])
                after = wide[span + 1 : span + 1 + n].copy()
                after[lead - np.arange(n) == 0] = -1
                out["after"].append(after)
            if out["cls"]:
                yield from slices({k: np.concatenate(v).astype(np.int64) for k, v in out.items()})

    return run


def _different(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose keys differ or are -1."""
    order = np.argsort(key, kind="stable")
    start, size = _runs(key[order])
    for at, n in zip(start, size):
        mine, later = order[at : at + n], order[at + n :]
        if key[mine[0]] == -1:
            for i in range(n):
                yield np.full(len(key) - i - 1, mine[i]), order[i + 1 :]
        elif len(later):
            for i in mine:
                yield np.full(len(later), i), later


def _outermost(span: int):
    """Pairs of occurrences at the leftmost and rightmost span that they have in common: no other pair is ever formed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = gather(batches)
        if not c or not len(c["digest"]):
            return
        keys = ("digest", "left", "hash")
        order = np.lexsort((c["cls"], *(c[k] for k in reversed(keys))))
        c = {k: v[order] for k, v in c.items()}
        start, size = _runs(np.cumsum(np.concatenate([[True], np.any([c[k][1:] != c[k][:-1] for k in keys], axis=0)])))
        for at, n in zip(start, size):
            if c["cls"][at] == c["cls"][at + n - 1]:
                continue
            for name in ("before", "after"):
                for i, j in _different(c[name][at : at + n]):
                    i, j = i + at, j + at
                    ok = (c["cls"][i] != c["cls"][j]) & ((c["edge"][i] | c["edge"][j]) > 0)
                    i, j = i[ok], j[ok]
                    if len(i):
                        starts = [(c["pos"][x] - c["left"][x]).astype(np.int32) for x in (i, j)]
                        yield from slices({"cls_a": c["cls"][i], "start_a": starts[0], "cls_b": c["cls"][j], "start_b": starts[1], "length": np.full(len(i), span, np.int32)})

    return run


def _class(text: str) -> Column:
    return F.xxhash64(text)


def _second(text: str) -> Column:
    """Another hash of the same text, independent of its class."""
    return F.xxhash64(F.lit(1), text)


@dataclass(frozen=True)
class Shared:
    """``members (doc_id, cls, n_chars)`` of all texts of at least ``span`` characters; ``matches (cls_a, start_a, cls_b, start_b,
    length)``: pieces of common runs, each of at least ``span`` characters, that cover all such runs between different texts."""

    members: DataFrame
    matches: DataFrame


def shared_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, unit: int = UNIT) -> Shared:
    """Find all runs of at least ``span`` code points that two different texts have in common, verbatim.

    Rows with a NULL id or text, and texts shorter than ``span``, share nothing. Rows that repeat an id with the same text count
    once; with another text, the id stands for both texts. A text's class is its 64-bit hash, unless that is another text's too by a
    second one: then it is the second. Other columns are ignored.
    """
    if not 0 < unit <= span:
        raise ValueError("unit must lie between 1 and span")
    spark = docs.sparkSession
    ws = Workspace(spark, "spans")
    least = shuffle_parts(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    rows = rows.withColumn("cls", _class("text"))
    members, seen = ws.cut_measured(rows.select("doc_id", "cls", _second("text").alias("second"), F.length("text").alias("n_chars")).distinct(), chars=F.sum("n_chars"))
    clashes, clashing = ws.cut_measured(members.groupBy("cls").agg(F.min("second").alias("_lo"), F.max("second").alias("_hi")).where("_lo <> _hi").select(F.col("cls").alias("_clash")), n=F.count(F.lit(1)))
    if clashing["n"]:
        apart = F.broadcast(clashes) if clashing["n"] <= FEW_CLASHES else clashes
        other = lambda df, second: df.join(apart, F.col("cls") == F.col("_clash"), "left").withColumn("cls", F.when(F.col("_clash").isNotNull(), second).otherwise(F.col("cls"))).drop("_clash")
        rows, members = other(rows, _second("text")), ws.cut(other(members, F.col("second")))
    members = members.select("doc_id", "cls", "n_chars")
    # Two windows of a hundred are kept on average; the partitions follow the texts, however many the session's exchanges have.
    n_parts = max(least, parts(2 * (seen["chars"] or 0) // (span - unit + 1), ROWS_PER_PART))
    occurrences = rows.select("cls", "text").mapInArrow(_fingerprinter(span, unit), "digest long, cls long, pos int, edge byte, hot byte")
    grouped = occurrences.repartition(n_parts, "digest", F.when(F.col("hot") == 2, F.pmod("cls", F.lit(SALTS))).otherwise(F.lit(-1)))
    grouped = grouped.sortWithinPartitions("digest", "cls", "pos", F.desc("edge"))
    # cells: -1 for a large group; else the number of blocks of inner occurrences, which are cells 1 and up, and 0 that of the edges.
    shared, seen = ws.cut_measured(grouped.mapInArrow(_shared, "digest long, cls long, pos int, edge byte, cells int"), large=F.count(F.when(F.col("cells") < 0, 1)), n=F.count(F.lit(1)))
    n_parts = max(least, parts(seen["n"], EXCERPTS_PER_PART))
    places = shared.groupBy("cls").agg(F.collect_list(F.struct("digest", "pos", "edge", "cells")).alias("places"))
    reps = members.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    wanted = places.join(reps, "cls")
    texts = wanted.join(rows.select("doc_id", "cls", "text"), ["doc_id", "cls"]).select("cls", "text", "places")
    excerpts = texts.mapInArrow(_excerpts(span, unit), "digest long, cls long, pos int, edge byte, cells int, lead int, excerpt string")
    kinds = "cls_a long, start_a int, cls_b long, start_b int, length int"
    # An edge row meets the other edges in cell 0 and the inner rows in theirs; no two inner rows meet.
    cell = F.when(F.col("edge") == 1, F.sequence(F.lit(0), "cells")).otherwise(F.array((F.lit(1) + F.pmod(F.xxhash64("cls", "pos"), "cells")).cast("int")))
    cells = excerpts.where("cells >= 0").select("digest", F.explode(cell).alias("cell"), "cls", "pos", "edge", "lead", "excerpt")
    compared = cells.repartition(n_parts, "digest", "cell").mapInArrow(_compare(span, unit), kinds)
    if seen["large"]:
        windows = excerpts.where("cells < 0").mapInArrow(_windows(span, unit), "digest long, cls long, pos long, edge long, left long, hash long, before long, after long")
        compared = compared.unionByName(windows.repartition(n_parts, "digest", "left", "hash").mapInArrow(_outermost(span), kinds))
    matches = ws.cut(compared)
    ws.drop(shared)
    return Shared(members, matches)


def sharing_pairs(shared: Shared) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: each pair of documents whose texts have a run of ``span`` characters in common."""
    who = shared.members.select("doc_id", "cls")
    a, b = who.select(F.col("cls").alias("cls_a"), F.col("doc_id").alias("a")), who.select(F.col("cls").alias("cls_b"), F.col("doc_id").alias("b"))
    apart = shared.matches.select("cls_a", "cls_b").distinct().join(a, "cls_a").join(b, "cls_b").select("a", "b")
    copies = a.join(b, F.col("cls_a") == F.col("cls_b")).select("a", "b")
    pairs = apart.unionByName(copies).where("a <> b")
    return pairs.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def passages(shared: Shared) -> DataFrame:
    """``(doc_id, start, end, removable)``: the stretches of each text that stand in another row too, offsets in code points.

    Overlapping and touching runs are merged. Of all documents that hold a run, the one with the smallest id keeps it; rows with
    ``removable`` true are the stretches that an earlier document holds, those with false all shared stretches.
    """
    ranks = shared.members.groupBy("cls").agg(F.min("doc_id").alias("rank"), F.count(F.lit(1)).alias("copies"), F.first("n_chars").alias("n_chars"))
    m = shared.matches.join(ranks.select(F.col("cls").alias("cls_a"), F.col("rank").alias("ra")), "cls_a").join(ranks.select(F.col("cls").alias("cls_b"), F.col("rank").alias("rb")), "cls_b")
    side = lambda c, s, later: F.struct(F.col(c).alias("cls"), F.col(s).alias("start"), (F.col(s) + F.col("length")).alias("end"), later.alias("later"))
    runs = m.select(F.inline(F.array(side("cls_a", "start_a", F.col("ra") > F.col("rb")), side("cls_b", "start_b", F.col("rb") > F.col("ra"))))).distinct()
    of_docs = runs.join(shared.members.select("doc_id", "cls"), "cls").select("doc_id", "start", "end", "later")
    whole = shared.members.join(ranks.where("copies > 1").select("cls", "rank"), "cls").select("doc_id", F.lit(0).alias("start"), F.col("n_chars").alias("end"), (F.col("doc_id") > F.col("rank")).alias("later"))
    every = of_docs.unionByName(whole)
    every = every.select("doc_id", "start", "end", F.lit(False).alias("removable")).unionByName(every.where("later").select("doc_id", "start", "end", F.lit(True).alias("removable"))).distinct()
    before = Window.partitionBy("doc_id", "removable").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "removable").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = every.withColumn("_new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    return opens.withColumn("_n", F.sum("_new").over(upto)).groupBy("doc_id", "removable", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_n").select("doc_id", "start", "end", "removable")


def sharing_report(docs: DataFrame, shared: Shared, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row with an id: its length, how much of it is shared elsewhere, and how much an earlier one holds."""
    sums = passages(shared).groupBy(F.col("doc_id").alias("_id")).agg(
        F.sum(F.when(~F.col("removable"), 1)).alias("_spans"),
        F.sum(F.when(~F.col("removable"), F.col("end") - F.col("start"))).alias("_shared"),
        F.sum(F.when(F.col("removable"), F.col("end") - F.col("start"))).alias("_removable"),
    )
    sizes = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("chars")).where("doc_id IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return sizes.join(sums, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", F.col("chars").cast("long").alias("chars"), zero("_spans").alias("passages"), zero("_shared").alias("shared_chars"), zero("_removable").alias("removable_chars"),
        F.when(F.col("chars") > 0, zero("_shared") / F.col("chars")).otherwise(F.lit(0.0)).alias("shared_share"),
    )
