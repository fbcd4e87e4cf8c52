"""Running array kernels over whole partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

_SLICE = 1 << 16


def gather(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """All rows of a partition as arrays; an empty dict if it has none. The columns hold no NULL."""
    parts: dict[str, list[np.ndarray]] = {}
    for b in batches:
        for name, col in zip(b.schema.names, b.columns):
            parts.setdefault(name, []).append(col.to_numpy(zero_copy_only=False))
    return {k: np.concatenate(v) for k, v in parts.items()}


def slices(cols: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    """The columns as record batches of bounded length."""
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()}
    n = len(next(iter(arrays.values())))
    for at in range(0, n, _SLICE):
        yield pa.RecordBatch.from_arrays([a.slice(at, _SLICE) for a in arrays.values()], names=list(arrays))


def whole_partition(kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]):
    """A mapInArrow function that hands each partition's rows to ``kernel`` at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = gather(batches)
        if cols and len(next(iter(cols.values()))):
            yield from slices(kernel(cols))

    return run
