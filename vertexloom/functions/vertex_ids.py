"""The id domain of vertices: 0 .. 4294967294; 4294967295 and NULL both mean "no vertex"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data format.
NO_VERTEX = 4294967295
MAX_VERTEX = 4294967294


def is_vertex(c: Column | str) -> Column:
    """True where the value is a vertex id; false (never NULL) for NULL, the sentinel and anything outside the domain."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.between(0, MAX_VERTEX), F.lit(False))


def vertex_or_null(c: Column | str) -> Column:
    """The id as LONG, NULL where it is no vertex id."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_vertex(c), c.cast("long"))


def export_sentinel(c: Column | str) -> Column:
    """NULL written as 4294967295, for exports in the binary formats' convention."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("long"), F.lit(NO_VERTEX).cast("long"))
