"""Rows that fail to parse: strict load, anti-join on the record offsets, diagnosis of the rest.

The strict load is one regular expression of plain character classes (no nested repetition, so a line of any length is safe)
and a range check; what conforms becomes an edge. The offsets that are left are found by an anti-join of the raw offsets with
the loaded ones; only lines that fail reach the diagnosis, and only their text is shuffled.

Blanks are space, tab and carriage return. A field is a run without blanks and quotes, or anything without quotes between two
quotes. Lines that start with ``#`` are comments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.vertex_ids import MAX_VERTEX

BLANK = r"[ \t\r]"
ID = r"[0-9]+"
STRICT = rf'\A{BLANK}*(?:{ID}|"{ID}"){BLANK}+(?:{ID}|"{ID}"){BLANK}*\z'
#: A well-formed quoted field: opened after a blank or the start, closed before a blank or the end.
QUOTED = r'(?<![^ \t\r])"[^"]*"(?![^ \t\r])'
FIELD = r'"[^"]*"|[^" \t\r]+'
OFFSET = ["file_id", "line_no"]


@dataclass(frozen=True)
class Loaded:
    """``edges``: offsets and ``src_vert``, ``dst_vert``. ``rejected``: offsets and ``reason``."""

    edges: DataFrame
    rejected: DataFrame


def _in_range(digits: Column) -> Column:
    """The LONG that digits stand for, leading zeros allowed; NULL if it is beyond the vertex ids."""
    short = F.ltrim(digits, F.lit("0"))
    value = F.when(short == "", F.lit(0).cast("long")).when(F.length(short) <= 10, short.try_cast("long"))
    return F.when(value <= MAX_VERTEX, value)


def vertex_value(text: Column) -> Column:
    """The LONG that a string of digits 0-9 stands for, leading zeros allowed; NULL if it is no vertex id."""
    return F.when(text.rlike(r"\A[0-9]+\z"), _in_range(text))


def reason(line: Column) -> Column:
    """Why a line is no edge: ``quoting``, ``column_count``, ``src_vert`` or ``dst_vert``, the first that applies; NULL if none does."""
    masked = F.regexp_replace(line, QUOTED, "q")
    fields = F.regexp_extract_all(line, F.lit(FIELD), F.lit(0))
    bare = lambda f: F.when(f.startswith('"'), f.substr(F.lit(2), F.length(f) - 2)).otherwise(f)
    return (
        F.when(line.isNull(), "column_count").when(masked.contains('"'), "quoting").when(F.size(fields) != 2, "column_count")
        .when(vertex_value(bare(fields[0])).isNull(), "src_vert").when(vertex_value(bare(fields[1])).isNull(), "dst_vert")
    )


def load_edges(raw: DataFrame, line_col: str = "raw_line", offset: list[str] | None = None) -> Loaded:
    """Split raw lines into edges and rejected lines; comments are neither.

    ``offset`` names the columns that number the records. They should be unique; where they repeat or are NULL, the line's
    hash tells the records apart, and equal lines under one offset get equal results. NULL and blank lines are rejected with
    ``column_count``. An empty table gives two empty results; columns beyond offset and line are ignored, whatever their names.
    """
    offset = offset or OFFSET
    lines = raw.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(offset)], F.col(line_col).alias("_line"))
    lines = lines.where(~F.coalesce(F.startswith("_line", F.lit("#")), F.lit(False))).withColumn("_key", F.xxhash64("_line"))
    at = [f"_o{i}" for i in range(len(offset))]
    # A conforming line is two runs of digits once quotes are blanks: the first field and the last, found without another pattern.
    plain = F.trim(F.translate("_line", '"\t\r', "   "))
    src, dst = _in_range(F.substring_index(plain, " ", 1)), _in_range(F.substring_index(plain, " ", -1))
    fits = F.col("_line").rlike(STRICT) & src.isNotNull() & dst.isNotNull()
    loaded = lines.where(fits).select(*at, "_key", src.alias("src_vert"), dst.alias("dst_vert"))
    took = loaded.select(*[F.col(c).alias(f"{c}_") for c in [*at, "_key"]])
    same = F.col("_key") == F.col("_key_")
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    names = [F.col(a).alias(c) for a, c in zip(at, offset)]
    # The raw side of the anti-join carries the text of lines that don't conform; the others' is not needed.
    raw_offsets = lines.select(*at, "_key", F.when(~F.coalesce(fits, F.lit(False)), F.col("_line")).alias("_line"))
    rest = raw_offsets.join(took, same, "left_anti").select(*names, reason(F.col("_line")).alias("reason"))
    return Loaded(loaded.select(*names, "src_vert", "dst_vert"), rest)
