"""Lines that records share: normalise, group digests globally, keep the earliest occurrence, mark the rest with their offsets.

This finds what repeats line by line: headers, boilerplate, reprinted paragraphs. Runs that cross line breaks or lie inside longer
lines are left to ``spans``, which finds every shared run of a given length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import Workspace

LEAST_CHARS = 40
BLANKS = re.compile(r"[ \t\r\f]+")
#: A digest of more lines than this share is hot; there are at most so many hot ones as the share goes into one.
HOT_SHARE = 0.001


def normal(line: str) -> str:
    """Runs of blanks as one space, none at the ends."""
    return BLANKS.sub(" ", line).strip(" ")


def _splitter(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = 0
                for line in text.as_py().split("\n"):
                    if len(line) >= least and len(plain := normal(line)) >= least:
                        d = hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        out.append((doc, at, at + len(line), len(plain), *np.frombuffer(d, np.int64).tolist()))
                    at += len(line) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "end", "chars", "d1", "d2"])

    return run


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``(doc_id, start, end, first_doc, first_start)``: each line that an earlier place holds too, and the earliest such place.

    Lines end at line feeds; those of fewer than ``least`` code points, once normalised, are never repeated. Places are ranked by
    document and offset, so a line that a document repeats within itself counts as well. Offsets are those of the original text,
    in code points. Rows with a NULL id or text have no lines; of an id that repeats, all texts count. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "lines")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines, seen = ws.cut_measured(rows.mapInArrow(_splitter(least), "doc_id long, start long, end long, chars long, d1 long, d2 long"), n=F.count(F.lit(1)))
    # Combined before the shuffle: a line of every record sends a row for each task.
    first = lines.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = ws.cut(first.select("d1", "d2", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"), (F.col("n") > F.lit(max(1.0, HOT_SHARE * seen["n"]))).alias("hot")))
    hot = first.where("hot").drop("hot")  # at most 1 / HOT_SHARE rows
    met = lines.join(F.broadcast(hot), ["d1", "d2"]).unionByName(
        lines.join(F.broadcast(hot.select("d1", "d2")), ["d1", "d2"], "left_anti").join(first.where("NOT hot").drop("hot"), ["d1", "d2"])
    )
    return met.where("doc_id <> first_doc OR start <> first_start").select("doc_id", "start", "end", "first_doc", "first_start")
