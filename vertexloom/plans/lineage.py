"""Cutting lineage with tables written to the cluster's shared folder.

Iterative operators write each step as a Parquet table below ``spark.checkpoint.dir`` and read it back: the next step's plan
starts at a scan, a lost executor costs no recomputation of earlier steps, and nothing lives on one machine only. Where no folder
is named, a temporary one of this process takes its place in local mode; on any other master that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Settings of the session the steps are written in. A step's shuffle files go with it: what reads it later reads its table.
OWN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_own_dir: str | None = None
_open: dict[str, Workspace] = {}
_scope: ContextVar[list | None] = ContextVar("vertexloom_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set in the context; a temporary one only in local mode, where none is named."""
    global _own_dir
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir: iterative operators write their steps there")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="vertexloom-")
    return f"file://{_own_dir}"


@atexit.register
def _sweep() -> None:
    for ws in list(_open.values()):
        try:
            ws.close()
        except Exception:  # the JVM may be gone before us
            pass
    if _own_dir:
        shutil.rmtree(_own_dir, ignore_errors=True)


@contextmanager
def scope() -> Iterator[None]:
    """Delete, at the end of the block, the step tables of all operators that ran within it: results have to be used inside."""
    opened: list[Workspace] = []
    token = _scope.set(opened)
    try:
        yield
    finally:
        _scope.reset(token)
        for ws in opened:
            ws.close()


class Workspace:
    """A folder of step tables. ``cut`` adds one, ``drop`` removes one that no later plan reads.

    Results are lazy and read the last tables, so these stay until ``close``, the end of the enclosing ``scope``, or that of the
    driver's process. Steps are written in a session of the workspace's own, a copy of the caller's with other settings: those of the
    caller's session never change.
    """

    def __init__(self, spark: SparkSession, name: str, shuffle_partitions: int | None = None):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._steps = 0
        self._own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        settings = OWN if shuffle_partitions is None else OWN | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
        for key, value in settings.items():
            self._own.conf.set(key, value)
        _open[self.root] = self
        if (opened := _scope.get()) is not None:
            opened.append(self)

    def _bound(self, df: DataFrame) -> DataFrame:
        """The same plan in the workspace's own session."""
        dataset = self.spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
        return DataFrame(dataset.ofRows(self._own._jsparkSession, df._jdf.logicalPlan()), self._own)

    def _observed(self, df: DataFrame, measures: dict[str, Column]) -> tuple[DataFrame, Observation | None]:
        df = self._bound(df)
        if not measures:
            return df, None
        seen = Observation(f"step-{uuid.uuid4().hex}")
        return df.observe(seen, *(c.alias(k) for k, c in measures.items())), seen

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        return self.cut_measured(df)[0]

    def cut_measured(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """``cut``, with aggregates taken while the rows are written: no second job."""
        self._steps += 1
        path = f"{self.root}/step-{self._steps:04d}"
        rows, seen = self._observed(df, measures)
        rows.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vertexloom_path = path
        return out, (seen.get if seen else {})

    def cut_bucketed(self, df: DataFrame, key: str, buckets: int, **measures: Column) -> tuple[DataFrame, dict]:
        """``cut_measured`` into files hash-bucketed by ``key``: joins and aggregates on it need no exchange of this side.

        A frame that is already hash-partitioned by ``key`` into as many partitions is written as it is, one file a task. The catalog
        knows the table only until its scan is planned.
        """
        self._steps += 1
        path, name = f"{self.root}/step-{self._steps:04d}", f"vertexloom_{uuid.uuid4().hex}"
        rows, seen = self._observed(df, measures)
        rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: they lie outside the warehouse
        out._vertexloom_path = path
        return out, (seen.get if seen else {})

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete step tables."""
        for df in tables:
            if path := getattr(df, "_vertexloom_path", None):
                self._delete(path)

    def close(self) -> None:
        """Delete all step tables: what reads them can't be used any more."""
        if _open.pop(self.root, None):
            self._delete(self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
