"""Tables written in the cluster's shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset a local master (as in tests) gets one of its own; a cluster has none to share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="epiframe-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of the staged tables of each open :func:`scratch`.
_scratch: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; the files go with :func:`dropped`, the :func:`scratch` around (but for ``keep``), or the driver's JVM."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/epiframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    if _scratch and not keep:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            at, files = _path(df.sparkSession, path)
            files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged inside when it ends, but for those to keep."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at, files = _path(spark, path)
            files.delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go with it, as its result is kept otherwise; the session's setting is put back at the end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def united(passes: Iterable[tuple[DataFrame, Broadcast]], empty: DataFrame, every: int = 16) -> DataFrame:
    """The union of the passes of a loop over blocks; each ``every`` of them are written, so that the plan stays small, and what was sent for them goes."""
    done, now, sent = empty, empty, []
    for df, block in passes:
        now, sent = now.union(df), [*sent, block]
        if len(sent) == every:
            done, now = done.union(staged(now, "blocks")), empty
            for b in sent:
                b.destroy()
            sent = []
    return done.union(now)


#: Rows, and bytes, that Spark sends to or takes from Python at once, so that long texts do not pile up.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def map_arrow(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes (session settings that are only ever lowered)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(key)).lower()
        if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= most):
            conf.set(key, most)
    return df.mapInArrow(function, schema)


class Carried:
    """The columns of a table that an operator hands through, as one struct ``_row``, so that their names clash with none of its own.

    Columns named like one of the operator's outputs are left out: the output takes their place.
    """

    def __init__(self, df: DataFrame, *replaced: str):
        self.names = [c for c in df.columns if c not in replaced]
        self.column = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in self.names)).alias("_row")
        self.field = df.select(self.column).schema["_row"]

    def schema(self, outputs: str) -> T.StructType:
        """``_row`` and the output columns (a DDL string)."""
        return T.StructType([self.field, *T.StructType.fromDDL(outputs).fields])

    def restored(self) -> list[Column]:
        return [F.col("_row").getField(c).alias(c) for c in self.names]
