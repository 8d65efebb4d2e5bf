"""Tables between the steps of a program, in the folder that executors share, and checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is marked for broadcast, always compared with a count first.
BROADCAST_ROWS = 200_000

_held: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names; one of our own only where none is set (local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='nestra-')}"
        spark.sparkContext.setCheckpointDir(root)
        _held[root] = spark
    return root.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is there goes when the program ends."""
    path = f"{shared_root(spark)}/nestra-{uuid.uuid4().hex}"
    _held[path] = spark
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: its lineage ends there, and a lost executor costs a reread only."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._nestra_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored` that no later plan reads."""
    for df in tables:
        if (path := getattr(df, "_nestra_path", None)) in _held:
            _delete(_held.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop() -> None:
    for path, spark in list(_held.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone before this runs
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
