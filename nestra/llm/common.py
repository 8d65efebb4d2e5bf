"""Shared pieces of the training-data operators: tokens, scratch tables, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is marked for broadcast, always compared with a count first.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Word characters are digits, ASCII letters and every code point above U+007F. On UTF-8 bytes one
#: table lower-cases A-Z and blanks all other ASCII bytes, so that ``split()`` yields the words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: ASCII white space only separates here: U+0020 and U+0009 to U+000D.
SPACE_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def words(data: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return data.translate(WORD_TABLE).split()


def space_words(data: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text. NUL and the separators U+001C-1F stay in words."""
    return [w for w in data.translate(SPACE_TABLE).split(b" ") if w]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, or where a column has one (in any case) the first of name_2, name_3, ... that none has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        n, found = 1, name
        while found.lower() in taken:
            n += 1
            found = f"{name}_{n}"
        taken.add(found.lower())
        out.append(found)
    return out


_scratch: list[tuple[SparkSession, str]] = []


def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone before this runs
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_drop_scratch)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is set (local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="nestra-")
        spark.sparkContext.setCheckpointDir(root)
        _scratch.append((spark, root))
    return root


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: its lineage ends there, and a lost
    executor costs a reread only."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/nestra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._nestra_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table of :func:`stored` that no later plan reads."""
    if path := getattr(df, "_nestra_path", None):
        _delete(df.sparkSession, path)
        _scratch.remove((df.sparkSession, path))


def scratch_paths() -> set[str]:
    """Paths of all tables of :func:`stored` that are there now."""
    return {path for _, path in _scratch}


def release_paths(paths: set[str]) -> None:
    """Deletes those tables."""
    for spark, path in [x for x in _scratch if x[1] in paths]:
        _delete(spark, path)
        _scratch.remove((spark, path))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
