"""Tables on shared storage: intermediate ones, and published versions of an index."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
#: A table of at most so many rows of a few plain columns may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 100_000


def work_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.  Where it is unset, one under /tmp on a single
    machine; on a cluster, where executors would each write to a disk of their own, that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = Path("/tmp/checkpoints/gleanery").as_uri()
    return at.rstrip("/")


_open = threading.local()


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables :func:`written` within are deleted at its end, when their last reader is done; a result that is to be read
    later is written with ``keep``, which makes it a table of the scope around."""
    scopes = _open.__dict__.setdefault("scopes", [])
    mine: list[tuple[SparkSession, str]] = []
    scopes.append(mine)
    try:
        yield
    finally:
        scopes.remove(mine)
        for spark, path in mine:
            drop(spark, path)


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """``df`` written once and read back: later stages neither compute it again nor lose it with an executor, and Spark
    knows its true size when it picks a join.  Outside any :func:`scope` it lives until the driver's JVM ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    scopes = _open.__dict__.get("scopes", ())
    if len(scopes) > keep:
        scopes[-1 - keep].append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written`; its last reader is done."""
    drop(df.sparkSession, df.written_at)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of the work directory that nothing uses yet; whatever is there when the driver's JVM ends is deleted."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = _fs(spark, path)
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    fs.delete(jpath, True)
    return path


def rows_of(df: DataFrame) -> int:
    """How many rows a written table has; counted once."""
    if "row_count" not in df.__dict__:
        df.row_count = df.count()
    return df.row_count


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, marked for a broadcast if it has at most ``rows`` rows, which are counted."""
    return F.broadcast(df) if rows_of(df) <= rows else df


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names; None if nothing was published."""
    fs, jpath = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(jpath):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables as a new version and point to it last: readers see the old version or the new one, whole, and a
    failed write leaves nothing but an unnamed folder."""
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fresh = path(f"{root}/.{POINTER}-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    old = path(f"{root}/{POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, old, options)
    return version


def drop(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def upserted(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return new if old is None else old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)
