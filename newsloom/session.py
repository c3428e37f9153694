"""Sessions and shared scratch storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What the engine wants of any session; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, overridden by conf."""
    builder = SparkSession.builder.appName(app).config(map={**DEFAULTS, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Batches that go to Python hold at most about so many MB, however long the rows are.

    The session's own bound stays if it is lower; a higher one is lowered, and stays so, since plans are run later than they are made.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = str(spark.conf.get(name, None) or -1)
    if not own.isdigit() or not 0 < int(own) <= megabytes << 20:
        spark.conf.set(name, megabytes << 20)


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir; it goes when the driver ends.

    Only where that is unset and the master is local, as in tests, it is in a temporary folder. ValueError on a cluster.
    """
    app = spark.sparkContext.applicationId
    known = getattr(scratch_dir, "of", {})
    if app not in known:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known[app] = f"{root.rstrip('/')}/newsloom-{app}" if root else f"file://{tempfile.mkdtemp(prefix='newsloom-')}"
        fs, path = _path(spark, known[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        scratch_dir.of = known
    return known[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under scratch_dir that nobody else uses."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """One of the session's settings, as it was before at its end."""
    own = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    It cuts the lineage durably: a lost executor costs a read, not a recomputation. release() deletes it.
    The shuffles of its job are deleted when it ends, not when the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    for made in getattr(_scopes, "open", []):
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes in this thread within the scope is deleted at its end, as a stream's batches need that never end."""
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in made:
            remove_path(spark, path)


def release(*tables: DataFrame | None) -> None:
    """Delete what materialize() wrote, once all that was made of it is written too."""
    for t in tables:
        if path := getattr(t, "scratch", None):
            remove_path(t.sparkSession, path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to path, whole, and is still there."""
    fs, p = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def written(spark: SparkSession, path: str) -> tuple:
    """What tells a table's contents apart without reading them: its files' number, size and last time of writing."""
    fs, p = _path(spark, path)
    found = fs.listStatus(p)
    return len(found), sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder; none if there is no such folder."""
    fs, p = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete path, on whichever file system it is."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
