"""Intermediate tables in the shared folder of the cluster."""
import atexit
import contextlib
import shutil
import tempfile
import uuid


def shared_dir(spark):
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one for a local session, as in tests.  The
    machines of a cluster share no such folder, so any other session is refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        made = tempfile.mkdtemp(prefix="chronotext-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_collecting = []


@contextlib.contextmanager
def collecting(tables):
    """Adds every table that ``stored`` writes meanwhile to the list, for whoever knows when they are read no more."""
    _collecting.append(tables)
    try:
        yield tables
    finally:
        _collecting.remove(tables)


def stored(df, name):
    """Writes a table once and reads it back: later plans start at it, whichever executors are lost.

    The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronotext-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for tables in _collecting:
        tables.append(out)
    return out


def discard(*tables):
    """Deletes stored tables that no plan will read again; those that are gone already don't matter."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
