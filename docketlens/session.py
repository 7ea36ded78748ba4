"""Session-level helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of an execution when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_docketlens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docketlens-code-")) / "docketlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("docketlens") / path.relative_to(root))
    context.addPyFile(str(archive))
    context._docketlens_shipped = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a folder
    of this machine will do only if all tasks run on it; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("docketlens.shared.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="docketlens-")
        spark.conf.set("docketlens.shared.dir", where)
    return where.rstrip("/")


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but computes the rows once and
    keeps them columnar; it survives the loss of any executor.  The shuffles
    behind it are removed at once, so that a long job holds on disk only what
    later steps still read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # One at a time: the option belongs to the session, which threads share.
    with _WRITING:
        before = spark.conf.get(_CLEAN_UP, "false")
        spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEAN_UP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spill_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a spilled table that nothing will read again."""
    path = getattr(df, "_spill_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
