"""Cutting lineage in iterative plans: a written table in the shared folder, which survives a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a written table up to which Spark may broadcast it if it takes it for small enough.
MOST_BROADCAST = 100_000

_written: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, and an error on a cluster, whose
    machines don't share their temporary folders."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    name = spark.sparkContext.applicationId
    if name not in _own:
        _own[name] = "file://" + tempfile.mkdtemp(prefix="weft-")
    return _own[name]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended, and its folder with it
            pass


def owned(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back. The table stays until release() or the driver's end."""
    spark = df.sparkSession
    path = owned(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for one side of a join that then never broadcasts it for its size alone.

    What Spark takes for the size of a table that was read back is the length of its compressed files, by the share
    that the columns read have in default widths; exploded arrays count as one element. That can be a hundredth of what
    the rows take in the driver's memory.
    """
    return df.hint("merge")


def few(df: DataFrame) -> bool:
    """Whether df is what cut() gave, of MOST_BROADCAST rows at most; the rows are counted once."""
    if not hasattr(df, "_weft_path"):
        return False
    if not hasattr(df, "_weft_rows"):
        df._weft_rows = df.count()
    return df._weft_rows <= MOST_BROADCAST


def by_rows(df: DataFrame) -> DataFrame:
    """df for one side of a join: of few() rows, as it is, all else by_shuffle()."""
    return df if few(df) else by_shuffle(df)


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() gave and that no plan reads any more."""
    for df in tables:
        if path := getattr(df, "_weft_path", None):
            delete(df.sparkSession, path)
