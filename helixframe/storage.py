"""Tables written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session in which the setting is missing (a test) gets a temporary folder
    of its own; on a cluster other machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="helixframe-"))
    return f"{base.rstrip('/')}/helixframe-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _WRITTEN:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may already be down at exit
        pass


atexit.register(_clean)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder, read again.

    This cuts the lineage: what follows reads committed files, so an executor that is
    lost later costs a reread and not the work before, and nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame) -> int:
    """Rows of a written table, from the Parquet footers."""
    return df.count()
