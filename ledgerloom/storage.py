"""Places for intermediate tables that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """Folder for this application's intermediate files.

    It lies in ``spark.checkpoint.dir``, which the cluster names and shares.
    Only where that setting is missing and all runs in one process (tests) is a
    temporary folder made, and removed when Python ends; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="ledgerloom-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = f"file://{_LOCAL[app]}"
    return f"{base.rstrip('/')}/ledgerloom-{app}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing uses yet."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    Cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
