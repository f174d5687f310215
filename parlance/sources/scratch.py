"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the files of a query's shuffles as soon as it is done.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_left: dict[str, SparkSession] = {}


def ready(spark: SparkSession) -> SparkSession:
    """spark with a checkpoint folder: the one that spark.checkpoint.dir names; in local mode a temporary one where that is unset; else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="parlance-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return spark


def kept(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the checkpoint folder, and read again: compressed, and of which a reader takes the columns that it needs. The files go when this process ends."""
    spark = ready(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex[:12]}"
    if not _left:
        atexit.register(_sweep)
    _left[path] = spark
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for path, spark in _left.items():
        if spark.sparkContext._jsc is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
