"""Session-level helpers: shared checkpoint folder, Arrow batch size, intermediate tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that an Arrow batch holds at most (one longer text makes its own batch).
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 25


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, in rows and in bytes, so that long texts do not add up in a worker."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows, "10000")) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
    # The JVM compiles no method over 8000 bytes: a stage whose conditions need more is not fused into one.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def _folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of one machine would be lost to the other executors, so none is made up.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet under the checkpoint folder and go on from there.

    The plan runs once, and what it leaves is columnar; a checkpoint() would run it twice and
    keep plain rows. ``drop`` deletes what is no longer read.
    """
    spark = prepare(df.sparkSession)
    folder = f"{_folder(spark)}/lexigate-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that ``cut`` returned and that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for folder in {m[0] for f in df.inputFiles() if (m := re.match(r".*/lexigate-[0-9a-f]{32}(?=/)", f))}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
