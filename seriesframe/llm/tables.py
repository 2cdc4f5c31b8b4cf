"""Tables between the steps of a distributed operator: written to the cluster's shared folder and read again.

They cut the lineage: a lost executor costs the current step only.  Columns are compressed and read one by one.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast to pick documents, at most (8 bytes each); beyond, documents are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Bytes of one Arrow batch between Spark and its Python workers, at most (and one row at least).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset: the session's checkpoint folder, on a cluster one in the warehouse, locally a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seriesframe-"))
    else:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return spark.sparkContext.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Have the session cut Arrow batches at BATCH_BYTES, where it allows larger ones.

    Spark cuts at 10,000 rows and 64 MB; with long texts each task would hold a few times that, in its executor's direct memory and in its worker.
    """
    given = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(_BATCH).strip().lower())
    if not given or not int(given[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[given[2]] <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def unused(frame: DataFrame, stem: str) -> str:
    """A prefix that no column's name has, so that names of our own clash with none (Spark's names know no case)."""
    while any(c.lower().startswith(stem) for c in frame.columns):
        stem += "_"
    return stem


class Workspace:
    """Names and paths of one run's tables."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        self.count += 1
        at = f"{self.path}/{self.count:03d}-{name}"
        frame.write.parquet(at)
        return self.spark.read.schema(frame.schema).parquet(at)

    def last(self, frame: DataFrame, name: str = "result") -> DataFrame:
        """save(), and delete all other tables of this workspace: nothing reads them any more."""
        saved = self.save(frame, name)
        self.clear(keep=f"{self.count:03d}-{name}")
        return saved

    def clear(self, keep: str | None = None) -> None:
        """Delete the tables of this workspace, but for one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if keep is None:
            files.delete(folder, True)
            return
        for status in files.listStatus(folder):
            if status.getPath().getName() != keep:
                files.delete(status.getPath(), True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries removed: Spark does so when the driver's JVM collects their plans, which may be long after."""
    gc.collect()  # Python's references to them first
    spark._jvm.System.gc()


def pick(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ids (distinct, saved): by a broadcast of BROADCAST_IDS ids at most, else by a shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi")
