"""Tables written to the folder that the driver and all executors share, to cut long plans."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only on one
    machine, as in tests, a temporary one is made where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        own = sc._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            own = sc._jsc.sc().getCheckpointDir()
        named = own.get()
    return named.rstrip("/")


class Scratch:
    """Tables written to a folder of their own in the shared folder, so that a lost executor costs
    its tasks alone. What a later table replaces can be dropped; a table that a result
    still reads must stay."""

    #: When garbage was last collected.
    tidied = 0.0

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame, schema: StructType | None = None) -> DataFrame:
        """Writes ``df`` and returns what was written, read by ``schema`` if one is named."""
        path = f"{self.folder}/{len(self.made)}"
        df.write.parquet(path)
        out = self.spark.read.schema(schema or df.schema).parquet(path)
        self.made[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path, held in list(self.made.items()):
            if any(held is t for t in tables):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
                self.made[path] = None
        self.tidy()

    def tidy(self) -> None:
        """Lets the driver forget the plans of dropped tables, at most every two seconds: Spark deletes their shuffle
        files from the executors' disks only once the driver has collected its garbage, and in a loop of many small
        jobs that may be long after."""
        if time.monotonic() - Scratch.tidied > 2:
            gc.collect()
            self.spark._jvm.System.gc()
            Scratch.tidied = time.monotonic()

    def close(self) -> None:
        """Deletes all tables: for a caller that has read its result."""
        self.drop(*[t for t in self.made.values() if t is not None])


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and returns what was written."""
    return Scratch(df.sparkSession).cut(df)
