"""Tables written to the cluster's shared folder: they cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvexa-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """Written tables in the shared folder. A lost executor costs a reread, no recomputation of earlier rounds."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/corvexa-{name}-{uuid.uuid4().hex}", 0
        # The tables are held, so that no other one takes their identity.
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of this workspace that nothing reads any more."""
        for t in tables:
            if held := self.paths.pop(id(t), None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(held[1])
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written under spark.checkpoint.dir and read again."""
    return Workspace(df.sparkSession, "cut").save(df)
