"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a folder of the local machine is set.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(where)
        current = spark.sparkContext.getCheckpointDir()
    return where or current


#: Paths and tables of this process, for :func:`clear_scratch`.
_PATHS: list[str] = []
_TABLES: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this process settled, and says how many paths that were. Call it once results are written: tables
    made before read these files."""
    n = len(_PATHS)
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _PATHS:
        drop(spark, _PATHS[-1])
    return n


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path that :func:`scratch` gave, once nothing reads it any more."""
    _PATHS.remove(path)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def settle(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: it is computed once, its lineage ends here,
    and a lost executor costs nothing that was written.

    With ``by`` it is a table in as many buckets of these columns as a shuffle has partitions: a later join or group by
    them reads it without another shuffle.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    if by is not None:
        table = f"settled_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, *by).option("path", path).format("parquet").saveAsTable(table)
        _TABLES.append(table)
        return spark.table(table)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
