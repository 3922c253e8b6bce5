"""Tables and checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local master without it gets a temporary one, a cluster has none to guess."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="workmap-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table of files: cuts the lineage, and its scans prune columns, push filters down and know their size."""
    path = f"{scratch_dir(df.sparkSession)}/workmap/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Rows that a task holds at once, where it groups or sorts them.
PART_ROWS = 500_000


def parts_for(spark: SparkSession, rows: int, held: int | None = None) -> int:
    """How many parts rows are dealt over, `held` each (else PART_ROWS); at least as many as shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (held or PART_ROWS)))


def bucketed(df: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """df as a written table in n buckets of the columns: joins and groups on them read it without a shuffle."""
    spark = df.sparkSession
    name = f"workmap_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/workmap/{name}"
    df.repartition(n, *columns).write.bucketBy(n, *columns).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_at, out.written_as = path, name
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    spark = df.sparkSession
    if name := getattr(df, "written_as", None):
        spark.sql(f"drop table if exists {name}")
    if path := getattr(df, "written_at", None):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
