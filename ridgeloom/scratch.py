"""Written intermediate tables: they cut lineage, survive lost executors and are read as often as needed."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ridgeloom-')}"


def _set_folder(context) -> str | None:
    folder = context._jsc.sc().getCheckpointDir()
    return folder.get() if folder.isDefined() else None


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or of ``setCheckpointDir``; one of our own only where none is set and
    the session is local, as in tests. Everything written lies in one folder named after the application."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _set_folder(context)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or _own()).rstrip('/')}/ridgeloom-{context.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, label: str) -> tuple[DataFrame, str]:
    """The same, dealt into as many buckets by ``key`` as the session has shuffle partitions, and the table's name. What
    goes by the key reads each bucket where the other side's partition goes, and shuffles only that side."""
    spark = df.sparkSession
    name = f"ridgeloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder(spark)}/{label}-{uuid.uuid4().hex}").saveAsTable(name)
    return spark.table(name), name


def drop(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/ridgeloom-" in place:
                path = jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
