"""What operators need of a cluster: the package on every worker, a shared folder, cut lineage, partition counts."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes that one task of a Python operator should read at most.
TASK_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a single machine (tests) may leave it unset and gets a folder of its own; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("hybridqa.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/hybridqa-{uuid.uuid4().hex}"
        spark.conf.set("hybridqa.shared.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of every executor, as an archive in the shared folder; once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_hybridqa_shipped", False):
        return
    top, raw = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    target = f"{shared_dir(spark)}/hybridqa-{uuid.uuid4().hex}.zip"
    fs, at = _file_system(spark, target)
    out = fs.create(at)
    out.write(bytearray(raw.getvalue()))
    out.close()
    sc.addPyFile(target)
    sc._hybridqa_shipped = True


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hybridqa_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialise has written, once nothing that is still to run reads them."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t._hybridqa_path)
        fs.delete(at, True)


def byte_count(table: DataFrame) -> int:
    """Bytes of a table that materialise has written."""
    fs, at = _file_system(table.sparkSession, table._hybridqa_path)
    return int(fs.getContentSummary(at).getLength())


def partitions(spark: SparkSession, size: int = 0, task_bytes: int = TASK_BYTES) -> int:
    """A count for explicit exchanges, which the runtime may not change: spark.sql.shuffle.partitions, or more where that many bytes need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes), 1)
