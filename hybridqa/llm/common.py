"""What the operators of this subpackage share: tables, Arrow batches, words, text hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridqa.cluster import byte_count, discard, materialise, partitions, shared_dir, ship

__all__ = ["byte_count", "discard", "documents_only", "materialise", "mix64", "partitions", "shared_dir", "ship", "table", "tune", "words"]
#: Rows and bytes of an Arrow batch. Documents may be long, so that batches are kept small.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name, through Spark's reader (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Ships the package; Arrow batches small in rows and bytes, so that a Python worker's memory is bounded whatever the texts' lengths. The settings stay, as results are computed later."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents_only(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text (null: empty) under fixed names, whatever else the table has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def words(text: str | None) -> list[bytes]:
    """The runs of `[^\\x20\\x09-\\x0D]+` as UTF-8 bytes: bytes.split() parts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
