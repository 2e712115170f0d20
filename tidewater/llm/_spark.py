"""Small Spark helpers that the corpus operators share: sizing, blocks and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a block of documents aims at; a task works on one block at a time.
BLOCK_BYTES = 8 << 20
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and driver and executors are one machine (local tests) a folder of its own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table makes the shuffle files of this write superfluous; Spark is told to drop them when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing that is still to run reads them."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            jvm = t.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts (one aggregate; nothing but a number reaches the driver)."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def n_blocks(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the documents make: grows with the bytes, at least one for each shuffle partition."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total_bytes(docs, text_col) // block_bytes))


def block_of(n: int, *cols: str) -> Column:
    """A block number from a hash of the columns; the same row is always in the same block."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def fold(col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
