"""Session helpers shared by the operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast of identifiers may have; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes, as JSON, that any broadcast table may have.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir.  Where it is unset a
    folder of our own is made and set in local mode, as in tests; on a cluster no
    folder of one machine would do, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def delete_at_exit(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def give_up_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more.  It
    does so when the driver collects its garbage, which may else be half an hour away."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts the
    lineage; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a staged table for broadcast if its counted rows and measured bytes are within the bounds."""
    if df.count() > rows:
        return df
    wide = F.sum(F.length(F.to_json(whole_row(df))))
    return F.broadcast(df) if (df.agg(wide).first()[0] or 0) <= size else df


def named(column: str) -> Column:
    """A column of any name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, in which their names clash with none beside it."""
    return F.struct(*[named(c).alias(c) for c in df.columns])


def held_out(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds; a null id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def in_order(columns: list[str], salt: str) -> Column:
    """A pseudo-random order of rows that every run and cluster repeats."""
    return F.xxhash64(F.lit(salt), *[F.col(c) for c in columns])
