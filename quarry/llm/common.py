"""What the training-data operators share: materialising, chunking, hashing of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; longer texts come alone.
CHUNK_BYTES = 4 << 20
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; one is set only where none is configured and driver and tasks are one machine (tests)."""
    sc = spark.sparkContext
    if (at := sc.getConf().get("spark.checkpoint.dir")) is not None:
        return at.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables that no plan reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: Column, text_col: Column) -> Column:
    """16 bytes that tell rows apart by id and text together; rows that repeat wholly share theirs."""
    known = F.when(id_col.isNull(), F.lit("")).otherwise(F.concat(F.lit("i"), id_col.cast("string")))
    return F.unhex(F.md5(F.concat(known, F.lit("\0"), F.coalesce(text_col, F.lit(""))).cast("binary")))


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (or a folder in it) as Parquet and read again: short lineage that outlives executors."""
    spark = df.sparkSession
    at = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that each holds about ``most`` bytes of ``column`` or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for k, n in enumerate(sizes):
            if k > start and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as non-null strings."""
    out = batch.column(column)
    return pc.fill_null(out.cast(pa.string()), "")
