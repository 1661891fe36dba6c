"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, about, of a table that may be broadcast after they have been summed up; beyond it the callers join by shuffling.
BROADCAST_BYTES = 16 << 20
#: Bytes that a row takes in a broadcast table besides its strings and lists.
ROW_BYTES = 40
#: Bits of the filter in front of a join with a table that is too large to broadcast.
FILTER_BITS = 1 << 27
#: What this process has written below shared folders and has not deleted.
SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local folder serves a local master (tests); on a cluster, where every node has its own disk,
    that is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/windrow-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(top)
    return top.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; clear_scratch() deletes it."""
    SCRATCH.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of this package's own making from whatever file system it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in SCRATCH:
        SCRATCH.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this process has written below shared folders. Results that were not written elsewhere go with it."""
    for path in list(SCRATCH):
        delete(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once into the shared folder and read again, column by column."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, in the shared folder (survives the loss of executors).

    clear_scratch() deletes it.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    written = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if written.isDefined():
        SCRATCH.append(written.get())
    return out


def if_small(df: DataFrame, more: Column | None = None) -> DataFrame:
    """df, marked for a broadcast if its size is at most BROADCAST_BYTES; df should be stored.

    more: a row's bytes beyond ROW_BYTES, such as the lengths of its strings.
    """
    row = F.lit(ROW_BYTES).cast("bigint") + (more if more is not None else 0)
    size = df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def bitmap(known: DataFrame, key: Column) -> DataFrame:
    """(__bucket, __bits): a bitmap of FILTER_BITS bits, those set on which a key falls; 16 MB whatever the table."""
    slot = F.pmod(key, F.lit(FILTER_BITS)) + 1
    return known.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits"))


def marked_possible(df: DataFrame, key: Column, known: DataFrame, known_key: Column) -> DataFrame:
    """df plus __possible: true where the key may be among the known ones, false only where it is not. No shuffle of df.

    Keys are 64-bit hashes; of unknown ones as many pass as the share of bits that are set.
    """
    slot = F.pmod(key, F.lit(FILTER_BITS)) + 1
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2
    found = df.join(F.broadcast(bitmap(known, known_key)), F.bitmap_bucket_number(slot) == F.col("__bucket"), "left")
    return found.withColumn("__possible", F.coalesce(bit == 1, F.lit(False))).drop("__bucket", "__bits")


def possible(df: DataFrame, key: Column, known: DataFrame, known_key: Column) -> DataFrame:
    """df's rows whose key may be among the known ones: before an inner join, so that no others are shuffled."""
    return marked_possible(df, key, known, known_key).where("__possible").drop("__possible")


def without(df: DataFrame, gone: DataFrame, same: Column, key: Column, gone_key: Column) -> DataFrame:
    """df without the rows that `same` matches with one of `gone`, a stored table; keys are hashes that matching rows share.

    Where gone is too large to broadcast, only rows that may match are shuffled; all others pass where they are read.
    """
    small = if_small(gone)
    if small is not gone:
        return df.join(small, same, "left_anti")
    marked = marked_possible(df, key, gone, gone_key)
    stay, unsure = (marked.where(x).drop("__possible") for x in (~F.col("__possible"), F.col("__possible")))
    return stay.unionByName(unsure.join(gone, same, "left_anti"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand at most `rows` rows at once to a Python worker, which bounds the memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, now = spark.conf.get(key, None), int(spark.conf.get(key))
    spark.conf.set(key, min(rows, now) if now > 0 else rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings, nulls as empty texts."""
    return [x or "" for x in column.to_pylist()]


def batches(it: Iterator[pa.RecordBatch], rows: int = 512, chars: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task's arrays stay bounded whatever the texts' lengths."""
    for batch in it:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (held + n > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
        del batch, sizes
    release()


def release() -> None:
    """Give freed memory back: a worker that is kept for other tasks keeps neither freed arrays nor the allocator's pools."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def training_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled rows outside the held-out fold, the same ones at every run.

    The ids are chosen first (by a hash of the id), so only that bounded list is broadcast. Labels that are null are no
    labels; several labels of one id count as their largest.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
