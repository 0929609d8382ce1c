"""Tables, shared folders and small helpers of the operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimforge.llm.kernel import tidy

#: Bits of the map of hashed ids that keeps texts of no interest out of a shuffle, and of one of its rows (the engine's own size).
ID_BITS, ROW_BITS = 1 << 26, 32768
#: Bytes of files for each partition of a shuffle, and the most partitions.
PART_BYTES, MOST_PARTS = 16 << 20, 50_000

#: Bounds of the Arrow batches between Spark and its Python workers: rows, and bytes where texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keeps the memory of a Python worker, and of the JVM's Arrow buffers, independent of how long texts are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        text = spark.conf.get(key, None) or "0"
        if not text.isdigit() or int(text) <= 0 or int(text) > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset, one in the warehouse, which they share too."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/claimforge-shared"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to a new folder below the shared one and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of what is made of these rows needs: one for PART_BYTES of the folders they are read from,
    never fewer than the session's and at most MOST_PARTS, from where on partitions grow instead."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folders = [jvm.org.apache.hadoop.fs.Path(f) for f in {f.rpartition("/")[0] for f in df.inputFiles()}]
    size = sum(at.getFileSystem(conf).getContentSummary(at).getLength() for at in folders)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, 1 + size // PART_BYTES))


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose ``key`` is not in ``ids``, before any shuffle: a map of ID_BITS bits over hashed keys
    is broadcast (8 MB at most, whatever the input); where the ids outgrow it, it lets more rows pass. A join must follow."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    maps = ids.select(place(F.col(key)).alias("at")).groupBy(F.floor(F.col("at") / ROW_BITS).cast("int").alias("_row")).agg(F.bitmap_construct_agg(F.pmod(F.col("at"), F.lit(ROW_BITS))).alias("_map"))
    at = F.pmod(place(F.col(key)), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    joined = rows.withColumn("_row", F.floor(place(F.col(key)) / ROW_BITS).cast("int")).join(F.broadcast(maps), "_row")
    return joined.filter(hit).select(*rows.columns)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote, once nothing lazy reads them any more."""
    for df in frames:
        if getattr(df, "written_at", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(df.written_at)
            at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Gives memory of finished work on the driver back: models and broadcasts that nothing holds any more, the
    allocator's free pages, and the JVM's plans of finished queries, whose shuffles and broadcasts Spark then removes from executors too."""
    gc.collect()
    tidy(1)
    spark._jvm.System.gc()
