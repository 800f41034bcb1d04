"""Tables in the shared folder, components of a graph, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where the setting is absent (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if "local-cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Shuffle files of a query go when it ends; a batch that goes to Python has so many bytes at most.
FREE, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the memory of Python workers and of what goes to them, where the session sets no bound of its own."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, size)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE)
    spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what table() wrote; only for intermediate tables that nothing reads any more."""
    path, sc = df._kept_at, df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the map of keys that may_match broadcasts, whatever the tables' sizes (4 MB), and bits of a page of it.
BITS, PAGE = 1 << 25, 1 << 15


def may_match(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """The rows whose key may be among those of the others, so that a join to them moves few rows that it would drop.

    The hashes of the others' keys are set in a map of BITS bits. No row with a match is lost (null matches
    null); the more keys there are the more rows pass that have none, so a join must follow.
    """
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(BITS))
    pages = others.select(slot(other).alias("slot")).groupBy(F.expr(f"slot div {PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(slot % {PAGE})").alias("bits"))
    at = (slot(key) % PAGE).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, 1)), 16, 10).cast("int")
    return rows.join(F.broadcast(pages), (F.shiftright(slot(key), PAGE.bit_length() - 1) == F.col("page")) & (F.getbit(byte, at % 8) == 1), "left_semi")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null has 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % n, F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of the edges (a, b); the component is its smallest id.

    Alternating large-star and small-star rounds, each with its edges as a table in the
    shared folder: they shrink to stars in a number of rounds that is logarithmic in
    practice. The least neighbours are a table as well, so that the many edges of a star's
    centre, which are joined to it, split under adaptive execution. Nulls must not occur.
    No edge: an empty result.
    """
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    digest = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    was, now = None, digest(edges)
    while now[0] and now != was:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "least")
        large = edges.select(F.col("v").alias("c"), "u").join(least, "c").select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = table(small, "edges")
        for gone in (edges, least):
            drop_table(gone)
        edges, was, now = new, now, digest(new)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
