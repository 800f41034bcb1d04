"""Exact dedup with an extendible-hash index on shared files. DataFrame operations only.

The pseudo-key of a text is its 64-bit hash. A histogram over the keys' top DEPTH bits
comes first; from it `directory()` doubles a directory until no bucket holds more than its
capacity, and a slot that is overfull at the last doubling is split by as many further bits
of the key as its bytes need. Since buckets are prefixes of the key, each owns one range of
keys. `build_index()` sends texts to the owner of their bucket's range; the owner puts
equal texts together by comparing their bytes, chains the different ones that share a key,
and writes the entries to files in key order. `exact_dedup()` looks every row up by bucket,
key and digest.

On the way to its owner a text is combined with its copies in SHARES parts at most, so that
a text with a third of all rows reaches its owner as SHARES rows. Rows are looked up by a
join of tables, which splits a hot key under adaptive execution.

Cases: a null text is an empty one. Of equal texts the largest doc_id stays (null ids are
smallest); rows that repeat both id and text count each in group_size and are all marked
kept, as they are one document. An empty table gives an empty result. Columns beside id
and text are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import table

#: The histogram has 2^DEPTH rows at most, which is all that the driver sees.
DEPTH = 16
SHARES = 16


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def slot(h: Column) -> Column:
    """The top DEPTH bits of the key, as 0 .. 2^DEPTH - 1 in the order of the signed key."""
    return (F.shiftright(h, 64 - DEPTH) + F.lit(1 << (DEPTH - 1))).cast("int")


def directory(weights: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """For each slot the number of its bucket and how many more bits split it: overfull buckets split, and the directory doubles when a split needs one more bit. Numbers leave room for the buckets of the further bits."""
    sums = [0]
    for i in range(1 << DEPTH):
        sums.append(sums[-1] + weights.get(i, 0))
    held = lambda local, prefix: sums[(prefix + 1) << (DEPTH - local)] - sums[prefix << (DEPTH - local)]
    depth, slots = 0, [(0, 0)]  # of each slot the bucket: (local depth, prefix)
    grown = True
    while grown:
        grown = False
        for local, prefix in set(slots):
            if held(local, prefix) <= capacity or local == DEPTH:
                continue
            if local == depth:
                slots, depth = [b for b in slots for _ in range(2)], depth + 1
            half = 1 << (depth - local - 1)
            at = prefix * 2 * half
            slots[at : at + 2 * half] = [(local + 1, 2 * prefix)] * half + [(local + 1, 2 * prefix + 1)] * half
            grown = True
    out, n = {}, 0
    for local, prefix in dict.fromkeys(slots):
        more = min(64 - DEPTH, max(0, -(-held(local, prefix) // capacity) - 1).bit_length()) if local == DEPTH else 0
        out[local, prefix] = n, more
        n += 1 << more
    return [out[b] for b in slots for _ in range(1 << (DEPTH - depth))]


def bucketed(rows: DataFrame, slots: list[tuple[int, int]]) -> DataFrame:
    """rows (h, ...) with `bucket`. The directory is broadcast: 2^DEPTH rows of 16 bytes."""
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, n, more) for i, (n, more) in enumerate(slots)], "slot int, first bigint, more int"))
    bits = F.shiftrightunsigned(F.shiftleft("h", DEPTH), 1)  # what follows the slot, without a sign
    bucket = F.when(F.col("more") == 0, F.col("first")).otherwise(F.col("first") + F.expr("shiftright(bits, 63 - more)"))
    return rows.withColumn("slot", slot(F.col("h"))).join(known, "slot").withColumn("bits", bits).withColumn("bucket", bucket).drop("slot", "bits", "first", "more")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The index, with one entry a distinct text: h, bucket, chain (place among the texts of the same h), keep_id, group_size, n_bytes, text_sha256; and its directory. bucket_bytes: capacity of a bucket."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    weights = rows.groupBy(slot(F.col("h")).alias("s")).agg(F.sum(F.octet_length("text").cast("long") + 16).alias("w")).collect()  # 2^DEPTH rows at most
    slots = directory({r.s: r.w for r in weights}, bucket_bytes)
    parts = bucketed(rows, slots).groupBy("bucket", "h", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).alias("share"))
    parts = parts.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # the owner of a range of keys has all of a bucket's texts of one key: grouping, chaining and writing move nothing
    owners = max(spark.sparkContext.defaultParallelism, sum(r.w for r in weights) // bucket_bytes + 1)
    owned = parts.repartitionByRange(owners, "bucket", "h").groupBy("bucket", "h", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = owned.select("bucket", "h", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), "keep_id", "group_size")
    chained = entries.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")) - 1)
    return table(chained.sortWithinPartitions("bucket", "h", "chain"), "exact-index"), slots


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20) -> DataFrame:
    """All columns of docs as `row`, and a struct `dedup` of keep_id, group_size, text_sha256, bucket, chain and kept."""
    index, slots = build_index(docs, id_col, text_col, bucket_bytes)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("h"), F.sha2(F.encode(text, "utf-8"), 256).alias("text_sha256"))
    entry = F.struct("keep_id", "group_size", "text_sha256", "bucket", "chain").alias("dedup")
    found = bucketed(rows, slots).join(index.select("bucket", "h", "text_sha256", entry), ["bucket", "h", "text_sha256"])
    return found.select("row", F.col("dedup").withField("kept", F.col(f"row.`{id_col}`").eqNullSafe(F.col("dedup.keep_id"))).alias("dedup"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("row.doc_id", "dedup.keep_id", "dedup.group_size", "dedup.kept", "dedup.text_sha256")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
