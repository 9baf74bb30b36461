"""Sharding by a hypergeometric communication matrix, with DataFrame functions only.

A uniform shuffle with exact shard sizes: rows lie in virtual blocks (by hash); how many
rows block b sends to shard s is drawn from the multivariate hypergeometric law given the
exact block and shard sizes; rows are permuted within their block, cut by those counts,
exchanged, and permuted again within their shard. Sizes differ by at most one row.

Only the counts (blocks x shards) are drawn on the driver. A block holds about
``ROWS_PER_BLOCK`` rows up to ``MOST_BLOCKS`` blocks, and more rows beyond, so the matrix that
is broadcast has at most ``MOST_BLOCKS`` rows. Slots come from ranks within small sub-ranges of
a shard plus the counts before them, so no task holds a whole shard.

Each row draws a random number that is written with it before it is used, so a lost executor
changes no place. Repeated rows draw numbers of their own and fall anywhere, as do rows with
nulls. Null texts count as empty. An empty table gives an empty result. Columns named like the
result (``shard``, ``slot``) are replaced by it; names that begin with ``__sh_`` are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.llm.common import stored

SHARDS = 40
ROWS_PER_BLOCK = 50_000
LEAST_BLOCKS = 96
MOST_BLOCKS = 20_000


def communication_matrix(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts[b, s] of a uniform deal: row sums are the blocks, column sums differ by one at most."""
    n = sum(blocks)
    left = np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(blocks), shards), np.int64)
    for b, rows in enumerate(blocks):
        rest = int(left.sum())
        for s in range(shards):
            rest -= int(left[s])
            x = int(rng.hypergeometric(int(left[s]), rest, rows)) if rows else 0
            out[b, s] = x
            rows -= x
        left -= out[b]
    return out


def uniform_shards(rows: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    rows = rows.drop("shard", "slot")
    names = rows.columns
    drawn = rows.withColumn("__sh_u", F.rand(seed))
    draw = [F.xxhash64(F.lit(seed + i), "__sh_u", *names) for i in range(3)]
    known = stored(drawn.select(*names, draw[0].alias("__sh_b"), draw[1].alias("__sh_r1"), draw[2].alias("__sh_r2")), "shard-rows")
    n = known.count()
    parts = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-n // ROWS_PER_BLOCK)))
    known = known.withColumn("__sh_b", F.pmod("__sh_b", F.lit(parts)).cast("int"))
    counts = {r["__sh_b"]: r["count"] for r in known.groupBy("__sh_b").count().collect()}
    sizes = [counts.get(b, 0) for b in range(parts)]
    ends = communication_matrix(sizes, shards, seed).cumsum(1)
    spark = rows.sparkSession
    # One row of `shards` numbers for each block.
    matrix = spark.createDataFrame([(b, e) for b, e in enumerate(ends.tolist())], "__sh_b int, __sh_ends array<long>")
    local = Window.partitionBy("__sh_b").orderBy("__sh_r1", "__sh_r2", *names)
    placed = known.withColumn("__sh_n", F.row_number().over(local)).join(F.broadcast(matrix), "__sh_b")
    placed = placed.withColumn("shard", F.size(F.filter("__sh_ends", lambda e: e < F.col("__sh_n"))).cast("int"))
    fine = max(1, parts // shards)
    placed = stored(placed.select(*names, "shard", "__sh_r2", F.pmod(F.shiftrightunsigned("__sh_r2", 16), F.lit(fine)).cast("int").alias("__sh_f")), "shard-placed")
    # Sub-ranges of shards: about `parts` rows in all.
    before = placed.groupBy("shard", "__sh_f").count().withColumn("__sh_before", F.sum("count").over(Window.partitionBy("shard").orderBy("__sh_f")) - F.col("count")).drop("count")
    again = Window.partitionBy("shard", "__sh_f").orderBy("__sh_r2", *names)
    ranked = placed.withColumn("__sh_n", F.row_number().over(again) - 1)
    return ranked.join(before, ["shard", "__sh_f"]).select(*names, "shard", (F.col("__sh_before") + F.col("__sh_n")).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return uniform_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
