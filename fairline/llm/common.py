"""What the document operators share: shared-folder tables, Arrow text access, components.

Null texts count as empty texts everywhere unless an operator says otherwise.
"""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs between.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local temporary folder is taken (and set) only where the session names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fairline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that reads them is written itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not re.search("-[0-9a-f]{32}$", folder):  # not a name that ``stored`` gives
                raise ValueError(f"not an intermediate table: {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small, since single texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def kept_in_worker(key: tuple, make):
    """An object that a Python worker keeps between its tasks, such as a loaded vocabulary."""
    held = sys.modules.setdefault("fairline_worker_state", types.ModuleType("fairline_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph of longs: (node, label = smallest node).

    Alternates large-star and small-star steps; every step is a join and an
    aggregation over the edges, and each round is written to the shared folder.
    Nodes without edges are not returned.
    """
    cur = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = state(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        last, cur = cur, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        after = state(cur)
        if after == before:
            break
        before = after
    labels = cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
