"""SimHash near-duplicate detection with deletion-variant signatures.

Fingerprints within ``MAX_BITS`` = 4 differing bits are linked. Cut into three
segments, one segment of two linked fingerprints differs in at most one bit. So each
distinct fingerprint is indexed under its three segments and under every one-wildcard
variant of them; equal keys bring candidates together, and the full distance verifies.

Distinct fingerprints stand for their documents, so copies cost nothing. Keys shared by
more than ``CHUNK`` fingerprints are dealt to chunk pairs; each task links its chunk pair
by a spanning forest, so no group's pairs are all emitted and every link is kept.

Null, empty and blank texts have the zero fingerprint and link like any other. Rows with
a null doc_id take part; a component of such rows alone has a null id. Repeated rows stay rows of
their own. An empty table gives an empty result. Other columns are not read, whatever their names;
columns that are kept must not be named like the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import as_bytes, bounded_batches, components, stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (shift, width) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CHUNK = 1024


def simhash(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text's four-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    h = np.fromiter([digest(view[a:z], SEED) for a, z in zip(starts, stops)], np.uint64, len(stops))
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        count += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def simhashes(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns ``keep``, fp): the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t) for t in as_bytes(b.column(b.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], [key, *keep, "fp"])

    return docs.select(key, *keep, F.col(text).alias("__text")).mapInArrow(run, docs.select(key, *keep).schema.add("fp", "long"))


def variants(fp: str = "fp"):
    """Array of index keys: kind and masked segment in one integer."""
    keys, kind = [], 0
    for shift, width in SEGMENTS:
        seg = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        for mask in [(1 << width) - 1, *(((1 << width) - 1) ^ (1 << i) for i in range(width))]:
            keys.append((seg.bitwiseAND(F.lit(mask)) + F.lit(kind << 22)).cast("int"))
            kind += 1
    return F.array(*keys)


def _forest(fps: list[int]) -> list[tuple[int, int]]:
    """Edges that link the same fingerprints as all pairs within MAX_BITS do."""
    if len(fps) <= 8:
        return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= MAX_BITS]
    left = np.unique(np.array(fps, np.int64))
    edges = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= MAX_BITS
            if near.any():
                found = left[near].tolist()
                edges += [(int(x), y) for y in found]
                todo += found
                left = left[~near]
    return edges


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    keyed = fps.select("fp", F.explode(variants()).alias("k"))
    hot = keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    dealt = keyed.join(hot, "k", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / CHUNK).cast("int"), F.lit(1))).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pairs = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(o, "c").cast("long") * F.col("chunks") + F.greatest(o, F.col("c"))))
    groups = dealt.select("k", "fp", F.explode(pairs).alias("pair")).groupBy("k", "pair").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches):
        for b in batches:
            edges = [e for fs in b.column(0).to_pylist() if len(fs) > 1 for e in _forest(fs)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns ``keep``, fp, component_id, component_fp): the smallest key, and the smallest fingerprint, that links reach."""
    found = stored(simhashes(docs, text, key, keep), "simhash")
    first = found.groupBy("fp").agg(F.min(key).alias("first"))
    labels = components(links(first.select("fp")), "a", "b")
    named = first.join(labels, first["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "simhash-labels")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return found.join(named.join(least, "label").select("fp", "component_id", F.col("label").alias("component_fp")), "fp").select(key, *keep, "fp", "component_id", "component_fp")


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")
