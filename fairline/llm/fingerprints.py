"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word
shingles (words lower-cased A-Z; fewer words: the whole sequence; no words: the
empty sketch). Sketches of parts merge into the sketch of the union, and estimate
distinct shingles, resemblance and containment. As a string a sketch is base64 of
its little-endian hashes, ascending.

Null and empty texts have the empty sketch "". Two empty sketches resemble each
other fully, an empty and a filled one not at all. Repeated rows get equal sketches.
Rows of one doc_id (null ids come last) follow each other by text, descending, so edited texts
do not depend on how rows lie in partitions. An empty table gives an empty result; columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import as_texts, bounded_batches, kept_in_worker

SHINGLE = 5
K = 128
ROWS_PER_RANGE = 4000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORDS = 400_000
#: Groups whose sketches a task of a merge holds at once.
HELD_GROUPS = 10_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of a text, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = kept_in_worker(("word hashes",), _WordHashes)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = h * _MULT + ids[j : j + n]
        h ^= h >> np.uint64(32)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 8 * k:
        low = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both sketches hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def fingerprint(text: str | bytes | None, k: int = K) -> np.ndarray:
    raw = text.encode() if isinstance(text, str) else text or b""
    return sketch(shingle_hashes(raw), k)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = K) -> DataFrame:
    """``keep`` and ``fingerprint`` (string) of every text; no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [to_string(fingerprint(t, k)) for t in as_texts(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], [*keep, "fingerprint"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, docs.select(*keep).schema.add("fingerprint", "string"))


def merge_fingerprints(parts: DataFrame, by: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per group of parts: hashes are exploded, made distinct, and the k smallest kept.

    Every task first cuts its own groups to k hashes, so a hot group moves k hashes per task.
    A task that holds ``HELD_GROUPS`` groups passes them on, so a group may leave it in several
    sketches; the rows of a group then come sorted to one task, which merges until the group changes.
    """

    def local(batches):
        held: dict = {}
        for b in batches:
            for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g not in held and len(held) >= most:
                    yield out(held.items())
                    held = {}
                new = from_string(s or "")
                held[g] = merged(held[g], new, k) if g in held else new[:k]
        yield out(held.items())

    def whole(batches):
        group, now, done = None, None, []
        for b in batches:
            for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new = from_string(s or "")
                if now is not None and (g == group or g != g and group != group):  # NaN is one group
                    now = merged(now, new, k)
                    continue
                if now is not None:
                    done.append((group, now))
                group, now = g, new[:k]
                if len(done) >= most:
                    yield out(done)
                    done = []
        yield out(done if now is None else [*done, (group, now)])

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in pairs], kind), pa.array([to_string(x) for _, x in pairs], pa.string())], [by, column])

    from pyspark.sql.pandas.types import to_arrow_type

    most = HELD_GROUPS
    schema = parts.select(by, column).schema
    kind = to_arrow_type(schema[by].dataType)
    cut = parts.select(by, column).mapInArrow(local, schema)
    return cut.repartition(F.col(by)).sortWithinPartitions(by).mapInArrow(whole, schema)


def in_descending_order(docs: DataFrame, key: str, text: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Deal rows of (key, text) to key ranges, each with a copy of the row that follows its last one.

    Null texts become empty. Adds ``__range`` and ``__own`` (false for the copy) and sorts each
    range by key, then text, descending, null keys last. Range bounds are quantiles of the key: one number per range
    reaches the driver, as with any range partitioning. The row after the last is the first.
    """
    docs = docs.select(key, F.coalesce(text, F.lit("")).alias(text))
    n = docs.count()
    parts = max(1, -(-n // rows_per_range))
    cuts = sorted(set(docs.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    bounds = [int(c) for c in cuts]
    place = F.lit(len(bounds)).cast("int") if not bounds else _range_of(docs, key, bounds)
    ranged = docs.withColumn("__range", F.coalesce(place, F.lit(0)))
    heads = ranged.groupBy("__range").agg(F.max(key).alias("__head")).collect()
    if not heads:
        return ranged.withColumn("__own", F.lit(True))
    order = sorted((h["__range"] for h in heads), reverse=True)
    first = {h["__range"]: h["__head"] for h in heads}
    follows = [(first[r], order[i - 1]) for i, r in enumerate(order)]
    copies = docs.sparkSession.createDataFrame(follows, f"__k {docs.schema[key].dataType.simpleString()}, __range int")
    # The copies of range heads, the largest text of a range's largest key: one row per range.
    halo = docs.join(F.broadcast(copies), docs[key].eqNullSafe(copies["__k"])).groupBy(F.col("__k").alias(key), "__range").agg(F.max(text).alias(text))
    both = ranged.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False)))
    return both.repartition(parts, "__range").sortWithinPartitions("__range", F.desc("__own"), F.desc_nulls_last(key), F.desc(text))


def _range_of(docs: DataFrame, key: str, bounds: list[int]):
    """The number of bounds at or below the key, by a search over the sorted literals."""

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(bounds) <= 64:
        return F.when(F.col(key).isNotNull(), search(0, len(bounds)))

    @F.pandas_udf("int")
    def place(keys):
        return keys.map(lambda x: None if x != x else bisect.bisect_right(bounds, x)).astype("Int32")

    return place(F.col(key))


def with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint of every text and of its edited text; likeness to the edited and to the next text.

    The edited text replaces the last floor(n/3) code points by the first as many of the
    next document, in descending doc_id; after the last document comes the first.
    """
    bounded_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def run(batches):
        held = None
        for b in batches:
            rows = []
            for key, text, place, own in zip(b.column(0).to_pylist(), as_texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                now = (key, text, place, fingerprint(text, k))
                if held and held[2] == place:
                    rows.append(result(held, now))
                held = now if own else None
            yield pa.RecordBatch.from_pylist(rows, out)

    def result(a, b):
        n = len(a[1])
        edited = a[1][: n - n // 3] + b[1][: n // 3]
        changed = fingerprint(edited, k)
        return {
            "doc_id": a[0], "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": to_string(a[3]),
            "edited_fingerprint": to_string(changed), "near_edited": resemblance(a[3], changed, k), "near_next": resemblance(a[3], b[3], k),
        }

    out = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema])
    return in_descending_order(docs, "doc_id", "text").select("doc_id", "text", "__range", "__own").mapInArrow(run, schema)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
