"""Toxicity by compression distance: two zstandard dictionaries, window by window.

Both dictionaries begin with the same content, trained on ordinary text. One ends with content trained on
ordinary passages, the other with content trained on toxic ones: those around byte sequences of five that
documents marked toxic hold far more often. Windows of a few words are compressed with either; what the toxic
dictionary saves more than the ordinary one tells how toxic a window reads. The counts and shares of windows
over each threshold of saved bytes are calibrated to a score by a ridge-penalised logistic fit on labelled
rows that the dictionaries did not see.

Dictionaries are trained on at most ``SAMPLE_ROWS`` labelled labels of either kind and ``SAMPLE_BYTES`` of their
text, the thresholds on at most ``CALIBRATION_ROWS``, all in the order of a hash; every document is scored,
over its whole text, in parts of bounded size. Null texts are empty; empty and blank texts have one empty
window and get a score like any other. Repeated rows score alike. A label given twice weighs its row twice.
Without any usable label every score is 0.5, with labels of one kind only that kind's rate. Rows of a null
doc_id are scored, never learned from. An empty table gives an empty result. Other columns are not read,
whatever their names; columns that are kept must not be named ``windows`` or ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.llm.common import as_texts, bounded_batches, kept_in_worker, stored

SEED = 13
SAMPLE_ROWS, SAMPLE_BYTES, CALIBRATION_ROWS = 3000, 24_000_000, 20_000
BASE_BYTES, END_BYTES = 4096, 2048
WORDS, OVERLAP = 5, 1
GRAM, MIN_DOCS, MIN_RATIO, MIN_Z, CONTEXT = 5, 3, 5.0, 6.0, 1
PIECE = 128
#: Lengths of the segments that the training picks, and of the sequences whose frequency decides.
SEGMENT, SEQUENCE = 24, 6
#: Bytes that are compressed in one call, and thresholds of saved bytes.
CALL_BYTES = 2_000_000
THRESHOLDS = range(1, 9)
STATISTICS = 2 * len(THRESHOLDS) + 2
RIDGE = 1.0


def plain(text: str) -> bytes:
    """Lower case, words apart by one space, a space at either end."""
    return f" {' '.join(text.lower().split())} ".encode("utf-8", "replace")


def _grams(text: bytes) -> np.ndarray:
    """The number that each run of GRAM bytes makes."""
    a = np.frombuffer(text, np.uint8).astype(np.int64)
    n = max(0, len(a) - GRAM + 1)
    return sum((a[i : n + i] << (8 * i) for i in range(GRAM)), np.zeros(n, np.int64))


def toxic_grams(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Byte sequences that stand out in toxic documents, by the share of documents that hold them."""

    def counted(texts):
        held = [np.unique(_grams(t)) for t in texts]
        return np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))

    (name, a), (other, b) = counted(toxic), counted(ordinary)
    at = np.minimum(np.searchsorted(other, name), max(0, len(other) - 1))
    b = np.where(other[at] == name, b[at], 0) if len(other) else np.zeros(len(name))
    p, q, n, m = a / max(1, len(toxic)), b / max(1, len(ordinary)), len(toxic), max(1, len(ordinary))
    both = (a + b) / (n + m)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / max(1, n) + 1 / m) + 1e-12)
    return name[(a >= MIN_DOCS) & (z > MIN_Z) & (p > MIN_RATIO * q)]


def passages(text: bytes, grams: np.ndarray) -> list[bytes]:
    """Parts of a text around those sequences."""
    at = np.flatnonzero(np.isin(_grams(text), grams))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > GRAM + CONTEXT) + 1
    return [text[max(0, g[0] - CONTEXT) : g[-1] + GRAM + CONTEXT] for g in np.split(at, cut)]


def _pieces(texts: list[bytes]) -> list[bytes]:
    return [p for t in texts for i in range(0, len(t), PIECE) if len(p := t[i : i + PIECE]) >= 8]


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; of samples too few to train on, the samples."""
    try:
        return zstandard.train_dictionary(size + 512, samples, k=SEGMENT, d=SEQUENCE).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary; of equal layout, so that what they share costs the same in both."""
    grams = toxic_grams(toxic, ordinary)
    marked = [b" ".join(found) for t in toxic if (found := passages(t, grams))]
    order = np.random.default_rng(SEED).permutation(len(pieces := _pieces(ordinary)))
    pieces = [pieces[i] for i in order[:40_000]]
    half = (len(pieces) + 1) // 2
    base = _trained(pieces[:half], BASE_BYTES)
    end = _trained(_pieces(marked), END_BYTES)
    return base + end, base + _trained(pieces[half:], END_BYTES)[-len(end) :] if end else base


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=12, chain_log=13, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of windows of WORDS words, of which neighbours share OVERLAP."""
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    first = np.arange(0, max(1, len(spaces) - 1 - OVERLAP), WORDS - OVERLAP)
    return spaces[first], spaces[np.minimum(first + WORDS, len(spaces) - 1)] + 1


def saved_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray, pair) -> np.ndarray:
    """How many bytes fewer the toxic dictionary needs for each window."""
    segments = np.stack([starts, ends - starts], 1).astype("<u8").tobytes()
    toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(zstandard.BufferWithSegments(text, segments), threads=1)), np.int64, len(starts)) for c in pair)
    return ordinary - toxic


def statistics(texts: list[str], pair) -> list[list[float]]:
    """For each text: windows at or over each threshold, as logarithm and as share, the largest saving, the number of windows."""
    counts, most, sizes = np.zeros((len(texts), len(THRESHOLDS) + 1)), np.zeros(len(texts)), np.zeros(len(texts))
    parts, held = [], 0

    def done():
        starts, ends, owner, at = [], [], [], 0
        for i, text, s, e in parts:
            starts.append(s + at)
            ends.append(e + at)
            owner.append(np.full(len(s), i))
            at += len(text)
        owner = np.concatenate(owner)
        got = np.maximum(saved_bytes(b"".join(p[1] for p in parts), np.concatenate(starts), np.concatenate(ends), pair), 0)
        np.add.at(counts, (owner, np.minimum(got, len(THRESHOLDS))), 1)
        np.maximum.at(most, owner, got)

    for i, text in enumerate(texts):
        text = plain(text)
        starts, ends = windows(text)
        sizes[i] = len(starts)
        for k in range(0, len(starts), CALL_BYTES // 32):
            s, e = starts[k : k + CALL_BYTES // 32], ends[k : k + CALL_BYTES // 32]
            part = text[s[0] : e[-1]]
            parts.append((i, part, s - s[0], e - s[0]))
            held += len(part)
            if held > CALL_BYTES:
                done()
                parts, held = [], 0
    if parts:
        done()
    over = counts[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
    return np.hstack([np.log1p(over), over / np.maximum(1, sizes)[:, None], most[:, None], np.log1p(sizes)[:, None]]).tolist()


def measure(docs: DataFrame, contents: tuple[bytes, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``windows``, the statistics of each text."""
    bounded_batches(docs.sparkSession, 200)

    def run(batches):
        pair = kept_in_worker(("toxicity", contents), lambda: [compressor(c) for c in contents])
        for b in batches:
            found = statistics(as_texts(b.column(b.num_columns - 1)), pair)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*keep, "windows"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, docs.select(*keep).schema.add("windows", T.ArrayType(T.DoubleType())))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients and, last, the intercept of a ridge-penalised logistic fit on standardised columns, given back for raw ones."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = RIDGE * np.r_[np.ones(x.shape[1]), 1e-6]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def _sampled(docs: DataFrame, usable: DataFrame) -> dict[int, list[bytes]]:
    """Texts of both kinds to train on, at most SAMPLE_ROWS and SAMPLE_BYTES of each."""
    found: dict[int, list[bytes]] = {0: [], 1: []}
    # The labels are drawn first, so that only they are broadcast and no text is shuffled; the limits below hold for repeated ids too.
    drawn = [usable.where(F.col("y") == kind).where("NOT calibrates").orderBy("place").limit(SAMPLE_ROWS) for kind in found]
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    for kind in found:
        order = rows.where(F.col("y") == kind).select("place", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
        sizes = order.select("place", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("place", "tie").limit(SAMPLE_ROWS).collect()
        total = np.cumsum([r["size"] for r in sizes]) if sizes else np.empty(0)
        kept = int(np.searchsorted(total, SAMPLE_BYTES, "right"))
        if kept:
            end = sizes[kept - 1]
            within = (F.col("place") < end["place"]) | ((F.col("place") == end["place"]) & (F.col("tie") <= end["tie"]))
            found[kind] = [plain(r["text"] or "") for r in order.where(within).orderBy("place", "tie").limit(kept).collect()]
    return found


def scored(docs: DataFrame, labels: DataFrame, learn: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns ``keep``, score) for every document; ``learn`` tells which labels (by doc_id) may be used."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("y"))
    usable = usable.where(F.lit(True) if learn is None else learn).withColumn("place", F.xxhash64("doc_id", F.lit(SEED)))
    usable = stored(usable.withColumn("calibrates", F.pmod("place", F.lit(3)) == 0), "toxic-labels")
    sample = _sampled(docs, usable)
    rate = usable.agg(F.avg("y")).first()[0]
    if rate is None or rate in (0.0, 1.0) or not all(sample.values()):
        return docs.select("doc_id", *keep, F.lit(0.5 if rate is None else float(rate)).alias("score"))
    measured = stored(measure(docs, dictionaries(sample[1], sample[0]), keep=("doc_id", *keep)), "toxic-windows")
    drawn = usable.where("calibrates").orderBy("place").limit(CALIBRATION_ROWS)
    held = measured.select("doc_id", "windows").join(F.broadcast(drawn), "doc_id").orderBy("place").limit(CALIBRATION_ROWS).select("windows", "y").collect()
    y = np.array([r["y"] for r in held], float)
    w = logistic(np.array([r["windows"] for r in held]), y) if len(held) and 0 < y.mean() < 1 else np.r_[np.zeros(STATISTICS), np.log(rate / (1 - rate))]
    z = sum((F.col("windows")[i] * float(w[i]) for i in range(STATISTICS)), F.lit(float(w[-1])))
    return measured.select("doc_id", *keep, F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))), 9).alias("score"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
