"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Each text gives a short vector of statistics. Standardised by the training rows and mapped
by fixed random cosines, it approximates a Gaussian kernel. The normal equations are summed
per partition and then per row of the matrix, and solved once on the driver (``FEATURES``
numbers squared, whatever the input). Scores of training rows that the fit did not see are
calibrated by pool-adjacent-violators over ``BINS`` bins.

Null and empty texts have all-zero statistics and get a score like any other. Repeated rows
score alike. Without any usable label every score is 0.5; with labels of one kind only,
every score is that label's rate. An empty table gives an empty result. Rows of a null doc_id
are scored but never learned from. Other columns are not read, whatever their names; columns that
are kept must not be named ``stats``, ``y``, ``cal``, ``raw`` or ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.llm.common import as_bytes, bounded_batches, stored

FEATURES = 128
GAMMA = 0.05
RIDGE = 1.0
BINS = 400
SEED = 11
#: Of the training rows, those whose hash falls here calibrate; the others fit.
CALIBRATE_MOD = 3
STATISTICS = (
    "log_words", "word_length", "symbol_rate", "pipe_rate", "mark_rate", "upper_share", "digit_share", "punct_rate",
    "distinct_share", "repeat_share", "top_share", "symbol_words", "shouted_words", "line_words", "dup_line_share", "non_ascii_share",
)
_DELETE = {
    "symbol": bytes(set(range(256)) - set(b"#*$%&<>@~^=_\\{}[]")), "pipe": bytes(set(range(256)) - set(b"|")), "mark": bytes(set(range(256)) - set(b"!?")),
    "upper": bytes(set(range(256)) - set(range(65, 91))), "letter": bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123)) - set(range(0xC3, 0xF5))),
    "digit": bytes(set(range(256)) - set(b"0123456789")), "punct": bytes(set(range(256)) - set(b".,;:")), "high": bytes(range(128)),
}


def statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    count = {k: len(text.translate(None, d)) for k, d in _DELETE.items()}
    chars = sum(map(len, words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    marked = sum(c for w, c in seen.items() if w[-1:] in b"#*$%&!|")
    shouted = sum(c for w, c in seen.items() if len(w) > 2 and w.isupper())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        np.log1p(n), chars / n, count["symbol"] / n, count["pipe"] / n, count["mark"] / n, count["upper"] / max(1, count["letter"]), count["digit"] / chars, count["punct"] / n,
        len(seen) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(seen.values()) / n, marked / n, shouted / n, np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), count["high"] / chars,
    )


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``stats`` (array of doubles, in the order of STATISTICS)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [statistics(t) for t in as_bytes(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*keep, "stats"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, docs.select(*keep).schema.add("stats", T.ArrayType(T.DoubleType())))


def _map(stats: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((stats - model["mean"]) / model["scale"], -6, 6)
    return np.hstack([np.cos(z @ model["w"] + model["b"]) * np.sqrt(2 / model["w"].shape[1]), np.ones((len(z), 1))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def normal_equations(rows: DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sums of Z'Z and Z'y over (stats, y): per partition first, then per row of the matrix."""
    width = model["w"].shape[1] + 1

    def run(batches):
        total = np.zeros((width, width + 1))
        for b in batches:
            if b.num_rows:
                z = _map(_matrix(b.column(0), len(STATISTICS)), model)
                total[:, :width] += z.T @ z
                total[:, width] += z.T @ b.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), _matrix(b.column(1), width + 1)):
                held[i] = held.get(i, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([list(v) for v in held.values()], pa.list_(pa.float64()))], ["i", "v"])

    kind = "i int, v array<double>"
    sums = rows.select("stats", "y").mapInArrow(run, kind).repartition("i").mapInArrow(add, kind)
    out = np.zeros((width, width + 1))
    for r in sums.collect():  # `width` rows
        out[r["i"]] += r["v"]
    return out[:, :width], out[:, width]


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, fitted) of a rising step function's block centres."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            z = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], z)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> dict:
    """Learn from rows whose crc32(key as text) mod 3 is not 1; ``measured`` is (key, stats)."""
    usable = labels.select(F.col(key), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1))
    rows = stored(measured.join(usable, key).withColumn("cal", F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(CALIBRATE_MOD)) == 0), "labelled")
    p = len(STATISTICS)
    sums = rows.agg(
        F.count("*").alias("n"), F.avg("y").alias("rate"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(p)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(p)],
    ).first()
    if not sums["n"] or sums["rate"] in (0.0, 1.0):
        return {"constant": 0.5 if not sums["n"] else float(sums["rate"])}
    rng = np.random.default_rng(SEED)
    model = {
        "mean": np.array([sums[f"m{i}"] for i in range(p)]), "scale": np.array([max(sums[f"s{i}"], 1e-3) for i in range(p)]),
        "w": rng.normal(0, np.sqrt(2 * GAMMA), (p, FEATURES)), "b": rng.uniform(0, 2 * np.pi, FEATURES),
    }
    zz, zy = normal_equations(rows.where("NOT cal"), model)
    reg = RIDGE * np.eye(FEATURES + 1)
    reg[-1, -1] = 1e-9
    model["beta"] = np.linalg.solve(zz + reg, zy)
    held = _raw(rows.where("cal").select("y", "stats"), model)
    lo, hi = -0.5, 1.5
    binned = held.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") - lo) / (hi - lo) * BINS))).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if binned:
        x, y = isotonic(*(np.array([float(r[c]) for r in binned]) for c in ("x", "y", "n")))
        model["knots"] = (x, np.clip(y, 0.0, 1.0))
    else:
        model["knots"] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def _raw(measured: DataFrame, model: dict, name: str = "raw", then=None) -> DataFrame:
    """Replaces ``stats``, the last column, by the ridge score, or what ``then`` makes of it; one pass through Python."""
    names = [c for c in measured.columns if c != "stats"]

    def run(batches):
        for b in batches:
            raw = _map(_matrix(b.column(b.num_columns - 1), len(STATISTICS)), model) @ model["beta"] if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(then(raw) if then else raw, pa.float64())], [*names, name])

    return measured.select(*names, "stats").mapInArrow(run, measured.select(*names).schema.add(name, "double"))


def score(measured: DataFrame, model: dict) -> DataFrame:
    """(other columns, score): calibrated, from 0 to 1."""
    if "constant" in model:
        return measured.withColumn("score", F.lit(model["constant"])).drop("stats")
    x, y = model["knots"]

    def calibrated(raw: np.ndarray) -> np.ndarray:
        # A hundredth of the score follows the ridge score, so that equal calibrated values keep an order.
        return np.round(0.99 * np.interp(raw, x, y) + 0.01 * np.clip((raw + 0.5) / 2, 0, 1), 9)

    return _raw(measured, model, "score", calibrated)


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns ``keep``, score) for every document; only the text enters a score."""
    measured = stored(measure(docs, keep=("doc_id", *keep)), "statistics")
    return score(measured, fit(measured, labels))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return got.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
