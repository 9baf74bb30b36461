"""Quality rules: a ledger of rule failures as bits, with versioned policies and ablations.

``measure`` reads each text once and stores the measurements; ``ledger`` turns
them into one failure bit per rule; ``apply_policy`` and ``ablation`` work on the
bits alone, so another policy version never reads a text again.

Null and empty texts have no words: all measurements are 0 and ``few_words`` fails.
Repeated rows are measured each on its own. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import as_bytes, bounded_batches

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACE_BYTES = b" \t\n\r\x0b\x0c"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` (SQL over the measurements) is true; ``bit`` never changes."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeat_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)

#: Policy versions: the rules that reject. A published version is never edited.
POLICIES = {
    "base-1": ("few_words", "repeat_words"),
    "web-1": ("few_words", "repeat_words", "symbols", "dup_lines", "word_length"),
}
_POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(WINDOW, dtype=np.uint64))[::-1].copy()


def _mask(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of ``WINDOW`` words that the text has twice or more.

    Windows are compared by 64-bit hashes of the words' codes in this text.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, len(words))
    ids = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    ids = (ids ^ (ids >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    ids ^= ids >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h += ids[j : j + n] * _POWERS[j]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measure_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    continuation = len(text) - len(text.translate(None, _CONTINUATION))
    return (
        len(words),
        len(text.translate(None, _SPACE_BYTES)) - continuation,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


_CONTINUATION = bytes(range(0x80, 0xC0))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and one long column for each of ``MEASURES``."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep).schema
    for m in MEASURES:
        schema = schema.add(m, "long")

    def run(batches):
        for b in batches:
            found = [_measure_text(t) for t in as_bytes(b.column(b.num_columns - 1))]
            cols = list(zip(*found)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], [*keep, *MEASURES])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``failed_bits``: bit ``r.bit`` is set where rule r fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def rejected(policy: str, bits: str | Column = "failed_bits") -> Column:
    """True where a rule of the policy version fails."""
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(_mask(POLICIES[policy]))) != 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: failures, sole failures (kept again without the rule), and rejections overall.

    One pass over the ledger; a rule's sole failures are the rows whose masked bits equal its own bit.
    """
    mask = _mask(POLICIES[policy])
    masked = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    per = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules])).alias("r")
    return (
        masked.select("bits", "n", per)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        )
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = ledger(measure(docs))
    base = rejected("base-1")
    return found.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & ~rejected("web-1")).alias("kept"), "n_lines", "failed_bits")


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, {_words('text')} AS ws, string_split(text, chr(10)) AS ls FROM d),
m AS (
  SELECT rid, doc_id, ws, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_distinct_lines
  FROM w),
win AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM m WHERE len(ws) >= 9),
keyed AS (SELECT rid, i, md5(array_to_string(ws[i:i + 7], ' ')) AS k FROM win),
twice AS (SELECT rid, i FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (SELECT rid, count(DISTINCT i + j.j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) j GROUP BY rid),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_lines - n_distinct_lines AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, n_lines
  FROM m LEFT JOIN covered USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)::BIGINT AS failed_bits
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, failed_bits
FROM b
"""
