"""License scans by MinHash bands over overlapping text windows, with DataFrame functions only.

Templates and texts are lower-cased, stripped of punctuation and cut into five-word shingles. A
template of one to four words is one shingle of as many words, looked for among the text's
shingles of that length, so it is found inside longer texts too. For each template size m (in
shingles) a text's windows hold 2m - 1 shingles and start every m, so any whole occurrence lies in
a window and makes at least half of it. Each of ``BANDS`` bands is one MinHash value: a window
that holds the whole template meets it with probability over 1 - 2**-BANDS, one that holds 0.8 of
it with over 0.999. Templates of one shingle have one band: their windows hold one shingle as
well, and equal sets always meet. Windows that meet a template are verified by the exact share of
its shingles they contain.

Any number of templates is taken. They are cut, by words of a shingle and then by size, into blocks
of ``BLOCK`` shingles (a longer template is a block of its own), and each block is one scan of the
documents, so what a plan holds and broadcasts has that bound. Only texts that share a shingle with
a block's templates of some size can meet one of them in a band; the others are dropped by that
exact test before windows of the size are made.

Null, empty and blank texts match nothing; very long texts are scanned whole, as one row each.
Repeated rows and rows with one doc_id are reported together; a null doc_id is reported as null.
Templates of one name are one license; a template without words is never found. Only key and text
are read, whatever other columns are named. An empty table, or no template, gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import let

SHINGLE = 5
BANDS = 16
THRESHOLD = 0.8
#: Shingles of the templates that one scan of the documents looks for.
BLOCK = 20_000
PUNCTUATION = ".,;:!?\"'()[]"

#: Public license notices to look for.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` words, in order; none where there are fewer words."""

    def of(w):
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, runs).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def _band_values(shingles: Column, bands: int = BANDS) -> list[Column]:
    def least(j):
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(j))))

    return [least(j) for j in range(bands)]


def _longs(values) -> Column:
    """An array of longs as one literal."""
    return F.split(F.lit(",".join(map(str, sorted(values)))), ",").cast("array<bigint>")


def blocks(known: list[tuple[int, str, list[int]]], shingles: int = BLOCK) -> list[list[tuple[int, str, list[int]]]]:
    """(width, license, shingles) rows in blocks of one width and at most ``shingles`` shingles, or of one row; similar sizes come together."""
    out, held = [], 0
    for row in sorted(known, key=lambda r: (-r[0], len(r[2]), r[1], r[2])):
        if not out or out[-1][0][0] != row[0] or held + len(row[2]) > shingles:
            out.append([])
            held = 0
        out[-1].append(row)
        held += len(row[2])
    return out


def _met(docs: DataFrame, block: list, text: str, key: str, threshold: float) -> DataFrame:
    """(key, license, at, share) of the windows that hold a block's templates."""
    width = block[0][0]
    sizes = {}
    for _, _, t in block:
        sizes.setdefault(len(t), set()).update(t)
    known = docs.sparkSession.createDataFrame([(name, t) for _, name, t in block], "license string, t array<bigint>")
    values = F.when(F.size("t") == 1, F.array(*_band_values(F.col("t"), 1))).otherwise(F.array(*_band_values(F.col("t"))))
    bands = known.select("license", "t", F.posexplode(values).alias("band", "value"))

    s = docs.select(key, _shingles(_words(F.coalesce(F.col(text), F.lit(""))), width).alias("s"))
    s = s.where(F.arrays_overlap("s", _longs(set().union(*sizes.values()))))
    mine = [F.when(F.arrays_overlap("s", _longs(t)), F.lit(m)) for m, t in sorted(sizes.items())]
    size = F.explode(F.array_compact(F.array(*mine))).alias("m")
    starts = F.explode(F.sequence(F.lit(1), F.size("s"), F.col("m"))).alias("at")
    windows = s.select(key, "s", size).select(key, "s", "m", starts).select(key, "m", "at", F.slice("s", F.col("at"), F.col("m") * 2 - 1).alias("w"))
    values = F.when(F.col("m") == 1, F.array(*_band_values(F.col("w"), 1))).otherwise(F.array(*_band_values(F.col("w"))))
    keyed = windows.select(key, "m", "at", "w", F.posexplode(values).alias("band", "value"))
    # a block's shingles, BANDS times
    found = keyed.join(F.broadcast(bands), ["band", "value"]).where(F.size("t") == F.col("m"))
    share = F.size(F.array_intersect("w", "t")) / F.size(F.array_distinct("t"))
    return found.select(key, "license", "at", share.alias("share")).where(F.col("share") >= threshold)


def scan(docs: DataFrame, templates=TEMPLATES, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(key, license, n_windows, containment): one row per document and template found in it."""
    given = docs.sparkSession.createDataFrame(list(templates), "license string, template string").select("license", _words(F.col("template")).alias("w"))
    width = F.least(F.size("w"), F.lit(SHINGLE))
    cut = F.when(width == SHINGLE, _shingles(F.col("w")))
    for k in range(1, SHINGLE):
        cut = cut.when(width == k, _shingles(F.col("w"), k))
    known = [(r["width"], r["license"], r["t"]) for r in given.where(F.size("w") > 0).select("license", width.alias("width"), cut.alias("t")).collect()]  # the caller's list
    if not known:
        return docs.select(key, F.lit("").alias("license"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("containment")).limit(0)
    # Windows are told apart by where they start and by their words a shingle.
    verified = reduce(DataFrame.unionByName, [_met(docs, b, text, key, threshold).withColumn("width", F.lit(b[0][0])) for b in blocks(known, block)])
    per_window = verified.groupBy(key, "license", "width", "at").agg(F.max("share").alias("share"))
    return per_window.groupBy(key, "license").agg(F.count("*").alias("n_windows"), F.max("share").alias("containment"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op8_sql() -> str:
    clean = "regexp_extract_all(translate(lower(coalesce({}, '')), '.,;:!?\"''()[]', ''), '[^\\x20\\x09-\\x0D]+')"
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    return f"""
WITH t AS (SELECT license, {clean.format("template")} AS w FROM (VALUES {values}) v(license, template)),
ts AS (SELECT license, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM t),
d AS (SELECT doc_id, {clean.format("text")} AS w FROM documents),
ds AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM d WHERE len(w) >= 5),
hit AS (SELECT doc_id, ds.s, license, ts.s AS t FROM ds, ts WHERE list_has_any(ds.s, ts.s)),
win AS (
  SELECT doc_id, license, t, list_slice(s, p, p + 2 * len(t) - 2) AS w
  FROM (SELECT *, unnest(range(1, len(s) + 1, len(t))) AS p FROM hit)),
share AS (SELECT doc_id, license, len(list_intersect(list_distinct(w), list_distinct(t)))::DOUBLE / len(list_distinct(t)) AS share FROM win)
SELECT doc_id, license, count(*) AS n_windows, max(share) AS containment
FROM share WHERE share >= 0.8 GROUP BY doc_id, license
"""


OP8_SQL = _op8_sql()
