"""BPE encoding and decoding with a priority queue over a linked symbol list.

A word's symbols form a doubly linked list; a heap holds (rank, position) of
every adjacent pair that has a merge. A popped entry is stale, and skipped, when
its left symbol is gone or its pair has changed since. Decoding concatenates the
vocabulary strings (separated by spaces where the file names no decoder).

White space never lies inside a symbol, so results are kept per white-space
separated chunk in a bounded table of each worker, and per word inside that.

Null and empty texts give no ids and an empty decoded text. Repeated rows and
ties (equal ranks) are resolved left to right, as in the library.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import as_bytes, bounded_batches, kept_in_worker

VOCABULARY = "word_bpe_49k.json"
CACHE = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Encoder and decoder for a tokenizers BPE file with word ends and byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.added.items()}
        self.bytes_of = {i: s.encode() for i, s in self.names.items()}
        suffix = spec["model"]["end_of_word_suffix"]
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = [vocab[alphabet[b]] for b in range(256)]
        self.last = [vocab[alphabet[b] + suffix] for b in range(256)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace("\\s", "\\p{White_Space}"), regex.V0).findall
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the symbols of one word by rank, lowest first, then leftmost."""
        n = len(symbols)
        merges, ids = self.merges, symbols[:]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = merges.get(ids[i] << 20 | ids[i + 1])
            if m:
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n:
                continue
            m = merges.get(ids[i] << 20 | ids[j])
            if m is None or m[1] != new or m[0] != rank:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(new << 20 | ids[k]):
                    heapq.heappush(heap, (m[0], i, m[1]))
            p = before[i]
            if p >= 0 and (m := merges.get(ids[p] << 20 | new)):
                heapq.heappush(heap, (m[0], p, m[1]))
        return [x for x in ids if x >= 0]

    def word(self, piece: str) -> list[int]:
        found = self.words.get(piece)
        if found is None:
            raw = piece.encode()
            found = self.merge([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]])
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[piece] = found
        return found

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text; added tokens are cut out first, then the rest is normalised."""
        out: list[int] = []
        for part in self.special(chunk):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                if not part.isascii():
                    part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                else:
                    part = part.lower()
                for piece in self.pieces(part):
                    out += self.word(piece)
        return out

    def chunk(self, raw: bytes) -> tuple[bytes, bytes]:
        """(ids as 32-bit integers, vocabulary strings) of a chunk without ASCII white space."""
        found = self.chunks.get(raw)
        if found is None:
            ids = self.encode_chunk(raw.decode())
            found = (array("I", ids).tobytes(), b" ".join([self.bytes_of[i] for i in ids]))
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[raw] = found
        return found

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """(little-endian unsigned 32-bit ids, decoded text) of a UTF-8 text."""
        got = [self.chunk(w) for w in text.split()]
        return b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[0]])

    def decode(self, ids: bytes) -> bytes:
        return b" ".join([self.bytes_of[i] for i in memoryview(ids).cast("I")])


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (string) to ``keep``."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("ids", "binary").add("decoded", "string")

    def run(batches):
        bpe = kept_in_worker(("bpe", path), lambda: Bpe(path))
        for b in batches:
            found = [bpe.encode(t) for t in as_bytes(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()).cast(pa.string())], [*keep, "ids", "decoded"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = encode(docs, vocabulary_path())
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
