"""Packing token streams into windows by an order-preserving dynamic program.

Documents are taken in the order of their partition. Cuts may lie after a document
or after a sentence (a token whose string ends a sentence); where neither comes for
a whole window, after any full window. The program minimises padding plus a penalty
per cut inside a document:

    f[j] = min over i, pos[j] - pos[i] <= size, of f[i] + pad(pos[j] - pos[i]) + penalty[j]

With pad = size - length the minimum over i is a sliding-window minimum of
f[i] + pos[i], kept in a monotone queue, so the work is linear in the boundaries.
Lengths that are a power of two need no padding and are tried as extra transitions.
A partition is packed in blocks of ``BLOCK_TOKENS``, so memory does not grow with it.

Null and empty texts have one token, the end-of-document id. A text longer than a
window spans windows. An empty table gives no rows; repeated rows are packed each.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.bpe import vocabulary_path
from fairline.llm.common import as_bytes, bounded_batches, kept_in_worker

SIZE = 4096
END_ID = 2
CUT_PENALTY = 24
WINDOW_COST = 8
BLOCK_TOKENS = 1 << 20
#: Chunks in either half of a worker's memory of ids, some 25 MB; most chunks of a large corpus are rare, and workers live on through later stages.
CACHE = 1 << 17
END_BYTES = END_ID.to_bytes(4, "little")
#: ASCII characters other than letters, digits and white space; the vocabulary's pattern takes a run of them as one piece.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters by which byte-level vocabularies spell bytes that are no printable Latin-1 character.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Endings of vocabulary strings that close a sentence.
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>", "...</w>")


def small_letters(word: bytes) -> bytes | None:
    """The lower-case form of a word that is letters only and stays itself when normalised; else None."""
    if word.isalpha():
        return word.lower()
    text = word.decode()
    if word.isascii() or not text.isalpha():
        return None
    if text.lower() == text:
        return word if unicodedata.is_normalized("NFC", text) else None
    small = "".join([c.lower() for c in text])
    return small.encode() if small.isalpha() and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", small) else None


class ChunkIds:
    """Ids from the tokenizers library, kept per white-space separated chunk.

    The file's pattern drops white space, so no token crosses it; only new chunks are encoded. Words of letters
    that the file's normalizer and pattern leave whole go to the library's model directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.apart_id, token = next(iter(self.lib.get_added_tokens_decoder().items()))
        self.apart = token.content
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.model = self.lib.model
        self.whole: dict[str, bool] = {}
        self.ends = np.zeros(self.lib.get_vocab_size(True) + 1, bool)
        for name, i in self.lib.get_vocab(True).items():
            self.ends[i] = name.endswith(SENTENCE_ENDS)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, closed by END_ID."""
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        split = [text.split() for text in texts]
        self.learn(set().union(*split).difference(self.known))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, chunks)) + END_BYTES, "<u4") for chunks in split]

    def learn(self, chunks: set[bytes]) -> None:
        """Encode new chunks. A word in capitals has the ids of its small letters; closing marks add their own."""
        known, words, parts, other = self.known, set(), [], set()
        for c in self.recall(chunks):
            w = c if c.isalpha() else c.rstrip(MARKS)
            small = None if b"<|" in c else small_letters(w)
            if small is None:
                other.add(c)
            elif small == c:
                words.add(c)
            else:
                parts.append((c, small, c[len(w) :]))
        words |= self.recall({w for _, w, _ in parts}.difference(words, known))
        self.encode_words([*words])
        other |= self.recall({m for _, _, m in parts if m}.difference(other, known))
        self.encode_new([*other])
        for c, w, marks in parts:
            known[c] = known[w] + known[marks] if marks else known[w]

    def recall(self, chunks: set[bytes]) -> set[bytes]:
        """The chunks without ids; those that the older half has are taken over, so what recurs stays."""
        new = chunks.difference(self.older)
        for c in chunks.difference(new):
            self.known[c] = self.older[c]
        return new

    def stays(self, letter: str) -> bool:
        """Whether the normalizer keeps a letter and the pattern takes it as part of a word."""
        if letter not in self.whole:
            self.whole[letter] = self.lib.normalizer.normalize_str(letter) == letter and len(self.lib.pre_tokenizer.pre_tokenize_str(f"a{letter}a")) == 1
        return self.whole[letter]

    def encode_words(self, new: list[bytes]) -> None:
        """Words of small letters by the model alone, spelled in its characters for bytes."""
        known, tokenize, odd = self.known, self.model.tokenize, []
        for w in new:
            if w.isascii():
                known[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            elif all(map(self.stays, set(w.decode()))):
                known[w] = array("I", [t.id for t in tokenize(w.decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
            else:
                odd.append(w)
        self.encode_new(odd)

    def encode_new(self, new: list[bytes]) -> None:
        """Many chunks a call, set apart by an added token, which the library cuts out before all else."""
        odd = [c for c in new if b"<|" in c]
        for c, e in zip(odd, odd and self.lib.encode_batch_fast([c.decode() for c in odd], add_special_tokens=False)):
            self.known[c] = array("I", e.ids).tobytes()
        rest = [c for c in new if b"<|" not in c]
        for at in range(0, len(rest), 500):
            some = rest[at : at + 500]
            (found,) = self.lib.encode_batch_fast([self.apart.join([c.decode() for c in some])], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.apart_id).tolist()
            raw = ids.tobytes()
            for c, i, j in zip(some, [-1, *ends], [*ends, len(ids)]):
                self.known[c] = raw[4 * i + 4 : 4 * j]


def cuts(pos: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into ``pos`` (ascending boundaries, pos[0] = 0) of the best window ends."""
    n = len(pos)
    at, pen = pos.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}
    p = size >> 1
    while p:
        i = np.searchsorted(pos, pos - p)
        for j in np.flatnonzero((pos >= p) & (pos[np.minimum(i, n - 1)] == pos - p)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        p >>= 1
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        x = at[j]
        while at[queue[0]] < x - size:
            queue.popleft()
        i = queue[0]
        cost = best[i] + size - (x - at[i])
        for e in exact.get(j, ()):
            if best[e] < cost:
                cost, i = best[e], e
        best[j], back[j] = cost + pen[j] + WINDOW_COST, i
        key = best[j] + x
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(positions where a window may end, penalty of each): document ends, sentence ends, forced steps."""
    allowed = np.zeros(len(ids) + 1, np.int8)
    allowed[1:] = ends[ids]
    allowed[[0, len(ids)]] = 1
    allowed[doc_ends] = 2
    pos = np.flatnonzero(allowed)
    gap = np.flatnonzero(np.diff(pos) > size)
    for g in gap:
        allowed[np.arange(pos[g] + size, pos[g + 1], size)] = 1
    if len(gap):
        pos = np.flatnonzero(allowed)
    return pos, np.where(allowed[pos] == 2, 0, CUT_PENALTY)


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset, doc_ordinal), no shuffle.

    A sequence id is the partition number times 2**33 plus a count in the partition. The order
    is the order of rows in each partition: sort or repartition by range first for another.
    """
    bounded_batches(docs.sparkSession)
    schema = docs.select(key).schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        lib = kept_in_worker(("chunk ids", path), lambda: ChunkIds(path))
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        keys, docs_ids, total, first = [], [], 0, 0

        def close(last: bool):
            """Pack what is held; unless it is the last block, the last window stays for the next."""
            nonlocal sequence, keys, docs_ids, total, first
            ids = np.concatenate(docs_ids)
            ends = np.cumsum([len(d) for d in docs_ids])
            begins = ends - [len(d) for d in docs_ids]
            pos, pen = boundaries(ids, ends, lib.ends, size)
            at = [0, *pos[cuts(pos, pen, size)].tolist()]
            if not last and len(at) > 2:
                at.pop()
            rows = [[] for _ in range(7)]
            d = 0
            for lo, hi in zip(at, at[1:]):
                while d < len(ends) and begins[d] < hi:
                    a, z = max(lo, int(begins[d])), min(hi, int(ends[d]))
                    skipped = first if d == 0 else 0
                    for c, v in zip(rows, (keys[d], a - int(begins[d]) + skipped, z - a, ids[a:z].tobytes(), len(docs_ids[d]) + skipped, sequence, a - lo)):
                        c.append(v)
                    if ends[d] > hi:
                        break
                    d += 1
                sequence += 1
            cut = at[-1]
            if d < len(ends):
                first = cut - int(begins[d]) + (first if d == 0 else 0)
                keys, docs_ids = keys[d:], [docs_ids[d][cut - int(begins[d]) :], *docs_ids[d + 1 :]]
            else:
                keys, docs_ids, first = [], [], 0
            total = len(ids) - cut
            return rows

        for b in batches:
            names = b.column(0).to_pylist()
            texts = as_bytes(b.column(1))
            for at in range(0, len(texts), 256):
                for name, ids in zip(names[at : at + 256], lib.encode(texts[at : at + 256])):
                    keys.append(name)
                    docs_ids.append(ids)
                    total += len(ids)
                if total >= BLOCK_TOKENS:
                    yield batch(close(False), b.schema.field(0).type)
        if docs_ids:
            yield batch(close(True), b.schema.field(0).type)

    def batch(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [kind, *kinds])], schema.names)

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def pieces(docs: DataFrame) -> DataFrame:
    packed = pack(docs, vocabulary_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
