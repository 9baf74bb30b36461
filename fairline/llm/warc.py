"""WARC records in ZIP-packaged archives, written and read back by ranges.

Each archive is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip member
per record) and ``indexes/index.cdxj`` (one line per record: key, offset, length). The reader
parses the end-of-central-directory record, its ZIP64 form and locator, the central directory
and the local headers, finds both stored members, and reads each record by its byte range;
nothing is extracted.

Of records with equal payloads the one with the largest page_id is the response, the others
are revisits that refer to it and carry no payload. Null html is an empty payload and takes
part. A null page_id sorts before every other. Two rows with one page_id and one payload: each
gets its record, both of the same type. An empty table gives no archive and no rows.

Tasks write archives under a name of their own and rename them when whole, so a lost or
repeated task leaves no half archive; readers take only archives that the manifest lists.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import bounded_batches, shared_dir, stored

#: Fixed values of the ZIP format: signatures and the marks that send a reader to ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_ID = 1
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 16 << 20
MIN_PAYLOAD = 0


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One gzip-compressed WARC record."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if url and "\n" not in url and "\r" not in url:
        head.append(f"WARC-Target-URI: {url}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a gzip-compressed record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with stored members; ``zip64`` forces the long forms that sizes over 4 GB need."""
    out, central = io.BytesIO(), []
    for name, data in members:
        at, raw, crc, size = out.tell(), name.encode(), zlib.crc32(data), len(data)
        big = zip64 or size >= FULL32 or at >= FULL32
        short = FULL32 if big else size
        extra = struct.pack("<HHQQ", ZIP64_ID, 16, size, size) if big else b""
        out.write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra + data)
        extra = struct.pack("<HHQQQ", ZIP64_ID, 24, size, size, at) if big else b""
        central.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, FULL32 if big else at) + raw + extra)
    at, body = out.tell(), b"".join(central)
    out.write(body)
    big = zip64 or at >= FULL32 or len(central) >= FULL16
    if big:
        out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(central), len(central), len(body), at) + LOCATOR64 + struct.pack("<IQI", 0, at + len(body), 1))
    n = FULL16 if big else len(central)
    out.write(END + struct.pack("<HHHHIIH", 0, 0, n, n, len(body), FULL32 if big else at, 0))
    return out.getvalue()


def members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the data, stored size, method), from the directories of a ZIP file.

    ``file`` needs ``read_at(bytes, offset)``; only directories and local headers are read.
    """
    tail_at = max(0, size - (1 << 16) - 22)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, at, _ = struct.unpack("<HHHHIIH", tail[end + 4 : end + 22])
    if count == FULL16 or length == FULL32 or at == FULL32:
        locator = file.read_at(20, tail_at + end - 20)
        if locator[:4] == LOCATOR64:
            (end64,) = struct.unpack("<Q", locator[8:16])
            big = file.read_at(56, end64)
            if big[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, at = struct.unpack("<QQQ", big[32:56])
    directory, p, found = file.read_at(length, at), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, n, m, k, start = (*struct.unpack("<H", directory[p + 10 : p + 12]), *struct.unpack("<IIHHH", directory[p + 20 : p + 34]), *struct.unpack("<I", directory[p + 42 : p + 46]))
        name, extra = directory[p + 46 : p + 46 + n].decode(), directory[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            kind, length_of = struct.unpack("<HH", extra[:4])
            if kind == ZIP64_ID:
                longs = iter(struct.unpack(f"<{length_of // 8}Q", extra[4 : 4 + length_of // 8 * 8]))
                full = next(longs) if full == FULL32 else full
                packed = next(longs) if packed == FULL32 else packed
                start = next(longs) if start == FULL32 else start
            extra = extra[4 + length_of :]
        local = file.read_at(30, start)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        a, b = struct.unpack("<HH", local[26:30])
        found[name] = (start + 30 + a + b, packed, method)
        p += 46 + n + m + k
    return found


class Ranges:
    """Random reads of a file in any file system that pyarrow opens by URI."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read_at(self, n: int, offset: int) -> bytes:
        return self.file.read_at(n, offset)


def read_archive(uri: str):
    """(header fields, block) of every record that the archive's index lists, range by range."""
    source = Ranges(uri)
    found = members(source, source.size)
    for name in (DATA, INDEX):
        if found[name][2] != 0:
            raise ValueError(f"{name} is not stored")
    at, size, _ = found[INDEX]
    base = found[DATA][0]
    for line in source.read_at(size, at).splitlines():
        entry = json.loads(line.partition(b" ")[2])
        yield parse_record(source.read_at(entry["length"], base + entry["offset"]))


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): revisits refer to the largest page_id of their payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    shared = rows.select("page_id", "digest", "size").where(F.col("size") >= MIN_PAYLOAD).groupBy("digest", "size").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    named = rows.join(shared.withColumnsRenamed({"digest": "__d", "size": "__s"}), (F.col("digest") == F.col("__d")) & (F.col("size") == F.col("__s")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))
    return named.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "size", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ZIP-packaged archives under ``folder`` (a URI); returns the stored manifest (uri, records)."""
    bounded_batches(rows.sparkSession, 500)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        data, index, at, done = [], [], 0, []

        def close():
            nonlocal data, index, at
            name = f"part-{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{root}/{name}.writing") as f:
                f.write(zip_stored([(DATA, b"".join(data)), (INDEX, b"".join(index))]))
            fs.move(f"{root}/{name}.writing", f"{root}/{name}")
            done.append((f"{folder}/{name}", len(data)))
            data, index, at = [], [], 0

        for b in batches:
            for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                raw = record(page_id, url, payload or b"", base32, refers_to, size)
                index.append(f"{'' if page_id is None else page_id} {json.dumps({'offset': at, 'length': len(raw)})}\n".encode())
                data.append(raw)
                at += len(raw)
                if at >= archive_bytes:
                    close()
        if data:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["uri", "records"])

    return stored(rows.mapInArrow(run, "uri string, records long"), "manifest")


def _id(urn: str | None) -> int | None:
    text = (urn or "")[len("<urn:x-page:") : -1]
    return int(text) if text else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; one archive at a time."""

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for fields, block in read_archive(uri):
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = len(block) if kind == "response" else int(fields["warc-payload-length"])
                    if kind == "response" and sha1_base32(block) != digest:
                        raise ValueError(f"{uri}: a payload does not match its digest")
                    rows.append((_id(fields["warc-record-id"]), size, digest, kind, _id(fields.get("warc-refers-to"))))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(with_references(pages), folder if "://" in folder else f"file://{folder.removeprefix('file:')}"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
x AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, count(*) OVER (PARTITION BY h) AS n FROM d),
b AS (
  SELECT *, list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_reduce(list_transform(range(i * 5, i * 5 + 5), lambda k: (((strpos('0123456789abcdef', substr(h, 1 + k // 4, 1)) - 1) >> (3 - k % 4)) & 1)::BIGINT), lambda a, c: a * 2 + c)::INT, 1)) AS letters
  FROM x)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
