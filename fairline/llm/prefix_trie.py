"""Conversation prefix trie: what conversations share from their first turn on.

Each prefix of a conversation has a chained digest. A count-min sketch of all prefix digests (two rows of
saturating cells; a cell only has to tell one from more) screens them: an estimate never falls below the
truth, so an estimate of one proves a prefix that no other conversation has. From there on a conversation is
alone: its tail is emitted where it lies and its digests never travel. Only prefixes before that point are
grouped exactly. A node belongs to its smallest member; that member then owns every deeper prefix of its own
up to its end, so the trie falls into one chain for each owner, and sums over subtrees are sums along a chain
plus what the heads of other chains bring to each of their own prefixes.

The sketch holds at most ``MAX_CELLS`` cells a row (two million bytes are broadcast at most); beyond that it
proves fewer singletons and more prefixes are grouped, with the same result. Hot prefixes are counted in two
steps; owners of parents with over a thousandth of all heads (at most a thousand rows) are broadcast, so that
no join gathers the children of a hot node; ids that end at one node are joined in chunks.

Turns are ordered by turn, null first; turns of one number by a digest of role and text. Null roles and
texts are empty. Rows without conv_id form no conversation. Equal rows are turns of their own. Texts of any
length are only read to be digested; a conversation of n turns takes 24 n bytes in one row. An empty table
has no nodes, not even a root. Other columns are ignored, whatever their names. Equality is by 128 bits (MD5).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.llm.common import bounded_batches, discard, stored
from fairline.llm.repair import CRC_SQL, crc_sql

MAX_CELLS = 1 << 23
CELLS_PER_PREFIX = 8
BLOCK = 4096
#: Share of all chain heads above which a parent's owner is broadcast: at most this many parents.
HOT_PARENTS = 1000
ENDS_PER_CHUNK = 1000
ROOT = hashlib.md5(b"").digest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, key, size): a digest and the UTF-8 bytes of every turn; texts stay behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "key", "size")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, n, path, sizes) of (conv_id, part, pos, key, size): chained digests from the root on.

    Rows of part -1 name the conversations that exist; rows of others are left out.
    """

    def run(batches):
        held, there, out, fields = None, False, [], None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)

        for b in batches:
            fields = pa.schema([pa.field("conv_id", b.schema.field(0).type), pa.field("n", pa.int64()), pa.field("path", pa.list_(pa.binary())), pa.field("sizes", pa.list_(pa.int64()))])
            for conv, part, key, size in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "key", "size"))):
                if conv != held:
                    if there:
                        out.append((held, len(path) - 1, path, sizes))
                    held, there, path, sizes = conv, part < 0, [ROOT], [0]
                if there and part >= 0:
                    path.append(hashlib.md5(path[-1] + key).digest())
                    sizes.append(size)
            if len(out) > 500:
                yield flush()
                out = []
        if there:
            out.append((held, len(path) - 1, path, sizes))
        if fields is not None:
            yield flush()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return dealt.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n long, path array<binary>, sizes array<long>")


def _cells(digests: pa.Array, cells: int) -> list[np.ndarray]:
    two = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    return [(two[:, r] & np.uint64(cells - 1)).astype(np.int64) for r in (0, 1)]


def sketch(held: DataFrame) -> list[np.ndarray]:
    """For each row of the count-min sketch, one bit a cell: whether it counted more than one."""
    total = held.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    cells = BLOCK
    while cells < min(MAX_CELLS, CELLS_PER_PREFIX * total):
        cells *= 2

    def count(batches):
        rows = np.zeros((2, cells), np.uint8)
        for b in batches:
            for row, at in zip(rows, _cells(b.column(0).flatten(), cells)):
                which, n = np.unique(at, return_counts=True)
                row[which] = np.minimum(2, row[which] + np.minimum(n, 2))
        blocks = rows.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c, np.uint8)
                sums[i] = np.minimum(2, sums[i] + c) if i in sums else c
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.packbits(c > 1).tobytes() for c in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block long, counts binary"
    merged = held.select("path").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind)
    bits = np.zeros((2 * cells // BLOCK, BLOCK // 8), np.uint8)
    for r in merged.collect():  # at most 2 * MAX_CELLS / 8 bytes, whatever the input
        bits[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return list(bits.reshape(2, -1))


def screened(held: DataFrame) -> DataFrame:
    """(conv_id, n, alone, path, sizes): the depth from which a conversation is proven alone (n + 1: nowhere), and only the prefixes before."""
    rows = sketch(held)
    told, cells = held.sparkSession.sparkContext.broadcast(rows), len(rows[0]) * 8

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            many = np.ones(len(flat), bool)
            for row, at in zip(told.value, _cells(flat, cells)):
                many &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            alone, start = [], 0
            for end in ends:
                first = np.flatnonzero(~many[start:end])
                alone.append(int(first[0]) if len(first) else int(end - start))
                start = end
            path = [p[:k] for p, k in zip(lists.to_pylist(), alone)]
            sizes = [p[:k] for p, k in zip(b.column(3).to_pylist(), alone)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alone, pa.int64()), pa.array(path, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], ["conv_id", "n", "alone", "path", "sizes"])

    kind = held.schema["conv_id"].dataType.simpleString()
    return held.select("conv_id", "n", "path", "sizes").mapInArrow(run, f"conv_id {kind}, n long, alone long, path array<binary>, sizes array<long>")


def ends(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (digest, conv_id): the hash of the ids in order, joined by commas.

    Ranges of (digest, id) first join runs of ids to chunks; only chunks are gathered by digest.
    """

    def chunk(batches):
        held, out = None, []
        for b in batches:
            for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held is None or digest != held[0] or len(held[2]) >= ENDS_PER_CHUNK:
                    if held is not None:
                        out.append((held[0], held[1], ",".join(held[2])))
                    held = (digest, conv, [])
                held[2].append(str(conv))
        if held is not None:
            out.append((held[0], held[1], ",".join(held[2])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])

    def join(batches):
        held, out = None, []
        for b in batches:
            for digest, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if held is None or digest != held[0]:
                    if held is not None:
                        out.append((held[0], held[1].hexdigest()))
                    held = (digest, hashlib.sha256(ids.encode()))
                else:
                    held[1].update(b"," + ids.encode())
        if held is not None:
            out.append((held[0], held[1].hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["digest", "ends_sha256"])

    dealt = rows.select("digest", F.col("conv_id").cast("long").alias("conv_id")).repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    chunks = dealt.mapInArrow(chunk, "digest binary, first long, ids string").repartition("digest").sortWithinPartitions("digest", "first")
    return chunks.mapInArrow(join, "digest binary, ends_sha256 string")


def _sha(value) -> Column:
    return F.sha2(F.lit(value) if isinstance(value, str) else value, 256)


def trie(turns: DataFrame) -> DataFrame:
    """The nodes (columns ``NODE``) of (conv_id, part, pos, key, size), as ``paths`` reads it."""
    bounded_batches(turns.sparkSession)
    whole = stored(paths(turns), "prefix-paths")
    convs = stored(screened(whole), "prefix-screened")
    discard(whole)
    shared = convs.select("conv_id", F.posexplode(F.arrays_zip("path", "sizes")).alias("depth", "at")).select(F.col("at.path").alias("digest"), "conv_id", F.col("depth").cast("long").alias("depth"), F.col("at.sizes").alias("size"))
    groups = stored(shared.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("size").alias("size")), "prefix-groups")

    saves = (F.col("n_convs") - 1) * F.col("size")
    chains = groups.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("head"), F.sum(saves).alias("saved"))
    owners = convs.join(chains, "conv_id", "left").withColumns({"head": F.coalesce("head", "alone"), "saved": F.coalesce("saved", F.lit(0))}).where("head <= n")
    owners = stored(owners.withColumn("parent", F.when(F.col("head") > 0, F.get("path", (F.col("head") - 1).cast("int")))), "prefix-owners")
    heads = stored(owners.where("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("heads")), "prefix-heads")

    # A chain's last node is a leaf unless a head of another chain hangs on it; a proven tail always ends in a leaf.
    last = owners.select("conv_id", "n", "alone", "head", "saved", "path", "parent", F.when(F.col("alone") > F.col("n"), F.get("path", F.col("n").cast("int"))).alias("digest"))
    last = last.join(heads, "digest", "left").withColumn("leaf", F.when(F.col("heads").isNull(), 1).otherwise(0)).drop("digest", "heads")

    # Owners of parents: of hot parents (at most HOT_PARENTS of them) by broadcast, of the others by a shuffled join.
    parents = heads.join(groups.select("digest", "owner"), "digest").select(F.col("digest").alias("parent"), "owner", "heads")
    bound = F.greatest(F.lit(1000), F.lit((heads.agg(F.sum("heads")).first()[0] or 0) // HOT_PARENTS))
    hot = parents.where(F.col("heads") > bound).select("parent", F.col("owner").alias("hot_owner"))
    placed = last.join(F.broadcast(hot), "parent", "left")
    cold = parents.where(F.col("heads") <= bound).select(F.col("parent").alias("cold_parent"), F.col("owner").alias("cold_owner"))
    cold_key = F.when(F.col("hot_owner").isNull(), F.col("parent"))
    # Rows without a parent to look up are dealt over negative conversation ids of their own, not gathered at null.
    placed = placed.withColumn("__key", F.coalesce(cold_key, F.concat(F.lit("-"), F.col("conv_id").cast("string")).cast("binary")))
    placed = placed.join(cold, F.col("__key") == F.col("cold_parent"), "left").withColumn("parent_conv_id", F.coalesce("hot_owner", "cold_owner"))
    placed = stored(placed.select("conv_id", "n", "alone", "head", "saved", "leaf", "parent_conv_id", "path"), "prefix-chains")

    above = placed.where("head > 0 AND (leaf > 0 OR saved > 0)").select(F.explode(F.slice("path", F.lit(1), F.col("head").cast("int"))).alias("digest"), "leaf", "saved")
    brought = above.groupBy("digest").agg(F.sum("leaf").alias("leaves_below"), F.sum("saved").alias("saved_below"))
    ended = ends(convs.where("alone > n").select(F.get("path", F.col("n").cast("int")).alias("digest"), "conv_id"))

    below = Window.partitionBy("owner").orderBy(F.col("depth").desc())
    nodes = groups.withColumn("along", F.sum(saves).over(below)).join(placed.drop("path", "saved").withColumnRenamed("conv_id", "owner"), "owner")
    nodes = nodes.join(brought, "digest", "left").join(heads, "digest", "left").join(ended, "digest", "left")
    none = F.lit(0)
    kept = nodes.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("head"), F.col("owner")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("heads", none) + F.when(F.col("depth") < F.col("n"), 1).otherwise(0)).alias("n_children"), (F.col("leaf") + F.coalesce("leaves_below", none)).alias("n_leaves"),
        (F.col("along") + F.coalesce("saved_below", none)).alias("saved_tokens"), F.coalesce("ends_sha256", _sha("")).alias("ends_sha256"),
    )
    tails = placed.where("alone <= n").select("conv_id", "n", "head", "parent_conv_id", F.explode(F.sequence("alone", "n")).alias("depth"))
    end = F.col("depth") == F.col("n")
    tails = tails.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), F.lit(1).alias("n_convs"),
        F.when(end, 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.when(end, _sha(F.col("conv_id").cast("string"))).otherwise(_sha("")).alias("ends_sha256"),
    )
    kinds = [F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in NODE]
    return kept.select(*kinds).unionByName(tails.select(*kinds))


def whole(turns: DataFrame) -> DataFrame:
    """Input of ``trie``: every conversation as it is."""
    rows = digested(turns).select("conv_id", F.lit(1).alias("part"), "pos", "key", "size")
    return rows.unionByName(rows.where("pos = 1").withColumns({"part": F.lit(-1), "pos": F.lit(0).cast("long")}))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Input of ``trie``: the first h turns of conversation c - c % 5, then c's own turns after its first h."""
    rows = digested(turns)
    row = "struct({} AS conv_id, {} AS part, {} AS pos, key, size)"
    h = "crc32(cast(cast({} AS string) AS binary)) % 9"
    near = "filter(transform(sequence(-4, 4), k -> try_add(conv_id, cast(k AS bigint))), c -> c - c % 5 = conv_id AND " + h.format("c") + " >= pos)"
    own = f"filter(array({row.format('conv_id', '1', 'pos')}), x -> pos > {h.format('conv_id')})"
    name = f"filter(array({row.format('conv_id', '-1', 'cast(0 AS bigint)')}), x -> pos = 1)"
    base = f"CASE WHEN conv_id % 5 = 0 AND pos <= 8 THEN transform({near}, c -> {row.format('c', '0', 'pos')}) ELSE array() END"
    return rows.select(F.expr("conv_id").cast("long").alias("conv_id"), "pos", "key", "size").select(F.explode(F.expr(f"concat({own}, {name}, {base})")).alias("r")).select("r.*")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = f"""
WITH {CRC_SQL.strip()},
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE pos <= h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE pos > h),
members AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS key, strlen(text) AS size FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs),
longest AS (SELECT conv_id, max(depth) AS n FROM members GROUP BY 1),
nodes AS (
  SELECT key, min(m.conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM members m JOIN longest USING (conv_id) GROUP BY key),
children AS (SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT m.key, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM nodes v LEFT JOIN children c USING (key) JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.key)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below USING (key) LEFT JOIN children c USING (key) LEFT JOIN nodes p ON v.depth > 0 AND p.key = substr(v.key, 1, length(v.key) - 32)
"""
