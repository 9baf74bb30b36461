"""Conversation structure repair: cheapest edits to a legal order of roles, by a suffix-shared automaton.

Every conversation becomes a signature, one symbol a turn: what its role and its first fault allow.
Signatures are read from the end: two conversations that end alike run through the same nodes of one
automaton, and what is cheapest from a node on, for each state of the role grammar ``(s?(ua)+)?``, depends
on the node alone. So signatures are sorted by their reversed symbols (range partitions, hot signatures
split by conversation), a task walks them in order, and each node is worked out once, when its suffix first
appears; only the nodes on the path at a range's border are worked out in two tasks. A node holds a cost and
an edit for each state; the edit points into the nodes below, so the best audit suffixes are shared too.

Turns are ordered by turn, null first; turns of one number by a digest of role and text. Null roles and
texts count as one space. Null conversation ids make one conversation. Empty and blank texts are faults like
any other. Equal rows are duplicates. Very long texts are looked at in generated code and travel once, to
be written out in order; a conversation of n turns takes n bytes of signature. An empty table gives an empty
result. Other columns are ignored, whatever their names. Equal texts are told by 128 bits (MD5).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.llm.common import SPACES, bounded_batches

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INF = 1 << 40
#: States of the grammar: nothing yet, after system, after user, after assistant.
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The state after a turn of the role that the grammar wants next: user, but assistant after user.
_NEXT = (2, 2, 3, 2)
_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SIGNED = "conv_id {id}, rsig string, gaps long, blank long, duplicate long, truncated long, illegal long"


def step(symbol: str, after: tuple) -> tuple:
    """Node of ``symbol`` before node ``after``: for each state the cost to go and the first edit of the least audit."""
    cost = after[0]
    kind, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    got = [(DELETE + cost[q], "D") for q in range(4)]
    if kind != "x":
        kept = _KEPT.get(kind, (None,) * 4)
        for q in range(4):
            if kept[q] is not None:
                got[q] = min(got[q], (KEEP + more + cost[kept[q]], "K"))
            got[q] = min(got[q], (REROLE + more + cost[_NEXT[q]], "R"))
    return _with_inserts(got)


def _with_inserts(got: list) -> tuple:
    # One insert leads from any state to the one that the grammar wants; a third never pays, it would come back to a state.
    two = min(got[2], (INSERT + got[3][0], "I"))
    done = [min(got[q], (INSERT + two[0], "I")) if q != 2 else two for q in range(4)]
    return tuple(c for c, _ in done), "".join(e for _, e in done)


END = _with_inserts([(0, "."), (INF, "."), (INF, "."), (0, ".")])


def audit(nodes: list, symbols: str) -> str:
    """Edits from the first turn on: ``nodes[k]`` is the node of the last k symbols, ``symbols`` is reversed."""
    at, state, edits = len(symbols), 0, []
    while True:
        edit = nodes[at][1][state]
        if edit == ".":
            return "".join(edits)
        edits.append(edit)
        if edit != "D":
            state = _KEPT[symbols[at - 1].lower()][state] if edit == "K" else _NEXT[state]
        if edit != "I":
            at -= 1


def _marked(turns: DataFrame, present: Column) -> DataFrame:
    """Every turn with its symbol's parts; rows that are not present only name their conversation."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce(present, F.lit(False)).alias("present"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return rows.withColumns({"key": key, "blank": ~F.col("text").rlike(f"[^{SPACES}]"), "cut": ~last.isin(".", "!", "?"), "initial": F.substring("role", 1, 1)})


def _sorted(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def signatures(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: rsig (symbols from the last turn to the first), gaps, and counts of faults."""
    present = F.lit(True) if present is None else present
    bounded_batches(turns.sparkSession, 10_000)
    rows = _marked(turns, present).select("conv_id", "turn", "key", "present", "blank", "cut", "initial")
    seen = Window.partitionBy("conv_id", "key", "present").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("blank"), "b").when(F.row_number().over(seen) > 1, "d").when(F.col("cut"), "t").otherwise("-")
    rows = rows.select("conv_id", "turn", "key", "present", fault.alias("fault"), "initial")

    def run(batches):
        none = object()
        held, out = none, []

        def closed():
            low, high, distinct = turn_range
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((held, "".join(reversed(symbols)), gaps, count["b"], count["d"], count["t"], illegal))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], fields[i].type) for i in range(len(fields))], schema=fields)

        fields = None
        for b in batches:
            fields = fields or pa.schema([pa.field("conv_id", b.schema.field(0).type), pa.field("rsig", pa.string()), *[pa.field(c, pa.int64()) for c in _COLUMNS[:5]]])
            for conv, turn, there, fault, initial in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if held is none or conv != held:
                    if held is not none:
                        closed()
                    held, symbols, before, illegal, count, turn_range = conv, [], None, 0, {"b": 0, "d": 0, "t": 0, "-": 0}, (None, None, 0)
                if not there:
                    continue
                count[fault] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                kind = "x" if fault in "bd" else initial if initial in ("s", "u", "a") else "o"
                symbols.append(kind.upper() if fault == "t" else kind)
                if turn is not None:
                    low, high, distinct = turn_range
                    turn_range = (turn, turn, 1) if low is None else (low, turn, distinct + (turn != high))
            if len(out) > 1000:
                yield flush()
                out = []
        if held is not none:
            closed()
            yield flush()

    return _sorted(rows, F.col("turn").asc_nulls_first(), "key").mapInArrow(run, _SIGNED.format(id=_id_type(turns)))


def audited(signed: DataFrame) -> DataFrame:
    """``signatures`` with cost and audit, each node of the automaton worked out where its suffix first appears."""
    names = [c for c in signed.columns if c != "rsig"]

    def run(batches):
        before, nodes = "", [END]
        for b in batches:
            costs, audits = [], []
            for symbols in b.column(b.num_columns - 1).to_pylist():
                same = 0
                if symbols != before:
                    for x, y in zip(symbols, before):
                        if x != y:
                            break
                        same += 1
                    del nodes[same + 1 :]
                    for y in symbols[same:]:
                        nodes.append(step(y, nodes[-1]))
                    before, edits = symbols, audit(nodes, symbols)
                elif not audits:
                    edits = audit(nodes, symbols)
                costs.append(nodes[-1][0][0])
                audits.append(edits)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*names, "cost", "audit"])

    dealt = signed.repartitionByRange("rsig", "conv_id").sortWithinPartitions("rsig", "conv_id")
    return dealt.select(*names, "rsig").mapInArrow(run, signed.select(*names).schema.add("cost", "long").add("audit", "string"))


def _edited(turns: DataFrame, present: Column | None) -> DataFrame:
    """A row without role for each conversation (its audit and counts), then its repaired turns in order."""
    present = F.lit(True) if present is None else present
    told = audited(signatures(turns, present))
    bounded_batches(turns.sparkSession)
    texts = _marked(turns, present).where("present").select("conv_id", F.lit(1).alias("part"), "turn", "key", "role", "text")
    both = told.withColumn("part", F.lit(0)).unionByName(texts, allowMissingColumns=True).select("conv_id", *_COLUMNS, "audit", "part", "turn", "key", "role", "text")
    dealt = _sorted(both, "part", F.col("turn").asc_nulls_first(), "key").drop("part", "turn", "key")

    def run(batches):
        held, edits, at, state, fields = (None, *[None] * 7), "", 0, 0, None

        def inserted():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                at, state = at + 1, _NEXT[state]
                yield (*held, "user" if state == 2 else "assistant", "")

        for b in batches:
            fields, out = b.schema, []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[8] is None:
                    out.extend(inserted())
                    held, edits, at, state = row[:8], row[7], 0, 0
                    out.append((*held, None, None))
                    continue
                out.extend(inserted())
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "K":
                    state, role = _KEPT[row[8][:1]][state], row[8]
                else:
                    state = _NEXT[state]
                    role = "user" if state == 2 else "assistant"
                out.append((*held, role, row[9]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)
        if fields is not None:
            out = list(inserted())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)

    return dealt.mapInArrow(run, dealt.schema)


def repaired(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired turns (conv_id, position from 0, role, text) of the cheapest edits."""
    rows = _edited(turns, present).where("role IS NOT NULL").select("conv_id", F.monotonically_increasing_id().alias("__at"), "role", "text")
    return rows.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("__at")) - 1).cast("long").alias("position"), "role", "text")


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: gaps, faults, cost, audit, and the hash of its repaired turns, read in order in one pass."""
    edited = _edited(turns, present)
    names = ["conv_id", *_COLUMNS, "audit"]

    def run(batches):
        held, digest, fields = None, None, None
        for b in batches:
            fields, out = pa.schema([*list(b.schema)[:8], pa.field("repaired_sha256", pa.string())]), []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[8] is None:
                    if held is not None:
                        out.append((*held, digest.hexdigest()))
                    held, digest, first = row[:8], hashlib.sha256(), True
                    continue
                digest.update(f"{'' if first else chr(10)}{row[8]}:{row[9]}".encode("utf-8", "surrogatepass"))
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*held, digest.hexdigest()), fields)], schema=fields)

    return edited.mapInArrow(run, edited.select(*names).schema.add("repaired_sha256", "string"))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The damage of the query: of each row by crc32 of ``conv_id:turn``; dropped rows stay, marked as not present."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") != 0).alias("there"), F.explode(copies).alias("copy"))
    return rows, F.col("there")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _add(cost: str, edit: str, then: str) -> str:
    """SQL: a cost of nine digits with its audit, put before another; the least text is the least cost, then the least audit."""
    return f"lpad((substr({then}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || '{edit}' || substr({then}, 10)"


def _choice(state: int) -> str:
    kept = "".join(f" WHEN '{kind}' THEN {_add('w', 'K', f'v{to[state]}')}" for kind, to in _KEPT.items() if to[state] is not None)
    changed = f"CASE WHEN y <> 'x' THEN {_add('3 + w', 'R', f'v{_NEXT[state]}')} END"
    return f"least({_add('4', 'D', f'v{state}')}, CASE y{kept} END, {changed}) AS b{state}"


CRC_SQL = """
crc AS (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS crc_table FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """crc32 of a text of ASCII characters, with ``crc`` among the tables."""
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1]), 4294967295::BIGINT))"


OP12_SQL = rf"""
WITH RECURSIVE {CRC_SQL.strip()},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE hit <> 0),
turns AS (
  SELECT *, row_number() OVER w AS n, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN initial NOT IN ('s', 'u', 'a') THEN CASE fault WHEN 't' THEN 'O' ELSE 'o' END WHEN fault = 't' THEN upper(initial) ELSE initial END, '' ORDER BY n) AS sig
  FROM turns GROUP BY conv_id),
dp AS (
  SELECT DISTINCT sig, length(sig) AS i, '000000000' AS v0, '000000006II' AS v1, '000000003I' AS v2, '000000000' AS v3 FROM told
  UNION ALL
  SELECT sig, i - 1, least(b0, {_add("3", "I", "c2")}), least(b1, {_add("3", "I", "c2")}), c2, least(b3, {_add("3", "I", "c2")})
  FROM (SELECT *, least(b2, {_add("3", "I", "b3")}) AS c2
    FROM (SELECT sig, i, {", ".join(map(_choice, range(4)))} FROM (SELECT *, lower(substr(sig, i, 1)) AS y, CASE WHEN substr(sig, i, 1) IN ('S', 'U', 'A', 'O') THEN 3 ELSE 0 END AS w FROM dp WHERE i > 0)))),
best AS (SELECT sig, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM dp WHERE i = 0),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM told JOIN best USING (sig)),
placed AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit, count(*) FILTER (substr(audit, k, 1) <> 'I') OVER w AS n, count(*) FILTER (substr(audit, k, 1) <> 'D') OVER w AS e
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
made AS (
  SELECT p.conv_id, k, e, edit, role, text, bool_or(edit = 'K' AND e = 1 AND initial = 's') OVER (PARTITION BY p.conv_id) AS system
  FROM placed p LEFT JOIN turns t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.n = t.n WHERE edit <> 'D'),
written AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM made GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN best USING (sig) LEFT JOIN written w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""
