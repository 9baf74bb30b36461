"""Conversation operators and toxicity against brute force, on rows with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import pytest

from fairline.llm import prefix_trie, repair, toxicity

TURNS = "conv_id long, turn long, role string, text string, depth int, cost string, n int"


def _turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


def _cheapest(symbols: str) -> tuple[int, str]:
    """Least (cost, audit) of a signature in order, by search over positions and grammar states."""
    heap, seen = [(0, "", 0, 0)], {}
    best = None
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if best and (cost, edits) > best:
            continue
        if (at, state) in seen and seen[at, state] < (cost, edits) and cost > seen[at, state][0] + 12:
            continue
        seen.setdefault((at, state), (cost, edits))
        if at == len(symbols) and state in (0, 3):
            best = min(best or (cost, edits), (cost, edits))
        want = "a" if state == 2 else "u"
        after = {"u": 2, "a": 3}[want]
        if len(edits) < len(symbols) + 4:
            heapq.heappush(heap, (cost + 3, edits + "I", at, after))
        if at < len(symbols):
            y = symbols[at]
            more = 3 if y.isupper() else 0
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state))
            if y != "x":
                heapq.heappush(heap, (cost + 3 + more, edits + "R", at + 1, after))
                if y.lower() == want or (y.lower() == "s" and state == 0):
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, 1 if y.lower() == "s" else after))
    return best


def test_every_short_signature_gets_its_least_audit():
    for n in range(4):
        for symbols in itertools.product("suaoxSUAO", repeat=n):
            nodes = [repair.END]
            for y in reversed(symbols):
                nodes.append(repair.step(y, nodes[-1]))
            assert (nodes[-1][0][0], repair.audit(nodes, "".join(reversed(symbols)))) == _cheapest("".join(symbols)), symbols


def _repaired(rows):
    """Brute force of ``repair`` on rows in order: (gaps, blank, duplicate, truncated, illegal, cost, audit, turns)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    seen, symbols, count = set(), "", {"b": 0, "d": 0, "t": 0}
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        kind = "x" if fault in ("b", "d") else role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += kind.upper() if fault == "t" else kind
        if fault:
            count[fault] += 1
    cost, edits = _cheapest(symbols)
    out, left, state = [], list(rows), 0
    for e in edits:
        row = left.pop(0) if e != "I" else None
        if e == "D":
            continue
        want = "assistant" if state == 2 else "user"
        if e == "K":
            state = 1 if row[2][:1] == "s" else 2 if row[2][:1] == "u" else 3
        else:
            state = 3 if state == 2 else 2
        out.append((row[2] if e == "K" else want, row[3] if row else ""))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return gaps, count["b"], count["d"], count["t"], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, out


def _random_turns(seed, convs=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why", "", " \t\n", "Yes.", None, "Well? \n", "long words " * 50, "ö."]
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rng.randrange(9)):
            rows.append((c, rng.choice([t, t, t + 2, None]), rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


def test_repair_equals_brute_force(spark):
    rows = _random_turns(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(_turns(spark, rows)).collect()}
    written = repair.repaired(_turns(spark, rows)).collect()
    for conv in {r[0] for r in rows}:
        plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        *want, turns = _repaired(plain)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        assert got[conv] == (*want, digest), conv
        assert [(r["role"], r["text"]) for r in sorted((w for w in written if w["conv_id"] == conv), key=lambda w: w["position"])] == turns
    assert len(got) == len({r[0] for r in rows})


def test_damage_and_conversations_left_without_rows(spark):
    dropped = [(c, 0, "user", "Gone.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repair.repair(*repair.damaged(_turns(spark, dropped))).collect()
    assert len(got) == len(dropped) > 5
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)
    assert repair.repair(_turns(spark, [])).collect() == []


def _trie(convs: dict):
    """Nodes of {conv_id: [(role, text), ...]} by enumeration."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _ordered(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: [(r, x) for _, r, x in sorted(v, key=key)] for c, v in convs.items()}


@pytest.mark.parametrize("cells", [prefix_trie.MAX_CELLS, prefix_trie.BLOCK])
def test_trie_equals_enumeration(spark, monkeypatch, cells):
    """With room for every prefix and with a full sketch, which proves few singletons."""
    monkeypatch.setattr(prefix_trie, "MAX_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "ENDS_PER_CHUNK", 3)
    rng = random.Random(5)
    rows = _random_turns(4, 80)
    if cells == prefix_trie.BLOCK:
        rows += [(c, t, "user", f"turn {t} {'same' if c % 3 else c}") for c in range(1000, 1600) for t in range(rng.randrange(1, 5))]
    got = [tuple(r) for r in prefix_trie.trie(prefix_trie.whole(_turns(spark, rows))).collect()]
    assert len(got) == len(set(got)) and set(got) == _trie(_ordered(rows))


def test_rebuilt_conversations(spark):
    rows = [r for r in _random_turns(6, 90) if r[0] is None or r[0] % 7 or r[0] % 5]  # some bases are absent
    own, built = _ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    got = [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(_turns(spark, rows))).collect()]
    assert len(got) == len(set(got)) and set(got) == _trie(built)
    assert prefix_trie.trie(prefix_trie.rebuilt(_turns(spark, []))).collect() == []


def _documents(spark, n=900):
    rng = random.Random(8)
    plain = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rude = ["grumblefoot", "nitwaddler", "snotgobbin", "fopdoodle"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(40, 160))]
        toxic = i % 4 == 0
        for _ in range(rng.randrange(4, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        docs.append((i, " ".join(words), 0.0, [1]))
        labels.append((i, int(toxic), "x"))
    docs += [(n, None, 0.0, [1]), (n + 1, "", 0.0, [1]), (n + 2, " \n", 0.0, [1]), (None, "words " * 50_000, 0.0, [1]), (0, docs[0][1], 0.0, [1])]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, windows array<int>"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity_tells_held_out_documents(spark):
    docs, labels = _documents(spark)
    rows = toxicity.scored(docs, labels, ~toxicity.held_out()).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] == 0}) == 1


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = _documents(spark, 300)
    held = toxicity.held_out()
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(str, toxicity.scored(docs, labels, ~held).collect())) == sorted(map(str, toxicity.scored(docs, flipped, ~held).collect()))


def test_toxicity_without_usable_labels(spark):
    docs, labels = _documents(spark, 12)
    assert {r["score"] for r in toxicity.scored(docs, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scored(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.scored(docs.where("false"), labels).collect() == []


def test_long_texts_are_read_whole():
    pair = [toxicity.compressor(b"plain words of every kind " + c) for c in (b" nitwaddler nitwaddler ", b" ordinary words again  ")]
    parts = "plain words of every kind " * 60_000
    assert toxicity.statistics([parts + "nitwaddler", ""], pair)[0][0] > toxicity.statistics([parts, ""], pair)[0][0] == 0
