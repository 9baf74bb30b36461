"""Document operators on a small table of hard rows, against brute force or exact round trips."""

import collections
import hashlib
import io
import itertools
import random
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fairline.llm import bpe, fingerprints, licenses, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, warc
from fairline.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, removed string, shard string"
R = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "Öl", "été", "IT'S", "x1", "end.", "a,b", "#tag", "İs", "naïve!"]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def rows():
    base = [sentence(40) for _ in range(12)]
    texts = [None, "", "   \n\t ", "one", "one two three", *base, base[0], base[0], base[1] + " tail", "\n".join([base[2], sentence(9), base[3]]), base[4].replace("alpha", "omega", 1), sentence(9000), "Licensed under the Apache License, Version 2.0.\n" + sentence(30), "<|endoftext|>x y"]
    return [(i, t, "en", "s", None if t is None else len(t), 1, "c", "c", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ROWS = rows()
TEXTS = {r[0]: r[1] or "" for r in ROWS}


def test_fingerprints(docs, empty):
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs).collect()}
    order = sorted(TEXTS, reverse=True)

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, k in enumerate(order):
        t, nxt = TEXTS[k], TEXTS[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        assert got[k]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)
    assert got[5]["fingerprint"] == got[17]["fingerprint"]
    assert fingerprints.with_edits(empty).count() == 0
    parts = docs.select(F.lit("g").alias("g"), "doc_id", "text")
    whole = fingerprints.merge_fingerprints(fingerprints.fingerprints(parts, keep=("g", "doc_id")), "g").first()["fingerprint"]
    every = np.unique(np.concatenate([fingerprints.shingle_hashes(t.encode()) for t in TEXTS.values()]))[: fingerprints.K]
    assert whole == fingerprints.to_string(every)


@pytest.mark.parametrize("ids", [[None, None, None], [3, 3, 3, 1], [None, 9, None, 9, 2], [None, None, *range(9000)]])
def test_fingerprints_of_null_and_repeated_ids(spark, ids):
    rows = [(k, None if i == 1 else f"text {i % 7} " + "w " * (i % 5)) for i, k in enumerate(ids)]
    got = fingerprints.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(((k is not None, k or 0, (t or "").encode(), k, t or "") for k, t in rows), key=lambda x: x[:3], reverse=True)
    want = []
    for i, (*_, k, t) in enumerate(order):
        edited = t[: len(t) - len(t) // 3] + order[(i + 1) % len(order)][4][: len(t) // 3]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == collections.Counter(want)


def test_merge_of_more_groups_than_a_task_holds(spark):
    n, r = 10_500, np.random.default_rng(3)
    hashes = r.integers(0, 2**63, (n, 3), dtype=np.uint64)
    # every group comes three times, each time after all the other groups; one hash is shared by two parts
    parts = [(g, fingerprints.to_string(np.unique(hashes[g, [i, (i + 1) % 2]]))) for i in range(3) for g in range(n)]
    parts += [(None, fingerprints.to_string(hashes[0, :1])), (None, None), (None, fingerprints.to_string(hashes[1, :1]))]
    rows = fingerprints.merge_fingerprints(spark.createDataFrame(parts, "g long, fingerprint string").coalesce(1), "g").collect()
    got = {x["g"]: x["fingerprint"] for x in rows}
    assert len(rows) == len(got) == n + 1
    assert all(got[g] == fingerprints.to_string(np.unique(hashes[g])) for g in range(n))
    assert got[None] == fingerprints.to_string(np.unique(hashes[:2, 0]))


def test_bpe_round_trip(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    for r in bpe.encode(docs, bpe.vocabulary_path()).collect():
        want = lib.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids
        assert list(memoryview(bytes(r["ids"])).cast("I")) == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, bpe.vocabulary_path()).count() == 0


def test_packing_keeps_every_id_once(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary_path())
    by, seq = collections.defaultdict(list), collections.defaultdict(int)
    for r in sorted(packing.pieces(docs).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seq[r["sequence_id"]]
        seq[r["sequence_id"]] += r["length"]
        by[r["doc_id"]].append(r)
    assert max(seq.values()) <= packing.SIZE
    for k, t in TEXTS.items():
        ids, at = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pieces(empty).count() == 0


def test_cuts_are_optimal():
    for seed in range(30):
        r = np.random.default_rng(seed)
        pos = np.concatenate([[0], np.cumsum(r.integers(1, 9, 14))])
        pen = r.integers(0, 4, len(pos))

        def cost(ends):
            out, last = 0, 0
            for e in ends:
                n = int(pos[e] - pos[last])
                if n > 16:
                    return None
                out += (0 if n in (1, 2, 4, 8, 16) else 16 - n) + int(pen[e]) + packing.WINDOW_COST
                last = e
            return out

        n = len(pos) - 1
        best = min(c for k in range(n) for mid in itertools.combinations(range(1, n), k) if (c := cost([*mid, n])) is not None)
        assert cost(packing.cuts(pos, pen, 16)) == best


def test_cuts_are_optimal_at_full_size():
    size = packing.SIZE
    for seed in range(40):
        r = np.random.default_rng(seed)
        steps = r.choice([1, 2, 16, 48, 64, 128, 200, 256, 1000, 2048, 4000], 60)
        pos = np.concatenate([[0], np.cumsum(steps)])
        pen = r.choice([0, packing.CUT_PENALTY], len(pos))
        spent, best = lambda n: 0 if n & (n - 1) == 0 else size - n, [0]
        for j in range(1, len(pos)):
            best.append(min(best[i] + spent(int(pos[j] - pos[i])) for i in range(j) if pos[j] - pos[i] <= size) + int(pen[j]) + packing.WINDOW_COST)
        ends = packing.cuts(pos, pen)
        assert ends[-1] == len(pos) - 1
        assert sum(spent(int(pos[j] - pos[i])) + int(pen[j]) + packing.WINDOW_COST for i, j in zip([0, *ends], ends)) == best[-1]


def test_chunk_ids_of_hard_words():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary_path())
    kept = packing.ChunkIds(packing.vocabulary_path())
    letters = [chr(i) for i in range(0x41, 0x30000) if chr(i).isalpha()]
    words = [*letters[:3000], *letters[3000::97], *("".join(R.choice(letters) for _ in range(R.randint(1, 6))) for _ in range(3000)), "don't", "it's.", "e\u0301t\u00e9", "\u03a3\u03a3", "\u1100\u1161", "İstanbul!", "a<|endoftext|>b"]
    R.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    for t, ids in zip(texts, kept.encode([t.encode() for t in texts])):
        assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2]


def test_quality_rules(docs, empty):
    for r in quality_rules.ledger(quality_rules.measure(docs)).collect():
        t = TEXTS[r["doc_id"]]
        w = t.encode().split()
        spans = collections.defaultdict(list)
        for i in range(len(w) - 7):
            spans[tuple(w[i : i + 8])].append(i)
        cover = {i + k for v in spans.values() if len(v) > 1 for i in v for k in range(8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(cover))
        assert bool(r["failed_bits"] & 1) == (len(w) < 20)
    assert quality_rules.measure(empty).count() == 0
    a = {r["rule"]: r for r in quality_rules.ablation(quality_rules.ledger(quality_rules.measure(docs)), "web-1").collect()}
    assert a["few_words"]["n_failed"] >= 5 and a["few_words"]["n_only_this"] <= a["few_words"]["n_failed"] <= a["few_words"]["n_rejected"]


def test_simhash_components(spark, docs, empty):
    def brute(t):
        w = t.encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum((sum(x >> i & 1 for x in h) * 2 > len(h)) << i for i in range(64))

    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert all(got[k]["fp"] & 0xFFFFFFFFFFFFFFFF == brute(t) for k, t in TEXTS.items() if len(t) < 5000)
    assert {got[k]["component_id"] for k in (0, 1, 2)} == {0} and got[17]["component_id"] == got[18]["component_id"] == 5
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for s in seeds for _ in range(60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    label = {r["node"]: r["label"] for r in components(edges, "a", "b").collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert all(label.get(x, x) == find(x) for x in signed)


def test_sharding(docs, empty):
    got = sharding.uniform_shards(docs.select("doc_id"), 4).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == len(TEXTS) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.uniform_shards(empty.select("doc_id"), 4).count() == 0
    m = sharding.communication_matrix([5, 0, 9, 3], 4, 1)
    assert m.sum(1).tolist() == [5, 0, 9, 3] and sorted(m.sum(0).tolist()) == [4, 4, 4, 5]


def test_sharding_spreads_copies(spark):
    ids = [7] * 2000 + [None] * 400 + list(range(1600))
    rows = spark.createDataFrame([(i, "x", 9) for i in ids], "doc_id long, shard string, slot long").repartition(5)
    got = sharding.uniform_shards(rows, 40).collect()
    assert [*got[0].asDict()] == ["doc_id", "shard", "slot"] and collections.Counter(r["doc_id"] for r in got) == collections.Counter(ids)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"] == 7))
    assert all(sorted(s for s, _ in v) == list(range(100)) for v in slots.values()) and len(slots) == 40
    # copies make half of the rows: each shard holds about 50, and they lie all over it
    held = [[s for s, copy in v if copy] for v in slots.values()]
    assert all(20 <= len(h) <= 80 and max(h) - min(h) > 70 for h in held)
    assert sum((len(h) - 50) ** 2 / 25 for h in held) < 100  # 39 degrees of freedom


def test_line_dedup(spark, docs, empty):
    kept, want, seen = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}, {}, []
    for k in sorted(TEXTS):
        out = []
        for line in TEXTS[k].split("\n"):
            w = line.encode().split()
            s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            if not s or not any(len(s & x) * 9 >= 4 * (len(s) + len(x)) for x in seen):
                out.append(line)
            if s:
                seen.append(s)
        want[k] = "\n".join(out)
    assert {k: v or "" for k, v in kept.items()} == want and kept[0] is None
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_short_lines(spark):
    notice, five = "All rights reserved.", "one two three four five"
    texts = [
        f"{notice}\n\none\none two three four\n{five}",
        f"{notice}\n\none two\nOne\n{five}\none  two\tthree four",
        f"one\n{notice} Now\nrights All reserved.\nthree four five\n\n  \n{five} six\none two",
        f"{notice}\n{notice}",
        f"{notice}\nnew here\nnew here",
    ]
    want, seen = {}, []
    for k, t in enumerate(texts):
        want[k] = []
        for i, line in enumerate(t.split("\n")):
            w = line.encode().split()
            s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            if s and any(len(s & x) * 9 >= 4 * (len(s) + len(x)) for x in seen):
                want[k].append(i)
            seen += [s] * bool(s)
    assert want == {0: [], 1: [0, 4, 5], 2: [0, 7], 3: [0, 1], 4: [0, 2]}
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["removed"] for r in got} == want
    assert {r["doc_id"]: r["text"] for r in got}[1] == "\none two\nOne"


def test_line_dedup_near_groups(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    lines = []
    for i in range(40):
        w = base[:]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"e{r.randrange(10**6)}"
        lines.append(" ".join(w))
    rows = [(i, x) for i, x in enumerate(lines)] + [(100, None), (None, lines[0])]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id IS NOT NULL").collect()}
    sets = [{tuple(x.split()[i : i + 5]) for i in range(56)} for x in lines]
    for i, s in enumerate(sets):
        assert bool(got[i]) == any(len(s & x) * 9 >= 4 * (len(s) + len(x)) for x in sets[:i])


def test_line_dedup_repeated_ids_and_clashing_names(spark):
    long = "one two three four five six seven eight nine ten eleven"
    rows = [(0, long, "c", "d", 1), (1, f"{long}\nkept", "c", "d", 2), (1, "totally different words in here now\nother", "c", "d", 3), (2, None, "c", "d", 4), (3, f"x\n{long} twelve", "c", "d", 5), (3, f"x\n{long} twelve", "c", "d", 5)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, removed string, __maybe string, at long"), removed="gone").collect()
    assert sorted((r["at"], r["text"], r["gone"], r["removed"]) for r in got if r["text"]) == [(1, long, [], "c"), (2, "kept", [0], "c"), (3, "totally different words in here now\nother", [], "c"), (5, "x", [1], "c"), (5, "x", [1], "c")]
    assert len(got) == 6


def test_licenses(docs, empty):
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(docs).collect()}
    assert got == {(max(k for k, t in TEXTS.items() if "Apache" in t), "apache-2.0"): 1.0}
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs, templates=()).count() == 0


def test_zip_reader_agrees_with_zipfile(tmp_path):
    parts = [("a/one", b"x" * 1000), ("b", b""), ("c", bytes(range(256)))]
    for long_forms in (False, True):
        raw = warc.zip_stored(parts, long_forms)
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert [(i.filename, z.read(i)) for i in z.infolist()] == parts
        (tmp_path / "x.zip").write_bytes(raw)
        src = warc.Ranges(f"file://{tmp_path}/x.zip")
        assert {n: src.read_at(size, at) for n, (at, size, _) in warc.members(src, src.size).items()} == dict(parts)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u\nbad", "été" * 5000), (5, "u", "other")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(warc.with_references(pages), f"file://{tmp_path}/w", 64)).collect())
    assert got == sorted([(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 25000, "response", None), (5, 5, "response", None)])
    none = warc.write_archives(warc.with_references(pages.limit(0)), f"file://{tmp_path}/n")
    assert warc.read_archives(none).count() == 0


def test_classifier(spark, docs, empty):
    r = random.Random(4)
    clean = [(i, " ".join(r.choice(["the", "house", "was", "green", "and", "quiet", "today"]) + r.choice(["", "", ".", ","]) for _ in range(r.randint(30, 90)))) for i in range(150)]
    junk = [(1000 + i, " ".join(r.choice(["buy", "now", "cheap"]) + r.choice(["###", "$$$", "%%%"]) for _ in range(r.randint(30, 90)))) for i in range(150)]
    d = spark.createDataFrame(clean + junk + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in clean + junk], "doc_id long, quality int")
    got = {x["doc_id"]: x["score"] for x in quality_classifier.scored(d, labels).collect()}
    held = [i for i, _ in clean + junk if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i < 1000) for i in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    assert {x["score"] for x in quality_classifier.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.scored(empty, labels).count() == 0
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all()


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    names = docs.columns
    for name in ("quality_rules", "quality_classifier", "line_dedup", "simhash_dedup"):
        before = ids(docs)
        docs = corpus_pipeline.stored(stages[name](spark, docs, sf), "t")
        assert docs.columns == names and ids(docs) <= before
    assert ids(stages["packing"](spark, docs, sf)) == ids(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "simhash_dedup", "packing"]
    nothing = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name in ("quality_rules", "line_dedup", "simhash_dedup"):
        assert stages[name](spark, nothing, sf).count() == 0


def test_pipeline_of_null_repeated_and_clashing(spark, tmp_path):
    import corpus_pipeline

    good, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "thing"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, failed_bits string, removed string, fp string, score string"
    data = [(k, t, "en", "s", 0, "a", "b", "c", "d", "e") for k, t in [(1, good), (1, good), (1, other), (1, "bad"), (None, good), (None, "bad"), (None, None), (2, ""), (3, other + " tail"), (None, "x " * 400)]]
    docs = spark.createDataFrame(data, schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = lambda d: collections.Counter((r["doc_id"], r["text"]) for r in d.collect())
    ruled = stages["quality_rules"](spark, docs, str(tmp_path))
    assert ruled.columns == docs.columns
    assert rows(ruled) == collections.Counter([(1, good), (1, good), (1, other), (None, good), (3, other + " tail")])
    assert rows(stages["quality_classifier"](spark, ruled, str(tmp_path))) == rows(ruled)
    lined = stages["line_dedup"](spark, docs, str(tmp_path))
    assert lined.columns == docs.columns and {r["removed"] for r in lined.collect()} == {"c"} and lined.count() == docs.count()
    deduped = stages["simhash_dedup"](spark, ruled, str(tmp_path))
    assert deduped.columns == docs.columns
    # brute force: components of fingerprints within four bits, then the first row of each
    keys = sorted(rows(ruled), key=lambda x: (x[0] is None, x[0] or 0))
    fps = [simhash.simhash(t.encode()) for _, t in keys]
    label = list(range(len(keys)))
    for i, j in itertools.combinations(range(len(keys)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = rows(deduped)
    assert set(got.values()) == {1} and len(got) == len(set(label))
    assert sorted(label[keys.index(k)] for k in got) == sorted(set(label))
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_quality_scores_take_one_python_pass(spark):
    width = len(quality_classifier.STATISTICS)
    model = {"mean": np.zeros(width), "scale": np.ones(width), "w": np.ones((width, 3)), "b": np.zeros(3), "beta": np.array([0.1, 0.2, 0.3, 0.4]), "knots": (np.array([0.0, 1.0]), np.array([0.2, 0.8]))}
    rows = spark.createDataFrame([(1, [0.1] * width), (2, [0.0] * width)], "doc_id long, stats array<double>")
    got = quality_classifier.score(rows, model)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    raw = {r["doc_id"]: r["raw"] for r in quality_classifier._raw(rows, model).collect()}
    want = {k: round(0.99 * float(np.interp(x, [0.0, 1.0], [0.2, 0.8])) + 0.01 * (x + 0.5) / 2, 9) for k, x in raw.items()}
    assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx(want)


def test_packing_worker_holds_few_chunks():
    lib = packing.ChunkIds(bpe.vocabulary_path())
    for k in range(40):
        words = ["always", "Often,", *(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" + "".join(chr(97 + i // 26**j % 26) for j in range(3)) for i in range(9000))]
        ids = lib.encode([" ".join(words).encode()])[0]
        assert len(lib.known) + len(lib.older) < 300_000
        if k in (0, 20, 39):
            want = lib.lib.encode(" ".join(words), add_special_tokens=False).ids
            assert ids.tolist() == [*want, packing.END_ID]
    assert b"Often," in lib.known or b"Often," in lib.older


def test_packing_words_of_letters_need_only_the_model():
    lib = packing.ChunkIds(bpe.vocabulary_path())
    text = "Always, \u00c9t\u00e9 na\u00efve \u0153uvre wei\u00df. d\u00e9j\u00e0 always \u0416\u0438\u0437\u043d\u044c \u4e2d\u6587"
    lib.learn({b",", b"."})
    want, full = lib.lib.encode(text, add_special_tokens=False).ids, lib.lib
    lib.lib = type("NoPipeline", (), {"normalizer": full.normalizer, "pre_tokenizer": full.pre_tokenizer})
    assert lib.encode([text.encode()])[0].tolist() == [*want, packing.END_ID]
