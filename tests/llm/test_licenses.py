"""License scans: short templates, blocks, hard rows, and recall of partial copies against an exact scan of all windows."""

import random

import pytest

from fairline.llm import licenses

WORDS = [f"word{i}" for i in range(400)]


def words(text):
    for c in licenses.PUNCTUATION:
        text = text.replace(c, "")
    return text.lower().split()


def shingles(w, width):
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def exact(rows, templates, threshold=licenses.THRESHOLD):
    """{(doc_id, license): (n_windows, containment)} over every window, without MinHash."""
    held = {}
    for name, t in templates:
        w = words(t)
        width = min(len(w), licenses.SHINGLE)
        if not width:
            continue
        t = shingles(w, width)
        for i, text in rows:
            s = shingles(words(text or ""), width)
            for at in range(0, len(s), len(t)):
                share = len(set(s[at : at + 2 * len(t) - 1]) & set(t)) / len(set(t))
                if share >= threshold:
                    spot = held.setdefault((i, name), {})
                    spot[width, at] = max(share, spot.get((width, at), 0))
    return {k: (len(v), max(v.values())) for k, v in held.items()}


def scanned(spark, rows, templates, **more):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, at long")
    return {(r["doc_id"], r["license"]): (r["n_windows"], r["containment"]) for r in licenses.scan(docs, templates, **more).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_short_templates_are_found_inside_longer_texts(spark):
    templates = [("mit", "MIT License"), ("cc0", "CC0"), ("three", "public domain dedication"), ("blank", " .. "), ("mit", "Released under the MIT License.")]
    rows = [(1, "this is under the MIT license, mostly"), (2, "mit"), (3, "a public domain dedication and CC0"), (4, None), (5, ""), (6, " \n "), (None, "cc0 cc0"), (7, "Released under the MIT License."), (7, "Released under the MIT License."), (8, "license mit")]
    got = scanned(spark, rows, templates)
    same({k: v for k, v in got.items() if k[0] != 7}, exact([r for r in rows if r[0] != 7], templates))
    assert set(got) >= {(1, "mit"), (3, "three"), (3, "cc0"), (None, "cc0"), (7, "mit")} and (8, "mit") not in got and (2, "mit") not in got


def test_blocks_of_any_size_find_the_same(spark):
    r = random.Random(3)
    templates = [(f"t{i}", " ".join(r.choices(WORDS, k=r.choice([1, 2, 3, 7, 20, 60])))) for i in range(24)]
    rows = [(i, " ".join(r.choices(WORDS, k=50)) + " " + r.choice(templates)[1] + " " + " ".join(r.choices(WORDS, k=30))) for i in range(24)]
    want = exact(rows, templates)
    for block in (licenses.BLOCK, 200):
        same(scanned(spark, rows, templates, block=block), want)


def test_blocks_hold_every_template_once():
    known = [(5 if i % 3 else 2, f"t{i}", list(range(i % 40 + 1))) for i in range(3000)]
    got = licenses.blocks(known, 100)
    assert sorted(x for b in got for x in b) == sorted(known)
    assert all(len({x[0] for x in b}) == 1 and (sum(len(x[2]) for x in b) <= 100 or len(b) == 1) for b in got)


def test_recall_of_partial_copies(spark):
    """Whole license texts with words replaced here and there: MinHash against every window."""
    r = random.Random(11)
    whole = [t for t in licenses.TEMPLATES if t[0].endswith("-text")]
    rows = []
    for i in range(240):
        w = whole[i % len(whole)][1].split()
        for k in r.sample(range(len(w)), r.randrange(0, max(2, len(w) // 22))):
            w[k] = r.choice(WORDS)
        rows.append((i, " ".join(r.choices(WORDS, k=r.randrange(200)) + w + r.choices(WORDS, k=r.randrange(200)))))
    want, got = exact(rows, whole), scanned(spark, rows, whole)
    near = [k for k, v in want.items() if v[1] < 0.9]
    assert len(near) >= 30 and not got.keys() - want.keys()
    assert len(got.keys() & want.keys()) >= 0.98 * len(want)
    assert len(got.keys() & set(near)) >= 0.95 * len(near)
