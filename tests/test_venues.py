"""The venue join against scoring every pair."""

import random

import pytest

from fairline.functions.names import best_window, grams_needed, partial_ratio
from fairline.operators import entity

COLUMNS = "source string, event string, ordinal long, title string, sides array<string>, pm_p_H double, pm_p_D double, pm_p_A double"


def _bent(r: random.Random, name: str) -> str:
    """The name with a few letters dropped, added or changed."""
    out = list(name)
    for _ in range(r.randrange(4)):
        i = r.randrange(len(out) + 1)
        out[i : i + r.randrange(2)] = r.choice(["", "e", "x", " ", "Q"])
    return "".join(out)


@pytest.mark.parametrize("least", [60.0, 82.0, 95.0, 100.0])
def test_needed_grams_are_never_too_many(least):
    r = random.Random(int(least))
    met = 0
    for _ in range(4000):
        a = "".join(r.choice("abcd") for _ in range(r.randrange(1, 14)))
        b = (_bent(r, a) + "".join(r.choice("abcd") for _ in range(r.randrange(9)))).lower()
        if len(a) > len(b):
            continue
        want = max(partial_ratio(a, b) if len(a) < len(b) else 0.0, best_window(a, b, 0.01) or 0.0)
        got = best_window(a, b, least)
        assert (got if got is not None else 0.0) == (want if want >= least else 0.0), (a, b)
        if want >= least:
            q, k = grams_needed(len(a), least)
            assert k >= 1 and sum(a[i : i + q] in b for i in range(len(a) - q + 1)) >= k
            met += 1
    assert met > 300


def test_equals_scoring_every_pair(spark):
    r = random.Random(5)
    clubs = ["Arles", "Nantes United", "Öster", "F", "Ajax B", "Sporting Club of Nowhere-on-the-Water and Surroundings", "", None, "St. Étienne", "ab", "Ost", "Oster Town"]
    clubs += ["".join(r.choice("aeiourstln") for _ in range(r.randrange(3, 12))).title() for _ in range(25)]
    pairs = [(r.choice(clubs), r.choice(clubs)) for _ in range(150)]
    fixtures = [(f"m{i}", h, a) for i, (h, a) in enumerate([*pairs, *pairs[:20]])]
    known = [c for c in clubs if c]
    rows = []
    for i in range(120):
        h, a = (_bent(r, x) for x in (pairs[i] if all(pairs[i]) else (r.choice(known), r.choice(known))))
        rows.append(("v", f"e{i}", 1000 - i, f"{h} vs. {a}", [f"{h} to win", f"{a} to win"], 0.5, 0.25, 0.25))
    rows += [("v", f"again{i}", 2000 + i, rows[i][3], rows[i][4], 0.4, 0.3, 0.3) for i in range(10)]
    rows += [("v", "bare", 3000, "F", [], 0.5, 0.2, 0.3), ("v", "none", 3001, None, None, 0.5, 0.2, 0.3), ("v", "short", 3002, "ab", ["Ost"], 0.5, 0.2, 0.3)]
    got = entity.venue_match(spark.createDataFrame(fixtures, "match_id string, home_team string, away_team string"), spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(fixtures)
    held = {x["match_id"]: x for x in got}
    texts = [(x[2], x[1], f"{x[3] or ''} {' '.join(x[4] or [])}".lower()) for x in sorted(rows, key=lambda x: x[2])]
    found = 0
    for m, h, a in fixtures:
        best, event = 0.0, None
        for _, e, t in texts:
            score = min(partial_ratio(h.lower(), t), partial_ratio(a.lower(), t)) if h and a else 0.0
            if score > best:
                best, event = score, e
        event = event if best >= entity.VENUE_MATCH else None
        found += event is not None
        assert held[m]["event"] == event, (h, a)
        assert held[m]["pm_score"] == (best if event else None)
        assert (held[m]["pm_p_H"] is None) == (event is None)
    assert 40 < found < len(fixtures)


def test_nothing_to_match(spark):
    fixtures = spark.createDataFrame([("m", "A", "B")], "match_id string, home_team string, away_team string")
    none = spark.createDataFrame([], COLUMNS)
    got = entity.venue_match(fixtures, none).collect()
    assert len(got) == 1 and got[0]["event"] is None
    assert entity.venue_match(fixtures.limit(0), none).count() == 0
    assert {r["rate"] for r in entity.venue_coverage(entity.venue_match(fixtures, none)).collect()} == {1.0}


def test_no_club_of_the_query_resembles_another(spark):
    """Its SQL holds every match of a pair of names against that pair alone, so no name may reach the bound in another's text."""
    from pyspark.sql import functions as F

    from fairline.plans import catalog

    teams = spark.range(30_000).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("team"))
    rows = teams.select(F.expr(catalog._club("team")).alias("club"), F.lower(F.expr(catalog._venue_name("team"))).alias("spelled")).collect()
    assert {len(r["club"]) for r in rows} == {9} and {len(r["spelled"]) for r in rows} == {8, 9}
    assert all(r["spelled"] in (r["club"], r["club"][:4] + r["club"][5:]) for r in rows)
    # A text begins with a spelled name; the least that matches is 7 letters of 9 among its first 8, or 8 among any 9.
    drop = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
    starts, middles = {}, {}
    for n, r in enumerate(rows):
        for x in drop(r["spelled"][:8]):
            starts.setdefault(x, set()).add(n)
        for x in drop(r["spelled"]) if len(r["spelled"]) == 9 else {r["spelled"]}:
            middles.setdefault(x, set()).add(n)
    for n, r in enumerate(rows):
        for x in drop(r["club"]):
            assert middles.get(x, set()) <= {n}
            assert all(starts.get(y, set()) <= {n} for y in drop(x))
