"""Closed forms and brute force for helpers."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairline.functions import goals, names, odds, scalar
from fairline.operators import drift, entity, evaluate, goal_ratings, splits
from fairline.sources import readers


def test_shin_recovers_margin():
    p, z = odds.shin(np.array([[0.45, 0.27, 0.28], [0.6, 0.25, 0.15]]) * 1.05)
    assert np.allclose(p.sum(1), 1) and (z > 0).all() and p[1, 2] < 0.15 + 1e-9
    p, z = odds.shin(np.array([[0.5, 0.3, 0.2], [0.4, 0.3, 0.2]]))
    assert np.allclose(z, 0) and np.allclose(p[0], [0.5, 0.3, 0.2])


def test_goal_probabilities_sum_to_one():
    p = goals.outcome_probabilities(np.array([1.5, 1.0, np.nan]), np.array([1.0, 1.0, 1.0]), np.array([-0.1, 0.0, 0.0]))
    assert np.allclose(p[:2].sum(1), 1) and p[0, 0] > p[0, 2] and abs(p[1, 0] - p[1, 2]) < 1e-12 and np.isnan(p[2]).all()


def test_names():
    assert names.name_score("Real Madrid", "Real Madrid") == 100 and names.token_set_ratio("Madrid Real", "Real Madrid CF") == 100
    assert names.ratio("ab", "ba") == names.ratio("ba", "ab") and names.partial_ratio("lyon", "olympique lyon fc") == 100
    assert names.name_score("Arsenal", "Chelsea") < 70


def test_assignment_equals_brute_force():
    r = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 3), (6, 6)]:
        for _ in range(20):
            s = r.integers(0, 100, (n, m)).astype(float)
            got = sum(s[i, j] for i, j in entity.assign(s))
            k = min(n, m)
            best = max(sum(s[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
            assert got == pytest.approx(best) and len(entity.assign(s)) == k


def test_ks_pvalue_limits():
    assert drift.ks_pvalue(0.0, 50, 60) == 1.0 and drift.ks_pvalue(1.0, 20, 20) < 1e-9
    assert drift.ks_pvalue(0.5, 2, 2) == pytest.approx(1.0) and drift.ks_pvalue(1.0, 2, 2) == pytest.approx(1 / 3)


def test_metrics_equal_their_definitions(spark):
    """Scores of random rows, ties of confidence and impossible outcomes included, against numpy."""
    rng = np.random.default_rng(21)
    p = np.round(rng.dirichlet([2, 1, 1.5], 300), 2)
    p[:5] = [[0, 1, 0], [0, 0, 1], [0.4, 0.4, 0.2], [0.25, 0.5, 0.25], [1, 0, 0]]
    y = rng.integers(0, 3, len(p))
    df = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(y, p)], "y_true int, p_H double, p_D double, p_A double")
    r = evaluate.metric_summary(df, []).first()
    c = np.clip(p, 1e-15, 1)
    assert r["log_loss"] == pytest.approx(-np.log((c / c.sum(1, keepdims=True))[np.arange(len(y)), y]).mean())
    assert r["brier"] == pytest.approx(((p - np.eye(3)[y]) ** 2).sum(1).mean())
    hit, sure, edges = p.argmax(1) == y, p.max(1), np.linspace(0, 1, 11)
    assert r["accuracy"] == pytest.approx(hit.mean())
    held = [(sure > lo) & (sure <= hi) for lo, hi in zip(edges, edges[1:])]
    assert r["ece"] == pytest.approx(sum(abs(hit[k].mean() - sure[k].mean()) * k.sum() for k in held if k.any()) / len(y))


def test_splits():
    f = splits.walk_forward([2018, 2019, 2020, 2021])
    assert [s.name for s in f] == ["wf_2020", "wf_2021"] and f[1].train == (2018, 2019, 2020)
    assert splits.stacking((1, 2, 3, 4)) == ((1, 2), (3,), (4,))
    for bad in (lambda: splits.walk_forward([2018]), lambda: splits.holdout([2018, 2025], 2025), lambda: splits.calibration((1,)), lambda: splits.stacking((1, 2))):
        with pytest.raises(ValueError):
            bad()


def test_goal_fit_gradient_and_order():
    goals = {"oak": 5, "elm": 3, "ash": 1}  # whoever hosts, a side scores its own number less what the other keeps out
    rows = [(h, a, max(0, goals[h] - goals[a] // 2), max(0, goals[a] - goals[h] // 2)) for _ in range(3) for h in goals for a in goals if h != a]
    m = pd.DataFrame(rows, columns=["home_team", "away_team", "fthg", "ftag"])
    m["date"] = pd.date_range("2020-01-01", periods=len(m))
    got = goal_ratings.fit(m, m["date"].max()).set_index("team")
    assert got.attack["oak"] > got.attack["elm"] > got.attack["ash"] and (got.attack > 0).all()
    with pytest.raises(ValueError):
        goal_ratings.fit(m, m["date"].min())
    t = np.random.default_rng(0).normal(0, 0.2, 8)
    t[-1] = 0.05
    h, a = np.array([0, 1, 2, 0]), np.array([1, 2, 0, 2])
    x, y, w = np.array([0.0, 1, 1, 0]), np.array([0.0, 0, 1, 1]), np.ones(4)
    f = lambda z: goal_ratings.objective(z, h, a, x, y, w, 3, 0.05)
    num = np.array([(f(t + e)[0] - f(t - e)[0]) / 2e-6 for e in np.eye(8) * 1e-6])
    assert np.allclose(num, f(t)[1], atol=1e-5)


def test_result_files_with_drifting_headers(spark, tmp_path):
    old, new, bad = tmp_path / "old.csv", tmp_path / "new.csv", tmp_path / "bad.csv"
    old.write_bytes("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,PSH,PSD,PSA\n13/08/16, Köln ,Bonn,2,1,h,2.1,3.3,3.5\n14/08/16,A,B\n,,,,,,,,\n".encode("latin-1"))
    new.write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,AvgCH,AvgCD,AvgCA\n13/08/2019,C,D,0,0,D,2.5,x,2.9\n14/08/2019,C,D,0,0,D,2.5,3.0,2.9,9,9\n")
    bad.write_text("Date,HomeTeam,AwayTeam\n13/08/2019,C,D\n")
    got = readers.read_results(spark, {("E0", 2016): str(old), ("E0", 2019): str(new), ("E1", 2019): str(bad)}).orderBy("season").collect()
    assert [(r["home_team"], str(r["date"]), r["ftr"]) for r in got] == [("Köln", "2016-08-13", "H"), ("C", "2019-08-13", "D")]
    assert got[0]["odds_PS_H"] == 2.1 and got[0]["odds_AvgC_H"] is None and got[1]["odds_AvgC_D"] is None


def test_fixtures_strip_bom(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_bytes(b"\xef\xbb\xbfDiv,Date,Time,HomeTeam,AwayTeam,AvgH,AvgD,AvgA\nE0,15/08/2026,15:00,Man City,B,2,3,4\nXX,15/08/2026,15:00,A,B,2,3,4\n")
    r = readers.read_fixtures(spark, str(p), ("E0",)).collect()
    assert [(x["match_id"], x["odds_Avg_D"], x["kickoff_time"]) for x in r] == [("E0_2026_ManCity_B", 3.0, "15:00")]


def test_nested_json(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"dates":[{"isResult":true,"datetime":"2020-09-12 14:00:00","h":{"title":"A"},"a":{"title":"B"},"goals":{"h":"1","a":"0"},"xG":{"h":"1.2","a":"0.4"}},{"isResult":false},{"isResult":true,"datetime":"2020-09-12 14:00:00","h":{"title":"A"},"a":{"title":"C"},"goals":{"h":"1","a":"0"},"xG":{"h":"bad","a":"0.4"}}]}')
    r = readers.read_xg(spark, str(p), "E0", 2020).collect()
    assert len(r) == 1 and r[0]["home_xg"] == 1.2 and str(r[0]["date"]) == "2020-09-12 00:00:00"
    v = tmp_path / "v.json"
    v.write_text('{"events":[{"event":"e","title":"t","markets":[{"label":"A","yes_bid":40,"yes_ask":44,"last_price":1},{"label":"Draw","last_price":28},{"label":"B","yes_bid":30,"yes_ask":32}]},{"event":"f","title":"t","markets":[{"label":"A","last_price":50}]}]}')
    t = readers.read_venue_a(spark, str(v)).collect()
    assert len(t) == 1 and t[0]["sides"] == ["A", "B"] and t[0]["pm_p_H"] == pytest.approx(0.42 / 1.01)


def test_seasons_turn_at_the_start_of_july(spark):
    """Every day of three years: the season changes on one day a year and is the year it began in."""
    days = spark.sql("SELECT explode(sequence(date'2011-01-01', date'2013-12-31')) AS d").withColumn("s", scalar.season_of(F.col("d")))
    rows = [(r["d"], r["s"]) for r in days.orderBy("d").collect()]
    turns = [(b[0].month, b[0].day, b[1] - a[1]) for a, b in zip(rows, rows[1:]) if a[1] != b[1]]
    assert turns == [(7, 1, 1)] * 3 and rows[0][1] == 2010 and rows[-1][1] == 2013


def test_match_rates_and_pins(spark):
    canon = spark.createDataFrame([("E0", 2018, x) for x in ("Manchester United", "Arsenal", "Wolves")], "league string, season int, name string")
    raw = spark.createDataFrame([("E0", 2018, x) for x in ("Man Utd", "Arsenal FC", "Wolves")], "league string, season int, name string")
    manual = spark.createDataFrame([("x", "E0", "Man Utd", "Manchester United")], "source string, league string, raw_name string, canonical_name string")
    got = {r["raw_name"]: r["canonical_name"] for r in entity.resolve_names(canon, raw, "x", manual).collect()}
    assert got == {"Arsenal FC": "Arsenal", "Wolves": "Wolves"}


def test_second_venue_takes_the_last_prices(spark, tmp_path):
    """Titles in any case; prices that are no numbers are left out; the last draw and the last other side count; one side is not enough."""
    import json

    def event(i, title, *markets):
        return {"id": i, "title": title, "markets": [{"label": a, "prices": b} for a, b in markets]}

    found = [
        event("a", "Lyon VS Nice", ("Lyon", '["0.5"]'), ("Draw", '["0.9"]'), ("Nice", '["0.1"]'), ("Tie after 90", '["0.3"]'), ("Nice again", '["0.4", "0.6"]')),
        event("b", "Lyon and Nice", ("Lyon", '["0.5"]'), ("Draw", '["0.2"]'), ("Nice", '["0.3"]')),
        event("c", "Metz vs Lens", ("Metz", '["0.5"]'), ("Draw", '["0.2"]'), ("Lens", '["n/a"]')),
    ]
    path = tmp_path / "b.json"
    path.write_text(json.dumps(found))
    rows = readers.read_venue_b(spark, str(path)).collect()
    assert [r["event"] for r in rows] == ["a"] and rows[0]["sides"] == ["Lyon", "Nice again"]
    assert np.allclose([rows[0][f"pm_p_{o}"] for o in "HDA"], np.array([0.5, 0.3, 0.4]) / 1.2)


def test_goal_fit_has_the_objective_and_its_derivatives():
    r = np.random.default_rng(4)
    for n, m in ((6, 200), (60, 150)):  # most pairs met, and few
        h = r.integers(0, n, m)
        a = (h + r.integers(1, n, m)) % n
        counts = goal_ratings.counted(np.arange(m), r.integers(0, 3, m).astype(float), r.integers(0, 3, m).astype(float), r.uniform(0.1, 1, m), m)
        f, t, z = goal_ratings.Fit(h, a, counts, n, 0.05), np.append(r.normal(0, 0.2, 2 * n + 1), 0.07), r.normal(size=2 * n + 2)
        value, slope = f.value(t)
        want, gradient = goal_ratings.pair_objective(t, h, a, counts, n, 0.05)
        assert np.isclose(value, want) and np.allclose(slope, gradient)
        product, diagonal = f.curvature(t)
        assert np.allclose(product(z), (f.value(t + 1e-5 * z)[1] - f.value(t - 1e-5 * z)[1]) / 2e-5, atol=1e-5)
        assert np.allclose(diagonal, [product(e)[i] for i, e in enumerate(np.eye(2 * n + 2))])


def test_goal_fit_of_many_teams_is_soon_done():
    r = np.random.default_rng(1)
    n, m = 2000, 60_000
    h = r.integers(0, n, m)
    a = (h + r.integers(1, n, m)) % n
    counts = goal_ratings.counted(np.arange(m), r.integers(0, 4, m).astype(float), r.integers(0, 3, m).astype(float), np.exp(-0.0019 * r.uniform(0, 2400, m)), m)
    start = time.time()
    got = goal_ratings.fit_counted([f"T{i}" for i in range(n)], h, a, counts, 0.05, (-0.2, 0.2), None, (0.25, 0.0))
    assert time.time() - start < 1.5  # a matrix of all second derivatives takes longer to invert
    theta = np.concatenate([np.log(got["attack"]), np.log(got["defense"]), [np.log(got["home_advantage"][0]), got["rho"][0]]])
    assert np.abs(goal_ratings.pair_objective(theta, h, a, counts, n, 0.05)[1]).max() < 1e-4


def test_goal_ratings_of_a_league_are_several_tasks(spark):
    day = pd.Timestamp("2000-01-01")
    r = np.random.default_rng(2)
    rows = [(x, day + pd.Timedelta(days=int(i // 5)), *r.choice(list("ABCDEF"), 2, replace=False).tolist(), float(r.integers(4)), float(r.integers(3))) for x in ("L", "M") for i in range(400)]
    m = spark.createDataFrame(pd.DataFrame(rows, columns=["league", "date", "home_team", "away_team", "fthg", "ftag"]))
    key = ["league", "from_date", "team"]
    one, many = (goal_ratings.walk_forward_ratings(m, blocks=k).toPandas().sort_values(key).reset_index(drop=True) for k in (1, 4))
    assert one[key].equals(many[key]) and one.groupby("league")["from_date"].nunique().min() == 13
    assert np.allclose(one[["attack", "defense", "home_advantage", "rho"]], many[["attack", "defense", "home_advantage", "rho"]], atol=1e-4)
    few = m.where("date < '2000-01-04'")
    assert goal_ratings.walk_forward_ratings(few).count() == 0
