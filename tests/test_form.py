"""Point-in-time properties on a generated double round robin."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fairline.operators import form

SCHEMA = "match_id string, league string, season int, date timestamp, home_team string, away_team string, fthg double, ftag double, home_xg double, away_xg double, ftr string"


def games(seasons=(2018, 2019), seed=1):
    r, rows = random.Random(seed), []
    teams = [f"Team{c}" for c in "ABCDEFGH"]
    for s in seasons:
        day = dt.datetime(s, 8, 10, 15)
        for h, a in itertools.permutations(teams, 2):
            x, y = r.randint(0, 3), r.randint(0, 3)
            rows.append((f"E0_{s}_{h}_{a}", "E0", s, day, h, a, float(x), float(y), x * 0.9, y * 0.8, "H" if x > y else "D" if x == y else "A"))
            day += dt.timedelta(days=3)
    return rows


@pytest.fixture(scope="module")
def matches(spark):
    return spark.createDataFrame(games(), SCHEMA).cache()


@pytest.fixture(scope="module")
def ratings(spark):
    rows = []
    for i, t in enumerate(f"Team{c}" for c in "ABCDEFGH"):
        rows += [(t, 1500.0 + i, dt.datetime(2017, 1, 1)), (t, 2000.0 + i, dt.datetime(2019, 1, 2))]
    return spark.createDataFrame(rows, "team string, elo double, from_date timestamp")


def test_rolling_equals_brute_force(matches):
    rows = [r.asDict() for r in form.rolling_form(form.long_frame(matches)).collect()]
    by = {}
    for r in sorted(rows, key=lambda r: (r["team"], r["date"], r["match_id"])):
        past = by.setdefault(r["team"], [])
        want = sum(p["points"] for p in past[-5:]) / 5 if len(past) >= 5 else None
        assert r["points_r5"] == (pytest.approx(want) if want is not None else None)
        past.append(r)


def test_own_score_does_not_change_own_features(spark, matches):
    key = sorted(r["match_id"] for r in matches.select("match_id").collect())[60]
    changed = matches.withColumn("fthg", F.when(F.col("match_id") == key, 9.0).otherwise(F.col("fthg")))
    at = lambda m: sorted(map(str, form.rolling_form(form.long_frame(m)).where(F.col("match_id") == key).select("is_home", "points_r5", "goals_for_r5", "rest_days").collect()))
    assert at(matches) == at(changed)


def test_asof_never_looks_ahead(matches, ratings):
    rows = form.attach_elo(form.long_frame(matches), ratings)
    late = rows.where((F.col("date") < "2019-01-03") & (F.col("elo") >= 2000)).count()
    early = rows.where((F.col("date") >= "2019-01-04") & (F.col("elo") < 2000)).count()
    assert (late, early) == (0, 0)


def test_null_rating_of_chosen_fact_stays_null(spark, matches):
    r = spark.createDataFrame([("TeamA", 1500.0, dt.datetime(2017, 1, 1)), ("TeamA", None, dt.datetime(2018, 1, 1))], "team string, elo double, from_date timestamp")
    assert form.attach_elo(form.long_frame(matches).where("team = 'TeamA'"), r).where("elo IS NOT NULL").count() == 0


def test_audit_fires_on_a_frame_that_includes_the_present(matches):
    rows = form.long_frame(matches)
    good = form.wide_frame(form.rolling_form(rows), ("points_r5",))
    assert form.leakage_audit(good, rows) > 50
    from pyspark.sql import Window

    w = Window.partitionBy("team").orderBy("date", "match_id").rowsBetween(-4, 0)
    leaky = form.wide_frame(rows.withColumn("points_r5", F.when(F.count("points").over(w) == 5, F.avg("points").over(w))), ("points_r5",))
    with pytest.raises(ValueError):
        form.leakage_audit(leaky, rows)


def test_scoring_mode_equals_training_path(matches, ratings):
    last = matches.orderBy(F.desc("date")).limit(1)
    pending = last.withColumns({c: F.lit(None).cast("double") for c in ("fthg", "ftag", "home_xg", "away_xg")})
    a = form.build_features(matches, ratings).join(last.select("match_id"), "match_id", "left_semi").select("home_points_r5", "elo_diff", "away_ewma_points").first()
    b = form.build_features(matches.join(last.select("match_id"), "match_id", "left_anti"), ratings, pending).select("home_points_r5", "elo_diff", "away_ewma_points").first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_promoted(spark):
    rows = [(f"m{s}{i}", "E0", s, dt.datetime(s, 9, 1 + i), h, a, 1.0, 0.0, 1.0, 0.0, "H") for s, ts in ((2018, "ABCD"), (2019, "ABCE")) for i, (h, a) in enumerate(itertools.permutations(ts, 2))]
    got = {(r["season"], r["team"]): r["promoted"] for r in form.promoted(form.long_frame(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[(2018, "A")] is None and got[(2019, "E")] == 1.0 and got[(2019, "A")] == 0.0


def goal_fits(spark, broken=False):
    """Two checkpoints that all teams share; ``broken``: one team misses the second's rho."""
    rows = []
    for k, day in enumerate((dt.datetime(2018, 9, 20), dt.datetime(2019, 3, 1))):
        for i, t in enumerate(f"Team{c}" for c in "ABCDEFGH"):
            rows.append((t, day, 0.8 + i / 16 + k / 8, 1.3 - i / 32, 1.25 + k / 16, (-0.05 - k / 64) if not (broken and i == 2) else 0.02))
    return spark.createDataFrame(rows, "team string, from_date timestamp, attack double, defense double, home_advantage double, rho double")


def sides(rows, key):
    """Brute force of a match's side features from the rows that come before it."""
    match = next(r for r in rows if r[0] == key)

    def seen(team):
        return sorted((r[3], r[0], r[4] == team, r) for r in rows if team in (r[4], r[5]) and (r[3], r[0]) < (match[3], key))

    def stat(g, home, name):
        own, other = (6, 7) if home else (7, 6)
        x, y = (8, 9) if home else (9, 8)
        return {"goals_for": g[own], "goals_against": g[other], "xg_for": g[x], "xg_against": g[y], "points": 3.0 if g[own] > g[other] else 1.0 if g[own] == g[other] else 0.0}[name]

    out = {}
    for side, team in (("home", match[4]), ("away", match[5])):
        past = seen(team)
        for w in form.WINDOWS:
            for name in form.ROLL_STATS:
                last = past[-w:]
                out[f"{side}_{name}_r{w}"] = sum(stat(g, h, name) for _, _, h, g in last) / w if len(last) == w else None
            there = [p for p in past if p[2] == (side == "home")][-w:]
            out[f"{side}_venue_points_r{w}"] = sum(stat(g, h, "points") for _, _, h, g in there) / w if len(there) == w else None
    return match, out


def test_frame_with_goal_model_equals_brute_force(spark, matches, ratings):
    frame = {r["match_id"]: r.asDict() for r in form.build_features(matches, ratings, goal_fits=goal_fits(spark)).collect()}
    rows = games()
    assert frame.keys() == {r[0] for r in rows}
    same = lambda got, want: got is None if want is None else got == pytest.approx(want)
    less = lambda a, b: None if a is None or b is None else a - b
    for key in sorted(frame)[::7]:
        match, want = sides(rows, key)
        got = frame[key]
        assert all(same(got[c], v) for c, v in want.items())
        for w in form.WINDOWS:
            net = {(s, k): less(want[f"{s}_{k}_for_r{w}"], want[f"{s}_{k}_against_r{w}"]) for s in ("home", "away") for k in ("xg", "goals")}
            xg, goals = less(net["home", "xg"], net["away", "xg"]), less(net["home", "goals"], net["away", "goals"])
            assert same(got[f"xg_diff_r{w}"], xg) and same(got[f"goal_diff_r{w}"], goals) and same(got[f"xg_overperformance_r{w}"], less(goals, xg))
            assert same(got[f"venue_points_r{w}_diff"], less(want[f"home_venue_points_r{w}"], want[f"away_venue_points_r{w}"]))
        before = match[3] - dt.timedelta(days=1)
        k = (before >= dt.datetime(2018, 9, 20)) + (before >= dt.datetime(2019, 3, 1)) - 1
        if k < 0:
            assert got["home_attack"] is None and got["dc_lambda_home"] is None and got["dc_p_H"] is None
            continue
        i, j = ord(match[4][-1]) - 65, ord(match[5][-1]) - 65
        lh, la = (0.8 + i / 16 + k / 8) * (1.3 - j / 32) * (1.25 + k / 16), (0.8 + j / 16 + k / 8) * (1.3 - i / 32)
        assert (got["dc_lambda_home"], got["dc_lambda_away"], got["dc_goal_diff_expected"]) == pytest.approx((lh, la, lh - la))
        assert (got["attack_diff"], got["defense_diff"]) == pytest.approx(((i - j) / 16, (j - i) / 32))
        assert sum(got[f"dc_p_{o}"] for o in "HDA") == pytest.approx(1)


def test_frame_fails_where_sides_met_different_fits(spark, matches, ratings):
    with pytest.raises(Exception, match="home and away rho differ"):
        form.build_features(matches, ratings, goal_fits=goal_fits(spark, broken=True)).collect()


def _written_bytes(spark, df) -> int:
    """Bytes that all shuffles of a frame wrote, by the metrics of its executed plan."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    total, todo = 0, [qe.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.metrics().contains("shuffleBytesWritten"):
            total += node.metrics().apply("shuffleBytesWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_features_take_few_and_narrow_shuffles(spark):
    from fairline.plans import testmap

    d = "/root/testdata/sf0.01"
    assert _written_bytes(spark, form.build_features(testmap.matches(spark, d), testmap.ratings(spark, d))) < 5_500_000  # 7.6 million by five shuffles of ever wider rows
