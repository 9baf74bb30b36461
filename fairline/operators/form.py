"""Point-in-time features over the team-match long frame.

All team windows share the partitioning by team, which the as-of join by team leaves behind; an exchange by opponent before it
serves the opponent's rating, one by match_id the wide form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.goals import expected_goals, match_probabilities
from fairline.functions.scalar import elo_over_performance, outcome_code, points

ROLL_STATS = ("points", "goals_for", "goals_against", "xg_for", "xg_against")
WINDOWS = (5, 10)
REST_CAP_DAYS = 21
CONGESTION_DAYS = 14
EWMA_SPAN = 5
EWMA_ROWS = 100
MIN_HISTORY = 5
TEAM_ORDER = ("date", "match_id")


def long_frame(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per match, the away row with swapped statistics; both have the match's columns ``keep``."""

    def side(is_home: int) -> Column:
        own, other = ("home", "away") if is_home else ("away", "home")
        g, h = ("fthg", "ftag") if is_home else ("ftag", "fthg")
        return F.struct(
            F.lit(is_home).alias("is_home"), F.col(f"{own}_team").alias("team"), F.col(f"{other}_team").alias("opponent"), F.col(g).alias("goals_for"), F.col(h).alias("goals_against"),
            F.col(f"{own}_xg").alias("xg_for"), F.col(f"{other}_xg").alias("xg_against"), points(F.col(g), F.col(h)).alias("points"),
        )

    rows = matches.select("match_id", "league", "season", "date", *keep, F.explode(F.array(side(1), side(0))).alias("s"))
    return rows.select("match_id", "league", "season", "date", *keep, "s.*")


def lagged_mean(value: str | Column, w: int, *keys: str) -> Column:
    """Mean of the previous w values, null unless all w are there."""
    v = F.col(value) if isinstance(value, str) else value
    frame = Window.partitionBy(*keys).orderBy(*TEAM_ORDER).rowsBetween(-w, -1)
    return F.when(F.count(v).over(frame) == w, F.avg(v).over(frame))


def rolling_form(rows: DataFrame) -> DataFrame:
    """Rolling means, rest days, prior-match counts."""
    team = Window.partitionBy("team").orderBy(*TEAM_ORDER)
    season = Window.partitionBy("team", "season").orderBy(*TEAM_ORDER)
    gap = F.floor((F.unix_timestamp("date") - F.unix_timestamp(F.lag("date").over(team))) / 86400)
    return rows.withColumns(
        {
            **{f"{s}_r{w}": lagged_mean(s, w, "team") for s in ROLL_STATS for w in WINDOWS},
            "rest_days": F.when(gap.isNotNull(), F.least(gap, F.lit(REST_CAP_DAYS))).cast("double"),
            "n_prior": F.row_number().over(team) - 1,
            "n_prior_in_season": F.row_number().over(season) - 1,
        }
    )


def asof(rows: DataFrame, facts: DataFrame, values: list[str], at: str, since: Column, key: str = "team", fact_key: str | None = None) -> DataFrame:
    """The latest fact per key with ``since`` <= ``at``; a null value in that fact stays null. ``fact_key``: the key's name in ``facts``, if another.

    Both sides are united and one window per key carries the last fact forward: one sort,
    linear in the rows. Of facts with equal ``since`` the one ordered last by value wins.
    Key and time are no part of the packed row: what follows by the same key needs no shuffle of its own.
    """
    packed, rest = F.struct(*[F.col(v) for v in values]), [c for c in rows.columns if c not in (key, at)]
    left = rows.select(F.col(key), F.col(at), F.lit(1).alias("__side"), F.lit(None).cast(facts.select(packed).schema[0].dataType).alias("__fact"), F.struct(*rest).alias("__row"))
    right = facts.select(F.col(fact_key or key).alias(key), since.cast(left.schema[at].dataType).alias(at), F.lit(0).alias("__side"), packed.alias("__fact"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(key).orderBy(at, "__side", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__last", F.last("__fact", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*[F.col(c) if c in (key, at) else F.col(f"__row.{c}") for c in rows.columns], *[F.col(f"__last.{v}").alias(v) for v in values])


def _known() -> Column:
    """A fact counts for kickoffs from a day after it on."""
    return F.expr("cast(from_date as timestamp) + interval 1 day")


def attach_elo(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rating known a day before kickoff; ``to_date`` is not looked at."""
    return asof(rows, ratings, ["elo"], "date", _known())


def attach_opponent_elo(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """J7 before J5: ``opp_elo`` from the opponent's own ratings, as both rows of a match have one date."""
    return asof(rows, ratings.withColumnRenamed("elo", "opp_elo"), ["opp_elo"], "date", _known(), key="opponent", fact_key="team")


def attach_goal_ratings(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Attack, defense, home_advantage and rho known a day before kickoff."""
    return asof(rows, ratings, ["attack", "defense", "home_advantage", "rho"], "date", _known())


def opponent_elo(rows: DataFrame) -> DataFrame:
    """The other row's rating, in one window over the match."""
    w = Window.partitionBy("match_id")
    other = lambda side: F.max(F.when(F.col("is_home") == side, F.col("elo"))).over(w)
    return rows.withColumn("opp_elo", F.when(F.col("is_home") == 1, other(0)).otherwise(other(1)))


def ewma_points(span: int = EWMA_SPAN, rows: int = EWMA_ROWS) -> Column:
    """Adjusted exponentially weighted mean of earlier points; the last ``rows`` carry all weight that doubles hold."""
    decay = 1.0 - 2.0 / (span + 1)
    w = Window.partitionBy("team").orderBy(*TEAM_ORDER).rowsBetween(-rows, -1)
    past = F.collect_list("points").over(w)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    step = lambda acc, x: F.struct((acc["n"] * decay + x).alias("n"), (acc["d"] * decay + 1.0).alias("d"))
    return F.when(F.size(past) > 0, F.aggregate(past, zero, step, lambda acc: acc["n"] / acc["d"]))


def derived_form(rows: DataFrame) -> DataFrame:
    """Needs elo and opp_elo."""
    team = Window.partitionBy("team").orderBy(*TEAM_ORDER)
    season = Window.partitionBy("team", "season").orderBy(*TEAM_ORDER)
    before = Window.partitionBy("team").orderBy(F.unix_timestamp("date")).rangeBetween(Window.unboundedPreceding, -CONGESTION_DAYS * 86400 - 1)
    rows = rows.withColumn("elo_over", elo_over_performance(F.col("points"), F.col("elo"), F.col("opp_elo"))).withColumn("goal_diff", F.col("goals_for") - F.col("goals_against"))
    earlier = F.sum("points").over(season.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns(
        {
            **{f"opp_elo_r{w}": lagged_mean("opp_elo", w, "team") for w in WINDOWS},
            **{f"elo_over_r{w}": lagged_mean("elo_over", w, "team") for w in WINDOWS},
            **{f"venue_points_r{w}": lagged_mean("points", w, "team", "is_home") for w in WINDOWS},
            **{f"venue_goal_diff_r{w}": lagged_mean("goal_diff", w, "team", "is_home") for w in WINDOWS},
            "ewma_points": ewma_points(),
            "matches_14d": (F.row_number().over(team) - 1 - F.count("*").over(before)).cast("int"),
            "season_ppg": F.try_divide(earlier, (F.row_number().over(season) - 1).cast("double")),
        }
    )


def promoted(rows: DataFrame, seasons: DataFrame | None = None) -> DataFrame:
    """1 if the team was absent from the league a season before; null in the first season of all.

    ``seasons``: any table with all seasons of the rows, where that is less to read again than the rows.
    """
    first = rows.agg(F.min("season").alias("__first")) if seasons is None else seasons.agg(F.min("season").alias("__first"))
    before = Window.partitionBy("team", "league").orderBy("season").rangeBetween(-1, -1)
    flagged = rows.withColumn("__had", F.count("*").over(before)).join(F.broadcast(first))
    return flagged.withColumn("promoted", F.when(F.col("season") > F.col("__first"), F.when(F.col("__had") == 0, 1.0).otherwise(0.0))).drop("__had", "__first")


SIDE_FEATURES = (
    "elo", *(f"{s}_r{w}" for s in ROLL_STATS for w in WINDOWS), "opp_elo_r5", "opp_elo_r10", "elo_over_r5", "elo_over_r10", "venue_points_r5", "venue_points_r10", "venue_goal_diff_r5", "venue_goal_diff_r10",
    "ewma_points", "matches_14d", "season_ppg", "promoted", "rest_days", "n_prior", "n_prior_in_season",
)
GOAL_RATINGS = ("attack", "defense", "home_advantage", "rho")
#: Side features of which the frame holds home minus away.
COMPARED = ("elo", "rest_days", "ewma_points", "season_ppg", "matches_14d", *(f"{s}_r{w}" for s in ("points", "venue_points", "elo_over", "opp_elo") for w in WINDOWS))


def wide_frame(rows: DataFrame, features: tuple[str, ...] = SIDE_FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Home and away rows back to one row per match, in one aggregation; league, season, date and ``keep`` are the home row's.

    Rows are dealt by match before they are aggregated: a row travels with its own features, not with places for those of both sides.
    """
    pick = lambda c, side: F.max(F.when(F.col("is_home") == side, F.col(c)))
    aggs = [pick(c, 1).alias(f"home_{c}") for c in features] + [pick(c, 0).alias(f"away_{c}") for c in features]
    shared = ("league", "season", "date", *keep)
    met = rows.select("match_id", *[F.when(F.col("is_home") == 1, F.col(c)).alias(c) for c in shared], "is_home", *features).repartition("match_id")
    wide = met.groupBy("match_id").agg(*[F.max(c).alias(c) for c in shared], *aggs)
    return wide.select("match_id", "league", "season", "date", *[c for c in wide.columns if c not in ("match_id", *shared)], *keep)


def differentials(wide: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Home minus away per feature; of net xG, net goals, and net goals over net xG."""
    out = {f"{c}_diff": F.col(f"home_{c}") - F.col(f"away_{c}") for c in features}
    for w in WINDOWS:
        net = lambda side, stat: F.col(f"{side}_{stat}_for_r{w}") - F.col(f"{side}_{stat}_against_r{w}")  # noqa: E731, B023
        if f"home_xg_for_r{w}" in wide.columns:
            xg, goals = net("home", "xg") - net("away", "xg"), net("home", "goals") - net("away", "goals")
            out |= {f"xg_diff_r{w}": xg, f"goal_diff_r{w}": goals, f"xg_overperformance_r{w}": goals - xg}
    return wide.withColumns(out)


def goal_features(wide: DataFrame) -> DataFrame:
    """Expected goals and goal-model probabilities from home_/away_ rating columns."""
    lh, la = expected_goals(*[F.col(c) for c in ("home_attack", "home_defense", "away_attack", "away_defense", "home_home_advantage")])
    out = wide.withColumns({"dc_lambda_home": lh, "dc_lambda_away": la, "dc_goal_diff_expected": lh - la})
    return out.withColumn("__p", match_probabilities("dc_lambda_home", "dc_lambda_away", "home_rho")).withColumns({f"dc_p_{o}": F.nanvl(F.col(f"__p.{o}"), F.lit(None).cast("double")) for o in "HDA"}).drop("__p")


def consistent(column: str, tolerance: float = 1e-9) -> Column:
    """W13 inside a job: the home copy of a global parameter; the job that reads it fails where the away copy differs."""
    home, away = F.col(f"home_{column}"), F.col(f"away_{column}")
    differ = F.raise_error(F.lit(f"home and away {column} differ")).cast("double")
    return F.when(F.abs(home - away) > tolerance, differ).otherwise(home)


def require_consistent(wide: DataFrame, column: str, tolerance: float = 1e-9) -> None:
    """Raise if home and away copies of a global parameter differ."""
    bad = wide.where(F.abs(F.col(f"home_{column}") - F.col(f"away_{column}")) > tolerance).limit(1).count()
    if bad:
        raise ValueError(f"home and away {column} differ")


def build_features(matches: DataFrame, ratings: DataFrame, upcoming: DataFrame | None = None, goal_fits: DataFrame | None = None) -> DataFrame:
    """The wide features of matches or, in scoring mode, of ``upcoming`` rows only (null outcomes).

    With ``goal_fits`` (J6: team, from_date, attack, defense, home_advantage, rho) the frame also has the
    goal model's ratings, their differences, expected goals and probabilities. Both sides of a match
    must have met one fit: the job fails otherwise (W13). Sides without a fit have nulls there.
    """
    every = matches if upcoming is None else matches.unionByName(upcoming, allowMissingColumns=True)
    keep = ("ftr",) if upcoming is None else ()
    # Two shuffles of plain rows, by opponent and by team; every team window follows the second. Points follow from goals.
    rows = attach_elo(attach_opponent_elo(long_frame(every, keep).drop("points"), ratings).drop("opponent"), ratings)
    if goal_fits is not None:
        rows = attach_goal_ratings(rows, goal_fits)
    rows = rows.withColumn("points", points(F.col("goals_for"), F.col("goals_against")))
    rows = promoted(derived_form(rolling_form(rows)), every)
    wide = wide_frame(rows, SIDE_FEATURES if goal_fits is None else (*SIDE_FEATURES, *GOAL_RATINGS), keep)
    if goal_fits is None:
        wide = differentials(wide, COMPARED)
    else:
        wide = wide.withColumns({f"home_{c}": consistent(c) for c in GOAL_RATINGS[2:]})
        wide = goal_features(differentials(wide, (*COMPARED, "attack", "defense")))
    if upcoming is not None:
        return wide.join(upcoming.select("match_id"), "match_id", "left_semi")
    return wide.select(*[c for c in wide.columns if c != "ftr"], outcome_code(F.col("ftr")).alias("target"), "ftr")


def with_history(wide: DataFrame, least: int = MIN_HISTORY) -> DataFrame:
    """P20: both sides have at least ``least`` earlier matches."""
    return wide.where((F.col("home_n_prior") >= least) & (F.col("away_n_prior") >= least))


def complete(wide: DataFrame) -> Column:
    """All rolling features and both ratings are there."""
    need = [c for c in wide.columns if c.endswith(("_r5", "_r10"))] + ["home_elo", "away_elo"]
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    return ok


def leakage_audit(wide: DataFrame, rows: DataFrame, samples: int = 250, tolerance: float = 1e-9) -> int:
    """Recompute last-5 points of sampled home rows from strictly earlier dates; raises on a mismatch.

    Written with a join and a ranking, apart from the window code that it audits. Returns the sample size.
    """
    taken = wide.where("home_points_r5 is not null").orderBy(F.xxhash64("match_id"), "match_id").limit(samples).select("match_id", "home_points_r5")
    at = rows.where("is_home = 1").join(F.broadcast(taken), "match_id").select(F.col("match_id").alias("m"), F.col("team").alias("t"), F.col("date").alias("d"), "home_points_r5")
    past = rows.join(F.broadcast(at), (F.col("team") == F.col("t")) & (F.col("date") < F.col("d")))
    last = past.withColumn("k", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("date"), F.desc("match_id")))).where("k <= 5")
    got = last.groupBy("m").agg(F.avg("points").alias("again"), F.count("*").alias("n"), F.first("home_points_r5").alias("said"))
    n, bad = got.agg(F.count("*"), F.coalesce(F.sum(((F.col("n") < 5) | (F.abs(F.col("again") - F.col("said")) > tolerance)).cast("int")), F.lit(0))).first()
    if bad:
        raise ValueError(f"{bad} of {n} audited rows use more than the past")
    return n
