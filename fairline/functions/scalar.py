"""Scalar expressions: dates, seasons, ids, points, outcome codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ("H", "D", "A")


def parse_date(raw: Column) -> Column:
    """day/month/four-digit year first, then two-digit year; null for anything else."""
    text = F.trim(raw)
    return F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text), F.lit("d/M/yyyy")), F.try_to_timestamp(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), text), F.lit("d/M/yy"))).cast("date")


def season_of(date: Column) -> Column:
    """The year in which the season of a date began; July starts a new one."""
    return (F.year(date) - F.when(F.month(date) < 7, 1).otherwise(0)).cast("int")


def season_code(season: Column) -> Column:
    """2018 -> 1819."""
    return F.concat(F.lpad((season % 100).cast("string"), 2, "0"), F.lpad(((season + 1) % 100).cast("string"), 2, "0"))


def season_label(season: Column) -> Column:
    """2018 -> 2018-19."""
    return F.concat(season.cast("string"), F.lit("-"), F.lpad(((season + 1) % 100).cast("string"), 2, "0"))


def match_id(league: Column, season: Column, home: Column, away: Column) -> Column:
    """league_season_home_away, spaces removed from names."""
    return F.concat_ws("_", league, season.cast("string"), F.regexp_replace(home, " ", ""), F.regexp_replace(away, " ", ""))


def points(goals_for: Column, goals_against: Column) -> Column:
    """P10: 3, 1 or 0; unplayed rows (null goals) give 0."""
    return F.when(goals_for > goals_against, 3.0).when(goals_for == goals_against, 1.0).otherwise(0.0)


def elo_expectation(own: Column, opponent: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (opponent - own) / 400.0))


def elo_over_performance(points_col: Column, own: Column, opponent: Column) -> Column:
    """Result score minus its expectation."""
    return F.when(points_col == 3, 1.0).when(points_col == 1, 0.5).otherwise(0.0) - elo_expectation(own, opponent)


def outcome_code(ftr: Column) -> Column:
    """H, D, A -> 0, 1, 2."""
    return F.when(ftr == "H", 0).when(ftr == "D", 1).when(ftr == "A", 2).cast("int")


def best_edge(edges: list[Column], names: tuple[str, ...] = OUTCOMES) -> tuple[Column, Column]:
    """(largest edge ignoring nulls, its outcome; the first wins ties)."""
    top = F.greatest(*edges)
    which = F.coalesce(*[F.when(e == top, F.lit(n)) for e, n in zip(edges, names)])
    return top, which
