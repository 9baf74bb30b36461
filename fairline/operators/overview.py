"""Counts and coverage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outcome_mix(df: DataFrame, keys: list[str] = [], target: str = "ftr") -> DataFrame:  # noqa: B006
    """Share of each outcome."""
    w = Window.partitionBy(*keys)
    return df.where(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(w))


def counts_by_season(df: DataFrame, leagues: list[str]) -> DataFrame:
    """Matches per season, one column per league."""
    return df.groupBy("season").pivot("league", leagues).agg(F.count(F.lit(1))).na.fill(0)


def market_summary(market: DataFrame) -> DataFrame:
    """Per quote source coverage, overround statistics, mean probabilities, Shin against multiplicative."""
    gap = F.greatest(*[F.abs(F.col(f"p_shin_{o}") - F.col(f"p_mult_{o}")) for o in "HDA"])
    return market.where("odds_source IS NOT NULL").groupBy("odds_source").agg(
        F.count("*").alias("n"), F.avg("overround").alias("mean_overround"), F.percentile("overround", F.lit(0.5)).alias("median_overround"), F.percentile("overround", F.lit(0.95)).alias("p95_overround"),
        *[F.avg(f"p_mult_{o}").alias(f"mean_p_{o}") for o in "HDA"], F.avg(gap).alias("mean_shin_gap"),
    )


def missing_rates(df: DataFrame, features: list[str]) -> DataFrame:
    """A10: share of nulls per feature, most first, in one pass."""
    wide = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "missing_rate").orderBy(F.desc("missing_rate"), "feature")
