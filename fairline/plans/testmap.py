"""Match tables derived from the TPC-H-like tables, in Spark and as the same DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MATCHES_SQL = """
tt AS (SELECT greatest(100, 5 * (count(*) // 150)) AS t FROM customer),
o AS (
  SELECT o_orderkey AS id, o_orderdate + to_seconds(o_orderkey % 86400) AS kickoff, o_custkey % 5 AS lg, o_totalprice AS price, t,
    year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS season, o_custkey % t AS h
  FROM orders, tt),
o2 AS (SELECT *, (h + 5 * (1 + id % (t // 5 - 1))) % t AS a FROM o),
matches AS (
  SELECT 'L' || lg || '_' || season || '_T' || h || '_T' || a AS match_id, 'L' || lg AS league, season::INT AS season, kickoff AS date, 'T' || h AS home_team, 'T' || a AS away_team,
    ((id // 3) % 4)::DOUBLE AS fthg, ((id // 7 + floor(price)::BIGINT) % 3)::DOUBLE AS ftag,
    CASE WHEN id % 20 <> 0 THEN ((id // 3) % 4) * 0.75 + (id % 8) / 8.0 END AS home_xg, CASE WHEN id % 20 <> 0 THEN ((id // 7 + floor(price)::BIGINT) % 3) * 0.75 + (id % 4) / 4.0 END AS away_xg,
    CASE WHEN (id // 3) % 4 > (id // 7 + floor(price)::BIGINT) % 3 THEN 'H' WHEN (id // 3) % 4 = (id // 7 + floor(price)::BIGINT) % 3 THEN 'D' ELSE 'A' END AS ftr, id
  FROM o2
  QUALIFY row_number() OVER (PARTITION BY lg, season, h, a ORDER BY kickoff, id) = 1),
quotes AS (
  SELECT match_id, CASE WHEN id % 17 <> 0 THEN 1.5 + (id % 40) / 16.0 END AS odds_PSC_H, CASE WHEN id % 17 <> 0 THEN 2.5 + (id % 24) / 16.0 END AS odds_PSC_D, CASE WHEN id % 17 <> 0 THEN 1.75 + (id % 56) / 16.0 END AS odds_PSC_A,
    1.25 + q / 16.0 AS odds_AvgC_H, 2.25 + q / 32.0 AS odds_AvgC_D, 1.5 + q / 8.0 AS odds_AvgC_A
  FROM matches JOIN (SELECT l_orderkey, sum(l_quantity)::BIGINT % 40 AS q FROM lineitem GROUP BY 1) ON l_orderkey = id),
ratings AS (
  SELECT team, league, 1::INT AS level, 1400 + n * 7 % 400 + q AS elo, from_date, from_date + INTERVAL 91 DAY AS to_date
  FROM (SELECT DISTINCT home_team AS team, league, substr(home_team, 2)::BIGINT AS n FROM matches), (SELECT q, TIMESTAMP '1995-01-01' + to_days((q * 92)::INT) AS from_date FROM range(0, 28) r(q)))
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a match: some meet again."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    t = max(100, 5 * (n // 150))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), (F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400).cast("timestamp").alias("date"), (F.col("o_custkey") % 5).alias("lg"),
        F.floor("o_totalprice").alias("price"), (F.year("o_orderdate") - F.when(F.month("o_orderdate") < 7, 1).otherwise(0)).cast("int").alias("season"), (F.col("o_custkey") % t).alias("h"),
    )
    return o.withColumn("a", (F.col("h") + 5 * (1 + F.col("id") % (t // 5 - 1))) % t)


def _team(c: str) -> Column:
    return F.concat(F.lit("T"), F.col(c).cast("string"))


def _league() -> Column:
    return F.concat(F.lit("L"), F.col("lg").cast("string"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, league, season, date, teams, goals, xG, result, id: a double round robin per season."""
    o = _orders(spark, sf_dir)
    first = Window.partitionBy("lg", "season", "h", "a").orderBy("date", "id")
    hg, ag = F.expr("id div 3 % 4"), F.expr("(id div 7 + price) % 3")
    known = F.col("id") % 20 != 0
    return o.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(
        F.concat_ws("_", _league(), F.col("season").cast("string"), _team("h"), _team("a")).alias("match_id"), _league().alias("league"), "season", "date", _team("h").alias("home_team"), _team("a").alias("away_team"),
        hg.cast("double").alias("fthg"), ag.cast("double").alias("ftag"), F.when(known, hg * 0.75 + (F.col("id") % 8) / 8.0).alias("home_xg"), F.when(known, ag * 0.75 + (F.col("id") % 4) / 4.0).alias("away_xg"),
        F.when(hg > ag, "H").when(hg == ag, "D").otherwise("A").alias("ftr"), "id",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id and two quote triples; the PSC triple is missing for every seventeenth id."""
    q = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg((F.sum("l_quantity").cast("long") % 40).alias("q"))
    m = matches(spark, sf_dir).select("match_id", "id").join(q, F.col("id") == F.col("l_orderkey"))
    there = F.col("id") % 17 != 0
    return m.select(
        "match_id", F.when(there, 1.5 + (F.col("id") % 40) / 16.0).alias("odds_PSC_H"), F.when(there, 2.5 + (F.col("id") % 24) / 16.0).alias("odds_PSC_D"), F.when(there, 1.75 + (F.col("id") % 56) / 16.0).alias("odds_PSC_A"),
        (1.25 + F.col("q") / 16.0).alias("odds_AvgC_H"), (2.25 + F.col("q") / 32.0).alias("odds_AvgC_D"), (1.5 + F.col("q") / 8.0).alias("odds_AvgC_A"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly rating epochs per team."""
    # Of orders that meet again one stays, so the clubs are those of all orders.
    teams = _orders(spark, sf_dir).select(_team("h").alias("team"), _league().alias("league")).distinct().withColumn("n", F.expr("cast(substr(team, 2) as bigint)"))
    epochs = teams.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(27))))
    start = F.expr("cast(date_add(date'1995-01-01', q * 92) as timestamp)")
    return epochs.select("team", "league", F.lit(1).alias("level"), (1400 + F.col("n") * 7 % 400 + F.col("q")).cast("double").alias("elo"), start.alias("from_date"), (start + F.expr("interval 91 days")).alias("to_date"))


PREDICTIONS_SQL = """
tracks AS (SELECT * FROM (VALUES ('market_blind', 'linear', 0), ('market_aware', 'trees', 3)) v(track, model, k)),
predictions AS (
  SELECT track, model, 'wf_' || season AS fold, match_id, league, season, date, CASE ftr WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS y_true,
    (8 + (id + k) % 9) / s AS p_H, (4 + (id + k) % 5) / s AS p_D, (6 + (id + 2 * k) % 7) / s AS p_A,
    (1 / h) / o AS p_market_H, (1 / d) / o AS p_market_D, (1 / a) / o AS p_market_A,
    0.25 + ((id % 3) / 8.0) AS dc_p_H, 0.25 AS dc_p_D, 0.5 - ((id % 3) / 8.0) AS dc_p_A,
    h AS odds_H, d AS odds_D, a AS odds_A, CASE WHEN id % 3 <> 0 THEN h * 1.0625 END AS odds_open_H, CASE WHEN id % 3 <> 0 THEN d * 0.9375 END AS odds_open_D, CASE WHEN id % 3 <> 0 THEN a * 1.03125 END AS odds_open_A
  FROM (
    SELECT m.*, t.*, 18.0 + (id + k) % 9 + (id + k) % 5 + (id + 2 * k) % 7 AS s, odds_AvgC_H + 0.5 AS h, odds_AvgC_D + 0.5 AS d, odds_AvgC_A + 0.5 AS a, 1 / (odds_AvgC_H + 0.5) + 1 / (odds_AvgC_D + 0.5) + 1 / (odds_AvgC_A + 0.5) AS o
    FROM matches m JOIN quotes USING (match_id), tracks t WHERE season >= 1997))
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic prediction records of two configurations, folds by season."""
    m = matches(spark, sf_dir).where("season >= 1997").join(quotes(spark, sf_dir), "match_id")
    configs = F.explode(F.array(*[F.struct(F.lit(t).alias("track"), F.lit(n).alias("model"), F.lit(k).alias("k")) for t, n, k in (("market_blind", "linear", 0), ("market_aware", "trees", 3))]))
    m = m.withColumn("c", configs).select("*", "c.*")
    i, k = F.col("id"), F.col("k")
    m = m.withColumns({"s": 18.0 + (i + k) % 9 + (i + k) % 5 + (i + 2 * k) % 7, **{f"odds_{o}": F.col(f"odds_AvgC_{o}") + 0.5 for o in "HDA"}})
    m = m.withColumn("o", 1 / F.col("odds_H") + 1 / F.col("odds_D") + 1 / F.col("odds_A"))
    return m.select(
        "track", "model", F.concat(F.lit("wf_"), F.col("season").cast("string")).alias("fold"), "match_id", "league", "season", "date", F.when(F.col("ftr") == "H", 0).when(F.col("ftr") == "D", 1).otherwise(2).alias("y_true"),
        ((8 + (i + k) % 9) / F.col("s")).alias("p_H"), ((4 + (i + k) % 5) / F.col("s")).alias("p_D"), ((6 + (i + 2 * k) % 7) / F.col("s")).alias("p_A"),
        *[((1 / F.col(f"odds_{o}")) / F.col("o")).alias(f"p_market_{o}") for o in "HDA"],
        (0.25 + (i % 3) / 8.0).alias("dc_p_H"), F.lit(0.25).alias("dc_p_D"), (0.5 - (i % 3) / 8.0).alias("dc_p_A"),
        "odds_H", "odds_D", "odds_A", *[F.when(i % 3 != 0, F.col(f"odds_{o}") * f).alias(f"odds_open_{o}") for o, f in (("H", 1.0625), ("D", 0.9375), ("A", 1.03125))],
    )
