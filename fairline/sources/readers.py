"""Readers for landed files (S1-S11): CSVs whose headers drift, nested JSON, rating histories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.functions.odds import normalised_triple
from fairline.functions.scalar import match_id, parse_date, season_of

#: Quote prefixes that a results file may carry, and its core columns.
PREFIXES = ("B365", "PS", "Max", "Avg", "B365C", "PSC", "MaxC", "AvgC", "BbAv", "BbMx")
CORE = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR")
RESULTS = "league string, season int, date date, home_team string, away_team string, fthg double, ftag double, ftr string"


def _clean(first: str) -> str:
    return first.removeprefix("ï»¿").removeprefix("﻿").strip("\r")


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.option("encoding", "ISO-8859-1").text(path).first()
    return "" if first is None else _clean(first[0])


def _table(spark: SparkSession, paths: list[str], header: str, uri: str | None = None) -> DataFrame:
    """Files of one header: short lines are padded with nulls, lines that are too long are dropped; ``uri`` names a column for the file."""
    names = [c.strip() or f"_blank{i}" for i, c in enumerate(header.split(","))]
    fields = [T.StructField(n if n not in names[:i] else f"{n}_{i}", T.StringType()) for i, n in enumerate(names)] + [T.StructField("__extra", T.StringType())]
    df = spark.read.csv(paths, schema=T.StructType(fields), header=False, encoding="ISO-8859-1", mode="PERMISSIVE", enforceSchema=True)
    if uri:
        df = df.withColumn(uri, file_of())
    return df.where(F.col("__extra").isNull() & ~F.coalesce(F.regexp_replace(F.col(fields[0].name), "^(ï»¿|﻿)", "") == F.lit(names[0]), F.lit(False))).drop("__extra")


def _quotes(df: DataFrame) -> list[Column]:
    """The H/D/A triple of every prefix whose three columns are all there."""
    return [F.expr(f"try_cast(`{p}{o}` AS double)").alias(f"odds_{p}_{o}") for p in PREFIXES if all(f"{p}{x}" in df.columns for x in "HDA") for o in "HDA"]


#: "file:///x" and "file:/x" are one file: an empty authority is left out.
BARE = (r"^([A-Za-z0-9+.-]+):///", "$1:/")


def file_of() -> Column:
    return F.regexp_replace("_metadata.file_path", *map(F.lit, BARE))


def file_uri(spark: SparkSession, path: str) -> str:
    """A path as ``file_of`` shows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri().toString()
    return re.sub(BARE[0], r"\1:/", uri)


def headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """URI to first line of every file that has one, by one job; one short row per named file reaches the driver."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(paths)
    # Only the first split of a file begins with its first line; within a split, row ids ascend.
    first = lines.select(file_of().alias("uri"), F.col("_metadata.file_block_start").alias("start"), "value").where("start = 0").withColumn("at", F.monotonically_increasing_id())
    return {r["uri"]: _clean(r["value"]) for r in first.groupBy("uri").agg(F.min_by("value", "at").alias("value")).collect()}


def read_results(spark: SparkSession, files: dict[tuple[str, int], str]) -> DataFrame:
    """(league, season) -> path. Files without a core column, and empty ones, are skipped.

    One job reads all headers; then there is one scan per distinct header, and a row's file says its league and season.
    """
    if not files:
        return spark.createDataFrame([], RESULTS)
    uris = {file_uri(spark, p): (p, *k) for k, p in files.items()}
    if len(uris) < len(files):
        raise ValueError("one file under two keys")
    groups: dict[str, list[str]] = {}
    for uri, header in headers(spark, list(files.values())).items():
        if set(CORE) <= {c.strip() for c in header.split(",")}:
            groups.setdefault(header, []).append(uris[uri][0])
    where = F.broadcast(spark.createDataFrame([(u, k[1], int(k[2])) for u, k in uris.items()], "__uri string, league string, season int"))  # as many rows as files named
    parts = []
    for header, paths in sorted(groups.items()):
        raw = _table(spark, paths, header, "__uri").join(where, "__uri")
        row = raw.select(
            "league", "season", parse_date(F.col("Date")).alias("date"), F.trim("HomeTeam").alias("home_team"), F.trim("AwayTeam").alias("away_team"),
            F.expr("try_cast(FTHG AS double)").alias("fthg"), F.expr("try_cast(FTAG AS double)").alias("ftag"), F.upper(F.trim("FTR")).alias("ftr"), *_quotes(raw),
        )
        parts.append(row.where("date IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL AND ftr IN ('H', 'D', 'A')"))
    if not parts:
        return spark.createDataFrame([], RESULTS)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


XG_JSON = "dates array<struct<isResult:boolean,datetime:string,h:struct<title:string>,a:struct<title:string>,goals:struct<h:string,a:string>,xG:struct<h:string,a:string>>>"


def read_xg(spark: SparkSession, path: str, league: str, season: int) -> DataFrame:
    """Played matches with their xG; records that miss a required field are dropped."""
    m = spark.read.schema(XG_JSON).option("multiLine", True).json(path).select(F.explode("dates").alias("m")).where("m.isResult")
    num = lambda c, t: F.expr(f"try_cast({c} AS {t})")
    when = F.try_to_timestamp(F.col("m.datetime"), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = m.select(
        F.lit(league).alias("league"), F.lit(season).alias("season"), when.alias("kickoff"), F.date_trunc("day", when).alias("date"), F.col("m.h.title").alias("home_team"), F.col("m.a.title").alias("away_team"),
        num("m.goals.h", "int").alias("home_goals"), num("m.goals.a", "int").alias("away_goals"), num("m.xG.h", "double").alias("home_xg"), num("m.xG.a", "double").alias("away_xg"),
    )
    return out.dropna()


def read_ratings(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rank "None" becomes null; unreadable dates and ratings too."""
    raw = spark.read.csv(paths, header=True, schema="Rank string, Club string, Country string, Level string, Elo string, `From` string, `To` string")
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date")
    return raw.select(F.expr("try_cast(Rank AS int)").alias("rank"), F.col("Club").alias("club_raw"), F.col("Country").alias("country"), F.expr("try_cast(Level AS int)").alias("level"), F.expr("try_cast(Elo AS double)").alias("elo"), day("From").alias("from_date"), day("To").alias("to_date"))


def discover_clubs(snapshots: DataFrame, countries: tuple[str, ...], date: str = "snapshot_date") -> DataFrame:
    """Level-1 clubs of the countries with the country of their first snapshot."""
    return snapshots.where((F.col("level") == 1) & F.col("country").isin(*countries)).groupBy("club_raw").agg(F.min_by("country", date).alias("country"))


def trim_ratings(ratings: DataFrame, first_season: int, last_season: int, leagues: dict[str, str]) -> DataFrame:
    """Rows that overlap [first - 1 year, last + 2 years]; country to league, others dropped."""
    look = F.create_map(*[F.lit(x) for kv in leagues.items() for x in kv])
    kept = ratings.where((F.col("to_date") >= F.make_date(F.lit(first_season - 1), F.lit(1), F.lit(1))) & (F.col("from_date") <= F.make_date(F.lit(last_season + 2), F.lit(12), F.lit(31))))
    return kept.withColumn("league", F.try_element_at(look, F.col("country"))).where("league IS NOT NULL")


def read_fixtures(spark: SparkSession, path: str, leagues: tuple[str, ...]) -> DataFrame:
    """Upcoming matches of known leagues; BOM stripped, whatever quote prefixes exist carried."""
    header = _header(spark, path)
    raw = _table(spark, [path], header)
    date = parse_date(F.col("Date"))
    time = F.col("Time") if "Time" in raw.columns else F.lit(None).cast("string")
    season, home, away = season_of(date), F.trim("HomeTeam"), F.trim("AwayTeam")
    out = raw.select(match_id(F.col("Div"), season, home, away).alias("match_id"), F.col("Div").alias("league"), season.alias("season"), date.cast("timestamp").alias("date"), home.alias("home_team"), away.alias("away_team"), time.alias("kickoff_time"), *_quotes(raw))
    return out.where(F.col("league").isin(*leagues) & F.col("date").isNotNull() & F.col("home_team").isNotNull() & F.col("away_team").isNotNull())


VENUE_A = "events array<struct<event:string,title:string,markets:array<struct<label:string,yes_bid:double,yes_ask:double,last_price:double>>>>"


def _triples(rows: DataFrame, keys: list[str], more_sides: bool) -> DataFrame:
    """Price rows (keys, pos, label, price) to (sides, pm_p_H/D/A): draw by label, the last one counts; sides in array order."""
    drawn = F.lower("label").rlike("draw|tie")
    side = F.when(~drawn, F.col("pos"))
    g = rows.groupBy(*keys).agg(
        F.count(side).alias("n"), F.min_by("price", side).alias("h"), F.max_by("price", side).alias("a"), F.min_by("label", side).alias("hl"), F.max_by("label", side).alias("al"),
        F.max_by("price", F.when(drawn, F.col("pos"))).alias("d"),
    )
    g = g.where("n >= 2" if more_sides else "n = 2")
    names = ("pm_p_H", "pm_p_D", "pm_p_A")
    return g.select(*keys, F.array("hl", "al").alias("sides"), *[c.alias(n) for c, n in zip(normalised_triple(F.col("h"), F.col("d"), F.col("a")), names)]).dropna(subset=list(names))


def read_venue_a(spark: SparkSession, path: str) -> DataFrame:
    """Mid price (bid + ask) / 200, else last / 100; exactly two sides besides the draw."""
    e = spark.read.schema(VENUE_A).option("multiLine", True).json(path).select(F.explode("events").alias("e"))
    m = e.select(F.lit("venue_a").alias("source"), F.col("e.event").alias("event"), F.col("e.title").alias("title"), F.posexplode("e.markets").alias("pos", "m"))
    mid = F.coalesce((F.col("m.yes_bid") + F.col("m.yes_ask")) / 200, F.col("m.last_price") / 100)
    return _triples(m.select("source", "event", "title", "pos", F.col("m.label").alias("label"), mid.alias("price")), ["source", "event", "title"], False)


VENUE_B = "id string, title string, markets array<struct<label:string,prices:string>>"


def read_venue_b(spark: SparkSession, path: str) -> DataFrame:
    """Titles with " vs" in any case; the first of a JSON list of price strings; the last non-draw is the away side."""
    e = spark.read.schema(VENUE_B).option("multiLine", True).json(path).where(F.lower("title").contains(" vs"))
    m = e.select(F.lit("venue_b").alias("source"), F.col("id").alias("event"), "title", F.posexplode("markets").alias("pos", "m"))
    price = F.get(F.from_json("m.prices", "array<string>"), F.lit(0)).try_cast("double")
    return _triples(m.select("source", "event", "title", "pos", F.col("m.label").alias("label"), price.alias("price")).where("price IS NOT NULL"), ["source", "event", "title"], True)


ALIASES = "source string, league string, raw_name string, canonical_name string, note string"


def read_manual_aliases(spark: SparkSession, path: str | None) -> DataFrame:
    """Score 100, status manual; an empty table if there is no file."""
    rows = spark.read.csv(path, header=True, schema=ALIASES) if path else spark.createDataFrame([], ALIASES)
    return rows.withColumns({"score": F.lit(100.0), "status": F.lit("manual")})


def numbered(candidates: DataFrame) -> DataFrame:
    """Adds ``ordinal`` to venue candidates, in (source, event) order; candidates are a short list."""
    return candidates.withColumn("ordinal", F.row_number().over(Window.orderBy("source", "event")))
