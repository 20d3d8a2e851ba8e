"""Lists and counts over the results of the detectors."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.boxline import progress_percent
from formline.operators.filters import recent
from formline.operators.paging import top_entries
from formline.operators.streaks import SHOOTING_TYPES
from formline.session import shared_dir

RECENT_DAYS = 7


def top_league_outliers(
    outliers: DataFrame, active: DataFrame, window: str = "season", season: str | None = None, limit: int = 10,
    newest: DataFrame | None = None, when: str = "game_date",
) -> DataFrame:
    """Most extreme lines of active players in a window, with the three features that explain most.

    The window counts back from the newest day of ``newest`` (all games), by default of the outliers.
    """
    rows = outliers.filter("is_outlier").join(active.select("player_id").distinct(), "player_id", "left_semi")
    rows = _window(rows, newest, window, season, when)
    return (
        rows.withColumn("top_features", top_entries(F.col("contributions"), 3))
        .orderBy(F.desc("percentile"), F.desc("reconstruction_error"), "stat_id").limit(limit)
    )


def _window(rows: DataFrame, newest: DataFrame | None, window: str, season: str | None, when: str) -> DataFrame:
    if newest is None or window not in ("last_game", "week", "month"):
        return recent(rows, window, season, when)
    back = {"last_game": 0, "week": 7, "month": 30}[window]
    return rows.filter(F.col(when) >= F.date_sub(newest.agg(F.max(when)).scalar(), back))


def game_anomalies(
    outliers: DataFrame, people: DataFrame, newest: DataFrame | None = None, outlier_type: str | None = None,
    limit: int = 50, n_features: int = 3, when: str = "game_date",
) -> DataFrame:
    """Z-score anomalies of the newest day, largest |z| first, with the headline feature."""
    rows = _window(outliers, newest, "last_game", None, when)
    if outlier_type:
        rows = rows.filter(F.col("outlier_type") == outlier_type)
    ranked = F.sort_array(F.transform("outlier_features", lambda f: F.struct(
        (-F.abs(f["z_score"])).alias("rank"), f["feature"].alias("feature"), f["z_score"].alias("z_score"),
        f["val"].alias("val"), f["avg"].alias("avg"), f["sentiment"].alias("sentiment"))))
    return (
        rows.join(people.filter("is_active").select("player_id", "full_name"), "player_id")
        .withColumn("features", F.slice(ranked, 1, n_features))
        .select(
            "stat_id", "player_id", "full_name", when, "outlier_type", F.round("max_z_score", 2).alias("max_z_score"),
            F.col("features")[0]["feature"].alias("primary_feature"), F.col("features")[0]["val"].alias("primary_value"),
            F.col("features")[0]["avg"].alias("primary_average"), "features",
        )
        .orderBy(F.abs("max_z_score").desc(), "stat_id").limit(limit)
    )


def trend_anomalies(
    trends: DataFrame, people: DataFrame, window: str, outlier_type: str | None = None, limit: int = 50, n_features: int = 3
) -> DataFrame:
    """Trend anomalies with a reference day in the last seven, largest |z| first."""
    newest = trends.agg(F.max("reference_date")).scalar()
    rows = trends.filter((F.col("window_type") == window) & (F.col("reference_date") >= F.date_sub(newest, RECENT_DAYS)))
    if outlier_type:
        rows = rows.filter(F.col("outlier_type") == outlier_type)
    top = top_entries(F.col("z_scores"), n_features, by_size=True)
    return (
        rows.join(people.filter("is_active").select("player_id", "full_name"), "player_id")
        .withColumn("features", top)
        .withColumn("__first", F.try_element_at("comparison", F.col("features")[0]["feature"]))
        .select(
            "player_id", "full_name", "window_type", "reference_date", "outlier_type", "max_z_score",
            F.col("features")[0]["feature"].alias("primary_feature"),
            F.col("__first.current_avg").alias("primary_value"), F.col("__first.baseline_avg").alias("primary_average"),
            F.transform("features", lambda e: F.struct(
                e["feature"].alias("feature"), e["value"].alias("z_score"),
                F.try_element_at("comparison", e["feature"])["current_avg"].alias("val"),
                F.try_element_at("comparison", e["feature"])["sentiment"].alias("sentiment"))).alias("features"),
        )
        .orderBy(F.abs("max_z_score").desc(), "player_id").limit(limit)
    )


def _since(lines: DataFrame, window: str, when: str) -> Column | None:
    if window not in ("last_game", "week", "month"):
        return None
    back = {"last_game": 0, "week": 7, "month": 30}[window]
    return F.date_sub(lines.agg(F.max(when)).scalar(), back)


def anomaly_counts(
    lines: DataFrame, league: DataFrame, single: DataFrame, trends: DataFrame, active: DataFrame,
    window: str = "week", season: str | None = None, when: str = "game_date",
) -> DataFrame:
    """One row: lines, league outliers, and explosions and crises of the window, for active players."""
    mine = active.select("player_id").distinct()
    start = _since(lines, window, when)

    def inside(df: DataFrame) -> DataFrame:
        keep = F.col(when) >= start if start is not None else F.col("season") == season
        return df.filter(keep).join(mine, "player_id", "left_semi")

    if window == "last_game" or start is None:
        kinds = inside(single).select("outlier_type")
    else:
        kinds = trends.filter((F.col("window_type") == window) & (F.col("reference_date") >= start)).join(
            mine, "player_id", "left_semi").select("outlier_type")
    parts = [
        inside(lines).select(F.lit("line").alias("kind")),
        inside(league.filter("is_outlier")).select(F.lit("league").alias("kind")),
        kinds.select(F.col("outlier_type").alias("kind")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(
        F.count_if(F.col("kind") == "line").alias("total_stats"),
        F.count_if(F.col("kind") == "league").alias("league_outliers"),
        F.count_if(F.col("kind").isin("explosion", "crisis")).alias("player_outliers"),
        F.count_if(F.col("kind") == "explosion").alias("explosions"),
        F.count_if(F.col("kind") == "crisis").alias("crises"),
    )


# ---- streak dashboard -----------------------------------------------------------------------


def is_relevant(record: Column) -> Column:
    """Shooting streaks from 3 rows, others from max(2, 5 percent of the record)."""
    general = F.greatest(F.lit(2.0), F.coalesce(record, F.lit(2)).cast("double") * 0.05)
    return F.when(F.col("streak_type").isin(SHOOTING_TYPES), F.col("length") >= 3).otherwise(F.col("length") >= general)


def with_records(streaks: DataFrame, records: DataFrame) -> DataFrame:
    limits = records.select("streak_type", "competition_type", F.col("length").alias("record_length"), F.col("player_id").alias("holder_id"))
    return streaks.join(F.broadcast(limits), ["streak_type", "competition_type"], "left")


def active_streaks(badged: DataFrame, records: DataFrame, active: DataFrame, competition: str = "regular", streak_type: str | None = None) -> DataFrame:
    """Relevant open streaks of active players with progress towards the record."""
    rows = badged.filter(F.col("is_active") & (F.col("competition_type") == competition))
    if streak_type:
        rows = rows.filter(F.col("streak_type") == streak_type)
    rows = rows.join(active.select("player_id").distinct(), "player_id", "left_semi")
    record = F.coalesce("record_length", F.lit(2).cast("bigint"))
    return (
        with_records(rows, records).filter(is_relevant(F.col("record_length")))
        .withColumns({
            "record_length": record, "progress": progress_percent(F.col("length"), record),
            "is_historical": (F.col("length") >= record) | F.col("is_historical"),
        })
    )


def broken_streaks(badged: DataFrame, records: DataFrame, newest: Column, competition: str = "regular", streak_type: str | None = None) -> DataFrame:
    """Relevant streaks that ended in the last seven days before ``newest``."""
    rows = badged.filter(
        ~F.col("is_active") & (F.col("ended_at") >= F.date_sub(newest, RECENT_DAYS)) & (F.col("competition_type") == competition))
    if streak_type:
        rows = rows.filter(F.col("streak_type") == streak_type)
    return with_records(rows, records).filter(is_relevant(F.col("record_length")))


def streak_page(active_part: DataFrame, broken_part: DataFrame, number: int, size: int) -> DataFrame:
    """One page over open streaks (longest first) followed by broken ones (latest, then longest first)."""
    columns = ["player_id", "streak_type", "competition_type", "length", "started_at", "ended_at", "is_historical"]
    first = active_part.select(*columns, F.lit(0).alias("part"), F.lit(None).cast("date").alias("__ended"))
    second = broken_part.select(*columns, F.lit(1).alias("part"), F.col("ended_at").alias("__ended"))
    order = ["part", F.desc("__ended"), F.desc("length"), "player_id", "streak_type", "started_at"]
    return first.unionByName(second).orderBy(*order).offset((number - 1) * size).limit(size).drop("__ended")


def streak_totals(active_part: DataFrame, broken_part: DataFrame, size: int) -> DataFrame:
    """Counts of the dashboard: open, broken, historic, and number of pages."""
    both = active_part.select(F.lit(0).alias("part"), "is_historical").unionByName(
        broken_part.select(F.lit(1).alias("part"), "is_historical"))
    return both.agg(
        F.count_if(F.col("part") == 0).alias("total_active"), F.count_if(F.col("part") == 1).alias("total_broken"),
        F.count_if((F.col("part") == 0) & F.col("is_historical")).alias("total_historical"),
        F.ceil(F.count(F.lit(1)) / size).alias("total_pages"),
    )


def open_streaks(badged: DataFrame, player_id: int | None = None) -> DataFrame:
    rows = badged.filter("is_active")
    rows = rows if player_id is None else rows.filter(F.col("player_id") == player_id)
    return rows.orderBy(F.desc("length"), "player_id", "streak_type", "competition_type")


def longest_streaks(badged: DataFrame, streak_type: str | None = None, limit: int = 20) -> DataFrame:
    rows = badged.filter(F.col("streak_type") == streak_type) if streak_type else badged
    return rows.orderBy(F.desc("length"), "started_at", "player_id", "streak_type", "competition_type").limit(limit)


def display_day(day: Column, pattern: str = "dd/MM/yyyy") -> Column:
    return F.date_format(day, pattern)


# ---- combined run ---------------------------------------------------------------------------


def run_detectors(spark, detectors: dict[str, Callable[[], DataFrame]], skip: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run detectors one after the other and write their results to the shared folder.

    A failing detector is reported and does not stop the others. Returns the
    results by name, and a summary with one row per detector and a total.
    """
    results, notes = {}, []
    for name, build in detectors.items():
        if name in skip:
            notes.append((name, None, "skipped"))
            continue
        path = shared_dir(spark, f"detector-{name}")
        try:
            build().write.parquet(path)
            results[name] = spark.read.parquet(path)
            notes.append((name, results[name].count(), "ok"))
        except Exception as error:  # a broken detector must not hide the others' results
            notes.append((name, None, f"failed: {type(error).__name__}"))
    notes.append(("total", sum(n or 0 for _, n, _ in notes), f"run on {date.today().isoformat()}"))
    return results, spark.createDataFrame(notes, "detector string, rows bigint, status string")
