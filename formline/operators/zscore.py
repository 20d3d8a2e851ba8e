"""Point-in-time Z-scores against the entity's own season so far."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators.running import Running, running


@dataclass(frozen=True)
class Feature:
    """A scored column.

    ``attempts`` names the column that must be positive for the row to enter the
    baseline (shooting percentages). ``minimum`` is the smallest value worth
    reporting, ``inverse`` marks columns where high is bad.
    """

    name: str
    minimum: float
    attempts: str | None = None
    inverse: bool = False

    @property
    def variance_floor(self) -> float:
        return 0.01 if self.attempts else 0.2

    @property
    def scale(self) -> int:
        """Fixed-point factor: sums are kept in integers so that they do not depend on row order."""
        return 1_000_000 if self.attempts else 1


# Scored columns in reporting order with their smallest relevant value.
DEFAULT_FEATURES = [
    Feature("pts", 10), Feature("ast", 4), Feature("reb", 5), Feature("stl", 2), Feature("blk", 2),
    Feature("tov", 4, inverse=True), Feature("fga", 5), Feature("fta", 4), Feature("fg3a", 3),
    Feature("fg_pct", 0.4, attempts="fga"),
    Feature("fg3_pct", 0.3, attempts="fg3a"),
    Feature("ft_pct", 0.5, attempts="fta"),
]

Z_THRESHOLD = 2.0
MIN_BASELINE_ROWS = 5
MIN_SCORED_SECONDS = 15 * 60
GRACE_DAYS = 30
GRACE_ROWS = 20


@dataclass(frozen=True)
class Keys:
    """Column roles of an entity time series. (``when``, ``tie``) must order an entity's rows uniquely."""

    entity: str = "player_id"
    period: str = "season"
    when: str = "game_date"
    tie: str = "game_id"
    row_id: str = "id"
    seconds: str = "min_seconds"


# The formulas below are kept as SQL text: there are dozens of them per query, and
# one parsed expression is far cheaper to build than a tree of Column calls.


def value(feature: Feature) -> str:
    return f"coalesce(cast({feature.name} as double), 0D)"


def counted(feature: Feature, keys: Keys) -> str:
    """Row enters the baseline of the feature."""
    played = f"{keys.seconds} > 0"
    return f"({played} and {feature.attempts} > 0)" if feature.attempts else f"({played})"


def fixed_point(feature: Feature) -> str:
    return f"cast(round({value(feature)} * {feature.scale}) as bigint)"


def square(feature: Feature, x: str | None = None) -> str:
    """Squared fixed-point value, wide enough to be summed over any number of rows; ``x`` names the value where it is a column."""
    x = x or fixed_point(feature)
    return f"{x} * {x}" if feature.scale == 1 else f"cast({x} * {x} as decimal(20, 0))"


def baseline_inputs(features: Sequence[Feature], keys: Keys) -> dict[str, str]:
    """Per-row addends ``<feature>_s``, ``_q`` and ``_n`` of the sums, squares and counts."""
    out: dict[str, str] = {}
    for f in features:
        use = counted(f, keys)
        out[f"{f.name}_s"] = f"if({use}, {fixed_point(f)}, null)"
        out[f"{f.name}_q"] = f"if({use}, {square(f)}, null)"
        out[f"{f.name}_n"] = f"if({use}, 1L, null)"
    return out


def mean_of(feature: Feature) -> str:
    return f"(cast({feature.name}_s as double) / cast({feature.name}_n * {feature.scale} as double))"


def deviation_of(feature: Feature) -> str:
    second = f"cast({feature.name}_q as double) / (cast({feature.name}_n as double) * {float(feature.scale**2)!r}D)"
    return f"sqrt(greatest({feature.variance_floor!r}D, {second} - {mean_of(feature)} * {mean_of(feature)}))"


def season_states(lines: DataFrame, features: Sequence[Feature] = DEFAULT_FEATURES, keys: Keys = Keys()) -> DataFrame:
    """One row per (entity, period): rows played, first and last day, map of sums, squares and counts."""
    played = F.col(keys.seconds) > 0
    inputs = baseline_inputs(features, keys)
    grouped = lines.groupBy(keys.entity, keys.period).agg(
        F.count_if(played).alias("games_played"),
        F.min(F.when(played, F.col(keys.when))).alias("first_game_date"),
        F.max(F.when(played, F.col(keys.when))).alias("last_game_date"),
        *[F.expr(f"sum({c})").alias(name) for name, c in inputs.items()],
    )
    entries = []
    for f in features:
        for suffix, label, scale in (("s", f.name, f.scale), ("q", f"{f.name}_sq", f.scale**2), ("n", f"{f.name}_count", 1)):
            entries += [F.lit(label), F.coalesce(F.col(f"{f.name}_{suffix}").cast("double") / float(scale), F.lit(0.0))]
    return grouped.select(
        keys.entity, keys.period, "games_played", "first_game_date", "last_game_date",
        F.create_map(*entries).alias("accumulated"),
    )


def expanding_state(
    lines: DataFrame, features: Sequence[Feature] = DEFAULT_FEATURES, keys: Keys = Keys(), first: DataFrame | None = None
) -> DataFrame:
    """Every row with the sums of the rows before it in its (entity, period), and the entity's first period.

    ``first`` gives (entity, first_period) where ``lines`` are only some periods. Rows are exchanged once, by (entity, period, week): an entity with a large share of all rows is spread over its weeks.
    """
    played = F.col(keys.seconds) > 0
    if first is None:
        first = lines.groupBy(keys.entity).agg(F.min(keys.period).alias("first_period"))
    seen = lines.join(first, keys.entity, "left")
    aggregates = {
        "games_before": Running(F.when(played, F.lit(1).cast("bigint"))),
        "first_day": Running(F.when(played, F.col(keys.when)), "min"),
    }
    aggregates |= {name: Running(F.expr(c)) for name, c in baseline_inputs(features, keys).items()}
    return running(seen, [keys.entity, keys.period], [keys.when, keys.tie], aggregates, inclusive=False)


def add_scores(
    state: DataFrame, features: Sequence[Feature] = DEFAULT_FEATURES, keys: Keys = Keys()
) -> DataFrame:
    """Add ``scored`` and ``z_<feature>`` to rows that carry the sums of their past."""
    games = F.coalesce(F.col("games_before"), F.lit(0).cast("bigint"))
    grown = (F.datediff(F.col(keys.when), F.col("first_day")) >= GRACE_DAYS) & (games >= GRACE_ROWS)
    known = F.coalesce(F.col("first_period") < F.col(keys.period), F.lit(False))
    scored = (F.col(keys.seconds) >= MIN_SCORED_SECONDS) & (games >= MIN_BASELINE_ROWS) & (grown | known)
    zs = {
        f"z_{f.name}": F.expr(
            f"if(scored and {f.name}_n >= {MIN_BASELINE_ROWS}, ({value(f)} - {mean_of(f)}) / {deviation_of(f)}, null)")
        for f in features
    }
    return state.withColumns({"games_before": games, "scored": F.coalesce(scored, F.lit(False))}).withColumns(zs)


def zscore_rows(lines: DataFrame, features: Sequence[Feature] = DEFAULT_FEATURES, keys: Keys = Keys()) -> DataFrame:
    """Scored rows only, one ``z_<feature>`` column per feature (null without enough baseline)."""
    return add_scores(expanding_state(lines, features, keys), features, keys).filter("scored")


def sentiment(feature: Feature) -> str:
    """High is good, unless the feature is inverse."""
    return f"if(z_{feature.name} {'>' if feature.inverse else '<'} 0, 'negative', 'positive')"


def headline(features: Sequence[Feature], hits: dict[str, str]) -> str:
    """Largest |z| among the features whose condition holds; the first in list order on ties."""
    return "greatest(" + ", ".join(
        f"if({hits[f.name]}, named_struct('size', abs(z_{f.name}), 'place', {-i}, 'z', z_{f.name}, 'sentiment', {sentiment(f)}), null)"
        for i, f in enumerate(features)
    ) + ")"


def map_of(features: Sequence[Feature], conditions: dict[str, str], values: dict[str, str]) -> str:
    """Map from feature name to value, for the features whose condition holds."""
    return "map_from_entries(array_compact(array(" + ", ".join(
        f"if({conditions[f.name]}, struct('{f.name}', {values[f.name]}), null)" for f in features) + ")))"


def outliers_of(
    scored: DataFrame,
    features: Sequence[Feature] = DEFAULT_FEATURES,
    keys: Keys = Keys(),
    threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Rows with at least one relevant extreme feature, with the nested report.

    The headline is the first feature in list order with the largest |z|. A value
    below the feature's minimum is never reported, not even as a bad night.
    """
    hits = {f.name: f"(abs(z_{f.name}) > {threshold!r} and {value(f)} >= {f.minimum})" for f in features}
    known = {f.name: f"z_{f.name} is not null" for f in features}
    reports = ", ".join(
        f"if({hits[f.name]}, named_struct('feature', '{f.name}', 'z_score', round(z_{f.name}, 2), 'sentiment', {sentiment(f)}, "
        f"'val', {f'round({value(f)}, 3)' if f.attempts else f'cast(floor({value(f)}) as double)'}, "
        f"'avg', round({mean_of(f)}, {3 if f.attempts else 2})), null)"
        for f in features
    )
    return (
        scored.filter(" or ".join(hits.values()))
        .select(
            F.col(keys.row_id).alias("stat_id"), keys.entity, keys.period, keys.when, keys.tie,
            F.expr(map_of(features, known, {f.name: f"round(z_{f.name}, 2)" for f in features})).alias("z_scores"),
            F.expr(headline(features, hits)).alias("top"),
            F.expr(f"array_compact(array({reports}))").alias("outlier_features"),
            F.col("games_before").alias("games_in_sample"),
        )
        .select(
            "stat_id", keys.entity, keys.period, keys.when, keys.tie, "z_scores", F.col("top.z").alias("headline_z"),
            F.round("top.z", 2).alias("max_z_score"),
            F.when(F.col("top.sentiment") == "positive", "explosion").otherwise("crisis").alias("outlier_type"),
            "outlier_features", "games_in_sample",
        )
    )


def zscore_outliers(
    lines: DataFrame,
    features: Sequence[Feature] = DEFAULT_FEATURES,
    keys: Keys = Keys(),
    threshold: float = Z_THRESHOLD,
) -> DataFrame:
    return outliers_of(zscore_rows(lines, features, keys), features, keys, threshold)


def zscore_backfill(
    lines: DataFrame,
    active: DataFrame,
    period: str | None = None,
    features: Sequence[Feature] = DEFAULT_FEATURES,
    keys: Keys = Keys(),
    threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Outliers of one period (default: the latest) for entities listed in ``active``.

    The grace rule looks at earlier periods, so scoring runs before the period filter.
    """
    mine = lines.join(active.select(keys.entity).distinct(), keys.entity, "left_semi")
    found = zscore_outliers(mine, features, keys, threshold)
    chosen = F.lit(period) if period else lines.agg(F.max(keys.period)).scalar()
    return found.filter(F.col(keys.period) == chosen)
