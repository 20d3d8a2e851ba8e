"""Reconstruction-error scores: standardise, fit a weighted linear reconstruction, rank the errors.

The reconstruction is a weighted principal-component projection. Spark aggregates
the 14 x 14 second-moment matrix in one pass, the driver decomposes that matrix,
and scoring is a batched matrix product in the tasks. Only the matrix and the scaler (a few hundred
numbers, whatever the data size) ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.seasons import season_year
from formline.operators.ranks import up_to_position, values_at
from formline.operators.running import Running, running
from formline.session import write_and_reload

# Scored features, least play time, share of the oldest rows used for fitting,
# decay per season, percentile that marks an outlier.
MODEL_FEATURES = [
    "pts", "ast", "reb", "stl", "blk", "tov", "pf", "fg_pct", "fg3_pct", "ft_pct", "fga", "fta", "fg3a", "min",
]
MIN_SECONDS = 5 * 60
TRAIN_SHARE = 0.8
DECAY = 0.1
OUTLIER_PERCENTILE = 99.0


def feature_rows(lines: DataFrame, first_season: str | None = None, last_season: str | None = None) -> DataFrame:
    """Lines with at least five minutes and their 14 features as doubles, missing as 0; ``min`` in minutes."""
    rows = lines.filter(F.col("min_seconds") >= MIN_SECONDS)
    if first_season:
        rows = rows.filter(F.col("season") >= first_season)
    if last_season:
        rows = rows.filter(F.col("season") <= last_season)
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MODEL_FEATURES if c != "min"}
    return rows.withColumns(values | {"min": F.col("min_seconds").cast("double") / 60.0})


@dataclass(frozen=True)
class Scaler:
    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @staticmethod
    def fit(rows: DataFrame, features: Sequence[str] = tuple(MODEL_FEATURES)) -> Scaler:
        """Mean and population deviation per feature; a constant feature keeps its scale."""
        stats = scaler_table(rows, features).first()
        if stats[f"mean_{features[0]}"] is None:
            raise ValueError("no rows to fit")
        return Scaler(tuple(features), tuple(stats[f"mean_{f}"] for f in features), tuple(stats[f"std_{f}"] for f in features))

    def scaled(self, feature: str) -> Column:
        i = self.features.index(feature)
        return (F.col(feature) - F.lit(self.means[i])) / F.lit(self.deviations[i])

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: self.scaled(f) for f in self.features})

    def inverse(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            f: F.col(f) * F.lit(s) + F.lit(m) for f, m, s in zip(self.features, self.means, self.deviations)})


def scaler_table(rows: DataFrame, features: Sequence[str] = tuple(MODEL_FEATURES)) -> DataFrame:
    """One row with ``mean_<f>`` and ``std_<f>`` (population, 1 where it is 0)."""
    aggs = []
    for f in features:
        std = F.stddev_pop(f)
        aggs += [F.avg(f).alias(f"mean_{f}"), F.when(std == 0, 1.0).otherwise(std).alias(f"std_{f}")]
    return rows.agg(*aggs)


def season_weights(rows: DataFrame, decay: float = DECAY, reference: str | None = None, season: str = "season") -> DataFrame:
    """Add ``weight`` = exp(-decay * seasons back), scaled so that the weights sum to the row count."""
    year = season_year(F.col(season))
    newest = F.lit(int(reference[:4])) if reference else rows.agg(F.max(year)).scalar()
    raw = F.exp(F.lit(-decay) * (newest - year))
    weighted = rows.withColumn("weight", raw)
    scale = weighted.agg((F.count(F.lit(1)) / F.sum("weight")).alias("s")).scalar()
    return weighted.withColumn("weight", F.col("weight") * scale)


def temporal_split(rows: DataFrame, when: str = "game_date", tie: str = "game_id", share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``is_train``: true for the oldest ``share`` of the rows by (day, id).

    The key at the cut is found first (``ranks``); marking the rows then moves none of them. Rows with equal keys go together.
    """
    return rows.withColumn("is_train", up_to_position(rows, when, tie, share))


def second_moments(rows: DataFrame, scaler: Scaler, weight: str | None = None, by: str | None = None) -> dict[object, np.ndarray]:
    """Weighted mean of z z' over all rows, per value of the flag ``by``.

    Each task reduces its rows to one 14 x 14 matrix per flag value, Spark adds
    the cells up, and the sums come to the driver.
    """
    names = list(scaler.features)
    n = len(names)
    means, scale = np.array(scaler.means), np.array(scaler.deviations)

    def partial(batches):
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby("k"):
                z = (part[names].to_numpy(dtype=float) - means) / scale
                w = part["w"].to_numpy(dtype=float)
                cells = np.append((z * w[:, None]).T @ z, w.sum())
                sums[key] = sums.get(key, 0.0) + cells
        for key, cells in sums.items():
            yield pd.DataFrame({"k": bool(key), "cell": np.arange(n * n + 1), "value": cells})

    inputs = rows.select(
        (F.col(by) if by else F.lit(True)).alias("k"), (F.col(weight) if weight else F.lit(1.0)).alias("w"), *names)
    summed = inputs.mapInPandas(partial, "k boolean, cell int, value double").groupBy("k", "cell").agg(F.sum("value").alias("value"))
    out: dict[object, np.ndarray] = {}
    for k, cell, v in summed.collect():
        out.setdefault(k, np.zeros(n * n + 1))[cell] = v
    return {k: cells[:-1].reshape(n, n) / cells[-1] for k, cells in out.items()}


@dataclass(frozen=True)
class Reconstruction:
    """Fitted model: scaler and projection (14 x 14), number of components, version label."""

    scaler: Scaler
    projection: tuple[tuple[float, ...], ...]
    components: int
    validation_loss: float
    version: str = "v1"

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``error`` (mean squared residual) and ``contributions`` (share per feature, 0 without error).

        A dense matrix product per row is the one step that a batched NumPy call
        does several times faster than generated code, so it is an Arrow function.
        Errors are rounded to 12 digits: equal rows then have equal errors in any batch.
        """
        names = list(self.scaler.features)
        means, scale = np.array(self.scaler.means), np.array(self.scaler.deviations)
        rest = np.eye(len(names)) - np.array(self.projection)

        @F.pandas_udf("error double, shares array<double>")
        def residual_shares(batch: pd.DataFrame) -> pd.DataFrame:
            squares = (((batch.to_numpy(dtype=float) - means) / scale) @ rest.T) ** 2
            total = squares.sum(axis=1)
            safe = np.where(total > 0, total, 1.0)[:, None]
            return pd.DataFrame({"error": np.round(total / len(names), 12), "shares": list(squares / safe)})

        labels = F.array(*[F.lit(n) for n in names])
        scored = rows.withColumn("__s", residual_shares(F.struct(*names)))
        return scored.withColumns({
            "error": F.col("__s.error"), "contributions": F.map_from_arrays(labels, F.col("__s.shares")),
        }).drop("__s")


def fit_reconstruction(
    rows: DataFrame,
    train: str | None = None,
    sizes: Sequence[int] = (2, 4, 6, 8, 10),
    weight: str | None = None,
    features: Sequence[str] = tuple(MODEL_FEATURES),
) -> Reconstruction:
    """Fit on the rows flagged by ``train`` and keep the number of components with the least loss on the others.

    The loss of every candidate follows from the moments of the held-out rows,
    so the data is read twice (scale, moments) however many sizes are tried.
    Without a flag all rows are used for both. Weights apply to fitting only.
    """
    fitted = rows.filter(F.col(train)) if train else rows
    scaler = Scaler.fit(fitted, features)
    effective = F.lit(1.0) if weight is None else F.col(weight) if train is None else F.when(F.col(train), F.col(weight)).otherwise(1.0)
    matrices = second_moments(rows.withColumn("__w", effective), scaler, "__w", train)
    if True not in matrices:
        raise ValueError("no rows to fit")
    check = matrices.get(False, matrices[True])
    _, vectors = np.linalg.eigh(matrices[True])
    best = None
    for k in sizes:
        kept = vectors[:, -k:]
        projection = kept @ kept.T
        rest = np.eye(len(features)) - projection
        loss = float(np.trace(rest @ check @ rest.T) / len(features))
        if best is None or loss < best[0] - 1e-12:
            best = (loss, k, projection)
    loss, k, projection = best
    return Reconstruction(scaler, tuple(tuple(float(x) for x in r) for r in projection), k, loss)


# ---- ranks of errors ------------------------------------------------------------------------


def error_percentiles(train: DataFrame, scored: DataFrame, column: str = "error") -> DataFrame:
    """Add ``percentile``: 100 times the share of training rows with a strictly smaller error, exactly."""
    marks = scored.select(column).distinct().withColumn("n", F.lit(0).cast("bigint"))
    values = train.groupBy(column).agg(F.count(F.lit(1)).alias("n")).unionByName(marks)
    values = values.groupBy(column).agg(F.sum("n").alias("n"))
    counted = running(values, [], [column], {"__below": Running(F.col("n"))}, inclusive=False)
    total = train.agg(F.count(F.lit(1)).alias("t")).scalar()
    ranks = counted.select(column, F.coalesce("__below", F.lit(0).cast("bigint")).alias("__below"))
    share = F.coalesce(F.try_divide(F.col("__below").cast("double"), total.cast("double")), F.lit(0.0))
    return scored.join(ranks, column).withColumn("percentile", share * 100.0).drop("__below")


def quantile(rows: DataFrame, share: float, column: str = "error") -> DataFrame:
    """One row: the value at ``share`` of the sorted rows, interpolated linearly, exact at any size; nulls take no part."""
    at = {}

    def ends(total: int) -> list[int]:
        at["position"] = share * (total - 1)
        return [math.floor(at["position"]), math.ceil(at["position"])]

    (a, b), _ = values_at(rows.withColumn(column, F.col(column).cast("double")), column, ends)
    value = None if a is None else a + (b - a) * (at["position"] - math.floor(at["position"]))
    return rows.sparkSession.range(1).select(F.lit(value).cast("double").alias("value"))


def league_outliers(
    lines: DataFrame,
    active: DataFrame,
    train_lines: DataFrame | None = None,
    sizes: Sequence[int] = (2, 4, 6, 8, 10),
    threshold: float = OUTLIER_PERCENTILE,
    when: str = "game_date",
    tie: str = "game_id",
    row_id: str = "id",
) -> DataFrame:
    """Score the lines of active players against a model fitted on the history.

    All scored rows are returned; ``is_outlier`` marks percentiles at or above the threshold.
    """
    keep = [row_id, "player_id", "season", when, tie]
    history = feature_rows(train_lines if train_lines is not None else lines)
    split = temporal_split(season_weights(history), when, tie)
    # Fitting, scoring and ranking read these rows several times: write them once.
    split = write_and_reload(split.select(*dict.fromkeys(keep), *MODEL_FEATURES, "weight", "is_train"), "features")
    model = fit_reconstruction(split, "is_train", sizes, "weight")
    errors = write_and_reload(model.score(split).drop(*MODEL_FEATURES), "errors")
    train = errors.filter("is_train").select("error")
    mine = errors if train_lines is None else model.score(feature_rows(lines))
    scored = mine.join(active.select("player_id").distinct(), "player_id", "left_semi")
    ranked = error_percentiles(train, scored)
    return ranked.select(
        F.col(row_id).alias("stat_id"), "player_id", "season", when, F.col("error").alias("reconstruction_error"),
        "percentile", "contributions", (F.col("percentile") >= threshold).alias("is_outlier"),
        F.lit(model.version).alias("model_version"),
    )


def score_increment(
    lines: DataFrame, active: DataFrame, model: Reconstruction, train_errors: DataFrame, threshold: float = OUTLIER_PERCENTILE, outliers_only: bool = True,
    when: str = "game_date", row_id: str = "id",
) -> DataFrame:
    """Score new lines of active players with a stored model, against the stored training errors (a column ``error``).

    Nothing is fitted. Only outliers are returned unless ``outliers_only`` is false.
    """
    scored = model.score(feature_rows(lines)).join(active.select("player_id").distinct(), "player_id", "left_semi")
    ranked = error_percentiles(train_errors.select("error"), scored)
    found = ranked.select(
        F.col(row_id).alias("stat_id"), "player_id", "season", when, F.col("error").alias("reconstruction_error"),
        "percentile", "contributions", (F.col("percentile") >= threshold).alias("is_outlier"), F.lit(model.version).alias("model_version"),
    )
    return found.filter("is_outlier") if outliers_only else found
