"""Weekly and monthly form against the season baseline, at one reference day per entity or at every day."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators.asof import asof_join
from formline.operators.running import ROWS_A_TASK, Running, running
from formline.operators.zscore import (
    DEFAULT_FEATURES,
    MIN_BASELINE_ROWS,
    Z_THRESHOLD,
    Feature,
    Keys,
    baseline_inputs,
    counted,
    deviation_of,
    fixed_point,
    headline,
    map_of,
    mean_of,
    sentiment,
    square,
)


@dataclass(frozen=True)
class TrendWindow:
    """Days (reference - days, reference], and the least number of played rows in them."""

    name: str
    days: int
    min_rows: int


WEEK = TrendWindow("week", 7, 2)
MONTH = TrendWindow("month", 30, 5)


def last_days(lines: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Each entity's last day and the period of that day."""
    latest = F.max(F.struct(F.col(keys.when), F.col(keys.tie), F.col(keys.period)))
    return lines.groupBy(keys.entity).agg(latest.alias("last")).select(
        keys.entity, F.col(f"last.{keys.when}").alias("reference_date"), F.col(f"last.{keys.period}").alias("reference_period"),
    )


def _addends(lines: DataFrame, features: Sequence[Feature], keys: Keys) -> DataFrame:
    """(entity, period, day) with the addends of the sums, row by row.

    The join with the reference day is an inner join on the entity: Spark splits the rows of a huge entity, and the
    aggregation after it combines on the map side.
    """
    inputs = baseline_inputs(features, keys) | {"played": f"if({keys.seconds} > 0, 1L, null)"}
    return lines.select(keys.entity, keys.period, keys.when, *[F.expr(c).alias(name) for name, c in inputs.items()])


def trend_scores(
    lines: DataFrame,
    reference: DataFrame | None = None,
    windows: Sequence[TrendWindow] = (WEEK, MONTH),
    features: Sequence[Feature] = DEFAULT_FEATURES,
    keys: Keys = Keys(),
) -> DataFrame:
    """One row per (entity, window) with ``z_<feature>``, ``cur_<feature>`` and ``base_<feature>``.

    ``reference`` gives (entity, reference_date, reference_period); by default the
    entity's last day. Everything is one conditional aggregation. The baseline is
    the reference period up to and including the window.
    """
    reference = last_days(lines, keys) if reference is None else reference
    rows = _addends(lines, features, keys).join(reference, keys.entity)
    in_base = f"({keys.period} = reference_period and {keys.when} <= reference_date)"
    aggs = [F.expr(f"coalesce(sum(if({in_base}, played, null)), 0L)").alias("base_games")]
    for name in baseline_inputs(features, keys):
        aggs.append(F.expr(f"sum(if({in_base}, {name}, null))").alias(name))
    for w in windows:
        inside = f"({keys.when} > date_sub(reference_date, {w.days}) and {keys.when} <= reference_date)"
        aggs.append(F.expr(f"coalesce(sum(if({inside}, played, null)), 0L)").alias(f"{w.name}_games"))
        for f in features:
            aggs.append(F.expr(f"sum(if({inside}, {f.name}_s, null))").alias(f"{w.name}_{f.name}_s"))
            aggs.append(F.expr(f"coalesce(sum(if({inside}, {f.name}_n, null)), 0L)").alias(f"{w.name}_{f.name}_n"))
    return _scores_of(rows.groupBy(keys.entity, "reference_date").agg(*aggs), windows, features, keys)


def trend_history(
    lines: DataFrame, windows: Sequence[TrendWindow] = (WEEK, MONTH), features: Sequence[Feature] = DEFAULT_FEATURES, keys: Keys = Keys(),
    parts: int | None = None, most: int = ROWS_A_TASK,
) -> DataFrame:
    """:func:`trend_scores` with every day on which an entity has a row as reference day, in one pass.

    A window's sums are the entity's sums up to the day less those up to the day before the window, found by an as-of join;
    the baseline is a running sum of the period. Rows are dealt out by entity with nothing but their values in them
    (:func:`_dealt`), and all sums, joins and scores are made where they arrive. A task thus holds the days of an entity.
    """
    k, counts = keys, _counters(features)
    in_windows = list(dict.fromkeys(["played", *[f"{f.name}_s" for f in features], *counts.values()]))
    names = [*in_windows, *[f"{f.name}_q" for f in features]]
    rows = _dealt(lines, features, k, parts, most)
    one = {f"{f.name}_q": f"coalesce(__sums.{f.name}_q, {square(f, f'{f.name}_s')})" for f in features}
    one |= {c: f"coalesce(__sums.{c}, if({c.removesuffix('_n')}_s is null, 0, 1))" for c in counts.values() if c != "played"}
    by_period = rows.groupBy(k.entity, k.period, k.when).agg(F.max("__tie").alias("__tie"), *[F.expr(f"coalesce(sum({one.get(n, n)}), 0) as {n}") for n in names])
    base = running(by_period, [k.entity, k.period], [k.when], {f"run_{n}": Running(F.col(n)) for n in names}, whole=True)
    # A day belongs to the period of the entity's last row on it.
    last = F.max_by(F.struct(*[F.col(f"run_{n}").alias(n) for n in names]), "__tie").alias("base")
    by_day = base.groupBy(k.entity, k.when).agg(last, *[F.sum(n).alias(n) for n in in_windows])
    upto = running(by_day, [k.entity], [k.when], {f"upto_{n}": Running(F.col(n)) for n in in_windows}, whole=True)
    day, sums = F.col(k.when).alias("reference_date"), F.struct(*[F.col(f"upto_{n}").alias(n) for n in in_windows]).alias("upto")
    right = upto.select(k.entity, F.col(k.when).alias("__day"), sums)
    found = upto.filter(F.col(k.when).isNotNull()).select(k.entity, day, "base", sums)
    days = rows.filter(F.col(k.when).isNotNull()).select(k.entity, day).distinct()
    for w in windows:
        # Only the day goes through the as-of join; the other columns stay where they are.
        edges = days.withColumn("__edge", F.date_sub("reference_date", w.days))
        was = asof_join(edges, right, [k.entity], "__edge", "__day", {f"__{w.name}": "upto"}, None, False, True)
        found = found.unionByName(was.drop("__edge"), allowMissingColumns=True)
    # A join on entity and day would deal all sums out anew, grouping does not.
    found = found.groupBy(k.entity, "reference_date").agg(*[F.first(c, ignorenulls=True).alias(c) for c in found.columns[2:]])
    near = {(w.name, n): f"upto.{n} - coalesce(__{w.name}.{n}, 0)" for w in windows for n in in_windows}
    return _scores_of(
        found.selectExpr(
            k.entity, "reference_date", "base.played as base_games", *[f"base.{f.name}_{x} as {f.name}_{x}" for f in features for x in "sq"],
            *[f"base.{counts[f.name]} as {f.name}_n" for f in features], *[f"{near[w.name, 'played']} as {w.name}_games" for w in windows],
            *[f"{near[w.name, f'{f.name}_s']} as {w.name}_{f.name}_s" for w in windows for f in features],
            *[f"{near[w.name, counts[f.name]]} as {w.name}_{f.name}_n" for w in windows for f in features]),
        windows, features, keys)


def _counters(features: Sequence[Feature]) -> dict[str, str]:
    """The column of each feature's count: without attempts that of the played rows, with the same attempts the same one."""
    first = {f.attempts: f.name for f in reversed(features)}
    return {f.name: f"{first[f.attempts]}_n" if f.attempts else "played" for f in features}


def _dealt(lines: DataFrame, features: Sequence[Feature], keys: Keys, parts: int | None, most: int) -> DataFrame:
    """Rows in ``parts`` tasks by entity: the day, ``__tie``, ``played`` and ``<feature>_s``, from which squares and counts can be made.

    The rows of an entity that has more than ``most`` are first added up by day, on the map side, and bring their squares and
    counts in ``__sums``: no task gets more of such an entity than its days.
    """
    k, counters = keys, [c for c in dict.fromkeys(_counters(features).values()) if c != "played"]
    values = [F.expr(f"if({counted(f, k)}, {fixed_point(f)}, null)").alias(f"{f.name}_s") for f in features]
    rows = lines.filter(F.col(k.entity).isNotNull()).select(
        k.entity, k.period, k.when, F.col(k.tie).alias("__tie"), F.expr(f"if({k.seconds} > 0, 1L, 0L)").alias("played"), *values)
    many = F.broadcast(rows.groupBy(k.entity).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > most).select(k.entity))
    sums = {f"{f.name}_q": f"sum({square(f, f'{f.name}_s')})" for f in features} | {c: f"count({c.removesuffix('_n')}_s)" for c in counters}
    days = rows.join(many, k.entity, "left_semi").groupBy(k.entity, k.period, k.when).agg(
        F.max("__tie").alias("__tie"), *[F.sum(n).alias(n) for n in ["played", *[f"{f.name}_s" for f in features]]], *[F.expr(c).alias(n) for n, c in sums.items()])
    days = days.withColumn("__sums", F.struct(*sums)).drop(*sums)
    together = rows.join(many, k.entity, "left_anti").unionByName(days, allowMissingColumns=True)
    return together.repartition(parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), k.entity)


def _scores_of(grouped: DataFrame, windows: Sequence[TrendWindow], features: Sequence[Feature], keys: Keys) -> DataFrame:
    per_window = []
    for w in windows:
        fields = [f"'window_type', '{w.name}', 'games_in_window', {w.name}_games, 'min_rows', {w.min_rows}"]
        for f in features:
            n = f"{w.name}_{f.name}_n"
            current = f"(cast({w.name}_{f.name}_s as double) / cast({n} * {f.scale} as double))"
            usable = f"{f.name}_n >= {MIN_BASELINE_ROWS} and {n} > 0"
            z = f"({current} - {mean_of(f)}) / ({deviation_of(f)} / sqrt(cast({n} as double)))"
            fields.append(
                f"'z_{f.name}', if({usable}, {z}, null), 'cur_{f.name}', if({n} > 0, {current}, null), "
                f"'base_{f.name}', if({usable}, {mean_of(f)}, null)")
        per_window.append(f"named_struct({', '.join(fields)})")
    return (
        grouped.filter(F.col("base_games") >= MIN_BASELINE_ROWS)
        .select(keys.entity, "reference_date", F.col("base_games").alias("games_in_baseline"),
                F.expr(f"inline(array({', '.join(per_window)}))"))
        .filter("games_in_window >= min_rows")
        .drop("min_rows")
    )


def trend_outliers(
    lines: DataFrame,
    reference: DataFrame | None = None,
    windows: Sequence[TrendWindow] = (WEEK, MONTH),
    features: Sequence[Feature] = DEFAULT_FEATURES,
    keys: Keys = Keys(),
    threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Entities whose recent form deviates, with the comparison of each deviating feature."""
    hits = {f.name: f"(abs(z_{f.name}) > {threshold!r})" for f in features}
    comparison = {
        f.name: f"named_struct('current_avg', round(cur_{f.name}, {3 if f.attempts else 2}), 'baseline_avg', round(base_{f.name}, {3 if f.attempts else 2}), "
                f"'diff_pct', if(base_{f.name} > 0, round((try_divide(cur_{f.name}, base_{f.name}) - 1) * 100, 1), 0D), 'sentiment', {sentiment(f)})"
        for f in features
    }
    scores = trend_scores(lines, reference, windows, features, keys)
    return (
        scores.filter(" or ".join(hits.values()))
        .select(
            keys.entity, "window_type", "reference_date",
            F.expr(map_of(features, hits, {f.name: f"round(z_{f.name}, 2)" for f in features})).alias("z_scores"),
            F.expr(headline(features, hits)).alias("top"),
            F.expr(map_of(features, hits, comparison)).alias("comparison"),
            "games_in_window", "games_in_baseline",
        )
        .select(
            keys.entity, "window_type", "reference_date", "z_scores", F.col("top.z").alias("max_z_score"),
            F.when(F.col("top.sentiment") == "positive", "explosion").otherwise("crisis").alias("outlier_type"),
            "comparison", "games_in_window", "games_in_baseline",
        )
    )
