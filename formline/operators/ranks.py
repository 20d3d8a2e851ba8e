"""The value at a position of the sorted rows: a sketch says where to look, a second pass counts there exactly.

Sorting all rows to read one of them moves all of them. Here the first pass keeps a sketch of bounded size, which gives
two values that enclose the position with some margin; the second pass counts the rows below the two and sorts only what
lies between them. A sketch may be wrong, a count is not: a position outside the counted range widens the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators.running import Running, running
from formline.session import write_and_reload

SKETCH_SIZE = 2048  # about 50 KB a task; ranks within 0.2 % nearly always
MARGIN = 0.005  # share of the rows looked at on either side


def _as_number(rows: DataFrame, column: str) -> Column | None:
    """The column as a double that never falls while the column rises, or None for types without one."""
    kind, c = rows.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.NumericType)):
        return c.cast("double")
    return None


def _counted(rows: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """(value, n) of the values from ``low`` to ``high``; what lies below is one row without a value."""
    number = _as_number(rows, column)
    inside = F.lit(True) if low is None else number >= low
    reach = rows if high is None else rows.filter(number <= high)
    return reach.groupBy(F.when(inside, F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def values_at(rows: DataFrame, column: str, positions, margin: float = MARGIN) -> tuple[list, list[int]]:
    """The values at ``positions`` (from 0) of the rows sorted by ``column``, and how many rows are smaller than each.

    ``positions`` is a list, or a function of the number of rows that gives one; positions outside give None. Nulls take no
    part. Doubles sort as Spark sorts them, NaN last. Two passes read the column; further ones only if the sketch was off.
    """
    rows = rows.select(column).filter(F.col(column).isNotNull())
    number, total = _as_number(rows, column), None
    if number is None:  # no sketch for this type: all distinct values are counted
        total = rows.count()
    else:
        finite = F.when(~F.isnan(number), number)
        total, sketch = rows.agg(F.count(F.lit(1)), F.kll_sketch_agg_double(finite, SKETCH_SIZE)).first()
    wanted = [int(p) for p in (positions(total) if callable(positions) else positions)]
    known = [p for p in wanted if 0 <= p < total]
    if not known:
        return [None] * len(wanted), [0] * len(wanted)
    if number is not None:
        bound = rows.sparkSession.range(1).select(F.lit(sketch).alias("s"))
        has = bound.select(F.kll_sketch_get_n_double("s")).first()[0]
    while True:
        low = high = None
        if number is not None and has:
            first, last = min(known) / total - margin, (max(known) + 1) / total + margin
            low, high = bound.select(
                F.kll_sketch_get_quantile_double("s", F.lit(max(first, 0.0))) if first > 0 else F.lit(None),
                F.kll_sketch_get_quantile_double("s", F.lit(min(last, 1.0))) if last < 1 else F.lit(None),
            ).first()
        counted = write_and_reload(_counted(rows, column, low, high), "bracket")
        below, inside = counted.agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)),
        ).first()
        if below <= min(known) and max(known) < below + inside:
            break
        margin = margin * 8  # at 1 and above the range is the whole column
    ranked = running(counted.filter("value is not null"), [], ["value"], {"smaller": Running(F.col("n"))}, inclusive=False)
    place = F.coalesce("smaller", F.lit(0)) + F.lit(below)
    hits = ranked.withColumn("smaller", place).filter(" or ".join(
        f"({p} >= smaller and {p} < smaller + n)" for p in sorted(set(known)))).collect()  # a row for each position at most
    answer = {p: next((h["value"], h["smaller"]) for h in hits if h["smaller"] <= p < h["smaller"] + h["n"]) for p in known}
    return [answer[p][0] if p in answer else None for p in wanted], [answer[p][1] if p in answer else 0 for p in wanted]


def up_to_position(rows: DataFrame, when: str, tie: str, share: float) -> Column:
    """A condition that holds for the oldest ``share`` of the rows by (``when``, ``tie``).

    It compares with one key, so that using it moves no row. Rows with equal keys go together. Rows without a time, and in
    the time of the cut without an id, are not chosen.
    """
    cut = int(rows.count() * share)
    (day,), (before,) = values_at(rows, when, [cut - 1])
    if day is None:  # nothing is to be chosen, or everything that has a time
        return F.col(when).isNotNull() if cut else F.lit(False)
    same = F.col(when) == F.lit(day)
    (last,), _ = values_at(rows.filter(same), tie, [cut - before - 1])
    tied = F.col(tie).isNotNull() if last is None else F.col(tie) <= F.lit(last)
    return F.coalesce((F.col(when) < F.lit(day)) | (same & tied), F.lit(False))
