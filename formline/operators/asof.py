"""As-of join: for each row the last row of another table at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators.running import Running, running


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: dict[str, str], tie: str | None = None, strict: bool = False,
    whole: bool = False,
) -> DataFrame:
    """``left`` with columns of the last row of ``right`` of the same group at or before ``left_on`` (before it, if ``strict``).

    ``values`` gives the new columns by name: new name -> column of ``right``. Of several rows at one time that with the largest ``tie``
    counts, then the largest values. Rows without a match, with a null time or a null group keep nulls.

    Both sides are put together and the last row so far is a running maximum over blocks of time, so a group of any size is
    spread over its blocks, and no row of ``left`` meets more than one row of ``right``. ``whole`` leaves groups uncut, see :func:`running`:
    sides that are dealt out alike by some of ``by`` are put together where they are.
    """
    by = list(by)
    order = F.struct(F.col(right_on).alias("at"), F.col(tie if tie else right_on).alias("tie"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values.values())])
    there = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__at"), F.lit(1 if strict else 0).alias("__side"), order.alias("__last"))
    here = left.withColumns({"__at": F.col(left_on), "__side": F.lit(0 if strict else 1)})
    known = here if whole else here.filter(F.col(left_on).isNotNull())
    found = running(known.unionByName(there, allowMissingColumns=True), by, ["__at", "__side"], {"__found": Running(F.col("__last"), "max")}, whole=whole)
    matched = F.lit(True)
    for c in by:
        matched &= F.col(c).isNotNull()
    out = found.filter(F.col("__side") == (0 if strict else 1)).select(
        *left.columns, *[F.when(matched, F.col("__found")[f"v{i}"]).alias(name) for i, name in enumerate(values)])
    return out if whole else out.unionByName(left.filter(F.col(left_on).isNull()), allowMissingColumns=True)
