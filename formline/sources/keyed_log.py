"""A keyed table kept as runs: an update writes its own rows, and only a slot with many runs is ever rewritten.

Rows live below ``slot=S/run=R``. The slot is a number made from the row (a week, a range of ids, a hash), so that a reader who
knows the slots of what it wants lists and reads those folders alone. Of each key the rows of the newest run count. Writing a
run again replaces it, so a repeated micro-batch counts once.

Runs written by number N are folders 2N; a slot's merged runs up to K are the folder 2K + 1. A reader takes the newest merged
folder and the runs after it. A merged folder appears by one rename, and the runs in it stay until the next merge, so readers and
a repeated last batch find what they need at any time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A slot of more than FAN runs is merged when all but the largest hold a quarter of its bytes, one of more than MOST in any case.
FAN, MOST = 8, 64


class KeyedLog:
    """``slot``: a whole number for each row, from its key alone. ``many``: a key has several rows, those of one run together.

    ``once``: the writer puts a key into a run only once, so rows of a run need not be compared with each other.

    In a log of several rows a key, a row of which only the key is set says that the run has no row for it: it takes the earlier
    rows away and is not returned itself (``payload`` names a column that is set in all other rows).
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: Sequence[str], slot: Column, many: bool = False, payload: str | None = None, once: bool = False):
        self.spark, self.path, self.key, self.slot, self.many, self.payload, self.once = spark, path, list(key), slot, many, payload, once
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.columns = self.schema.fieldNames()
        self.read_folders: list[str] = []  # what reads have asked for, for monitoring

    def _folders(self, below: str) -> dict[int, tuple[str, int]]:
        """Numbered folders directly below a folder: number -> (path, bytes of the files in it)."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(below)
        files = root.getFileSystem(conf)
        out = {}
        for status in files.listStatus(root) if files.exists(root) else []:
            name, _, number = status.getPath().getName().partition("=")
            if name in ("slot", "run"):
                size = sum(s.getLen() for s in files.listStatus(status.getPath())) if name == "run" else 0
                out[int(number)] = (status.getPath().toString(), size)
        return out

    def delete(self, paths: Iterable[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def slots(self) -> list[int]:
        return sorted(self._folders(self.path))

    def _live(self, slot: int, before: int | None) -> dict[int, tuple[str, int]]:
        runs = {r: x for r, x in self._folders(f"{self.path}/slot={slot}").items() if before is None or r < 2 * before}
        base = max((r for r in runs if r % 2), default=None)
        return runs if base is None else {r: x for r, x in runs.items() if r >= base and (r == base or r % 2 == 0)}

    def write(self, df: DataFrame, number: int, slots: Iterable[int] | None = None) -> None:
        """Add the rows as run ``number``; numbers rise. ``slots``, if known, are those of the rows: only they are looked at."""
        self._put(df.select(*self.columns), 2 * number)
        self._merge(self.slots() if slots is None else sorted(set(slots)), number)

    def _put(self, df: DataFrame, run: int) -> None:
        placed = df.withColumns({"slot": self.slot.cast("bigint"), "run": F.lit(run).cast("bigint")})
        # Few files of even size: Spark splits a large slot and joins small ones.
        placed.hint("rebalance", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "run").parquet(self.path)

    def _merge(self, slots: list[int], number: int) -> None:
        full, old = [], []
        for slot in slots:
            live = self._live(slot, number)
            if len(live) <= FAN:
                continue
            sizes = [x[1] for x in live.values()]
            if len(live) > MOST or 4 * (sum(sizes) - max(sizes)) >= sum(sizes):
                full.append(slot)
                old += [x[0] for r, x in self._folders(f"{self.path}/slot={slot}").items() if r < min(live)]
        if full:
            self._put(self.read(full, number), 2 * number - 1)
            self.delete(old)

    def read(self, slots: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The table as it stands, or stood before run ``before``; of ``slots`` alone if given. Other slots are not even listed."""
        wanted = None if slots is None else set(slots)
        if wanted is None or len(wanted) > MOST:
            wanted = [s for s in self.slots() if wanted is None or s in wanted]
        live = [sorted(self._live(s, before).items()) for s in sorted(wanted)]
        folders = [x[0] for runs in live for _, x in runs]
        self.read_folders += folders
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows(folders)
        if not (self.many or self.once):
            rest = [c for c in self.columns if c not in self.key]
            return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "run").alias("r")).select(*[c if c in self.key else f"r.{c}" for c in self.columns])
        # A row can only be out of date by a later run of its slot, and later runs hold few rows of the slot.
        later = [x[0] for runs in live for _, x in runs[1:]]
        if later:
            newest = self._rows(later).groupBy(*[F.col(c).alias(f"__{c}") for c in self.key]).agg(F.max("run").alias("__run"))
            same = F.lit(True)
            for c in self.key:
                same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
            rows = rows.join(newest, same, "left").filter("__run is null or run = __run")
        now = rows.select(*self.columns)
        return now if self.payload is None else now.filter(F.col(self.payload).isNotNull())

    def stored(self) -> DataFrame:
        """Every row of the runs that count, out of date or not: enough to know how large the table is."""
        folders = [x[0] for s in self.slots() for x in self._live(s, None).values()]
        return self._rows(folders) if folders else self.spark.createDataFrame([], self.schema)

    def _rows(self, folders: list[str]) -> DataFrame:
        wide = T.StructType([*self.schema.fields, T.StructField("slot", T.LongType()), T.StructField("run", T.LongType())])
        return self.spark.read.schema(wide).option("basePath", self.path).parquet(*folders)


def hash_slot(*key: str, slots: int = 16) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots))


def id_slot(schema: T.StructType, name: str) -> Column:
    """Ranges of 65,536 for whole numbers, which are mostly given in the order of time; 16 hash slots for other ids."""
    if isinstance(schema[name].dataType, T.IntegralType):
        return F.coalesce(F.shiftright(F.col(name).cast("bigint"), 16), F.lit(-1).cast("bigint"))
    return hash_slot(name)
