from __future__ import annotations

import random

import pyarrow.parquet as pq
from conftest import rows
from pyspark.sql import functions as F

from formline.sources import keyed_log
from formline.sources.keyed_log import KeyedLog, hash_slot


def frame(spark, items):
    return spark.createDataFrame(items, "k bigint, v string")


def test_newest_run_of_a_key_counts(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "a"), "k bigint, v string", ["k"], hash_slot("k", slots=3))
    assert rows(log.read()) == [] and log.slots() == []
    log.write(frame(spark, [(1, "a"), (2, "b"), (None, "n")]), 0)
    log.write(frame(spark, [(2, "c"), (3, None)]), 1)
    log.write(frame(spark, [(2, "d"), (3, None)]), 1)    # written again: replaces the run
    assert rows(log.read()) == [(None, "n"), (1, "a"), (2, "d"), (3, None)]
    assert rows(log.read(before=1)) == [(None, "n"), (1, "a"), (2, "b")]


def test_rows_of_a_key_stay_together_and_can_be_taken_away(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "a"), "k bigint, v string", ["k"], F.col("k"), many=True, payload="v")
    log.write(frame(spark, [(1, "a"), (1, "b"), (2, "c")]), 0)
    log.write(frame(spark, [(1, "d"), (2, None)]), 1)
    assert rows(log.read()) == [(1, "d")]


def test_merging_keeps_the_table_and_repeated_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_log, "FAN", 3)
    rnd, log, truth, runs = random.Random(1), KeyedLog(spark, str(tmp_path / "a"), "k bigint, v string", ["k"], F.col("k") % 2), {}, 0
    for number in range(14):
        part = {rnd.randrange(8): f"{number}-{i}" for i in range(3)}
        log.write(frame(spark, list(part.items())), number)
        log.write(frame(spark, list(part.items())), number)
        truth |= part
        runs = max(runs, max(len(log._live(s, None)) for s in log.slots()))
        assert rows(log.read()) == sorted(truth.items())
    assert runs <= 6 and any(r % 2 for s in log.slots() for r in log._folders(f"{log.path}/slot={s}"))


def test_small_update_writes_few_rows(spark, tmp_path):
    """Over many updates of 0.1 % of the keys, what is written is below 5 % of the table each."""
    n, log = 20_000, KeyedLog(spark, str(tmp_path / "a"), "k bigint, v string", ["k"], hash_slot("k", slots=4))
    log.write(spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 256)).alias("v")), 0)
    for number in range(1, 12):
        log.write(spark.range(n // 1000).select((F.col("id") * 1000 + number).alias("k"), F.lit(f"y{number}").alias("v")), number)
    written = sum(pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "a").rglob("*.parquet") if "run=0/" not in str(f))
    assert written < 11 * 0.05 * n
    assert log.read().filter("v like 'y%'").count() == 11 * n // 1000 and log.read().count() == n
