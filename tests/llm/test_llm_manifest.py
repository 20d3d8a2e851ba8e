import brute
from pyspark.sql import functions as F

from formline.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, `group` string, total string, `at` string, steps string, root string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def proofs(spark, rows):
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA).repartition(6)
    found = manifest.verified_manifest(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_hot_source_of_three_tiers_and_lone_leaves(spark):
    """Group sizes around every border of a run and a block; one source holds most rows."""
    sizes = {"hot": 4200, "a": 1, "b": 2, "c": 15, "d": 16, "e": 17, "f": 255, "g": 256, "h": 257, "Ünï": 33, None: 18, "": 5}
    rows = [(k * 7 + 3, s, "en" if k % 2 else None, k, f"Text {k} OF {s}") for s, n in sizes.items() for k in range(n)]
    assert proofs(spark, rows) == brute.manifest(rows)


def test_many_sources(spark):
    rows = [(k, f"s{k % 700}", "de", None, "Abc" if k % 3 else None) for k in range(1000)]
    assert proofs(spark, rows) == brute.manifest(rows)


def test_edge_rows(spark):
    """Null ids and texts, repeated rows, equal ids with different texts, very long texts."""
    rows = [(i, "s" if (i or 0) % 2 else None, None, len(t or ""), t) for i, t in brute.EDGE]
    assert proofs(spark, rows) == brute.manifest(rows)


def test_one_row_and_none(spark):
    assert proofs(spark, []) == []
    one = proofs(spark, [(1, "s", "en", 1, "x")])
    assert one == brute.manifest([(1, "s", "en", 1, "x")]) and one[0][1] == one[0][3]


def test_nothing_altered(spark):
    df = spark.createDataFrame([(k, "s", "en", 1, f"T{k}") for k in range(40)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert manifest.verified_manifest(df).filter("not verified").count() == 0
