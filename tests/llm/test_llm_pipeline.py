import brute
import corpus_pipeline
import pytest

from formline.llm.common import table
from formline.session import write_and_reload


def test_stages_take_effect_on_all_documents(spark, sf):
    """Each stage against brute force over what its predecessor kept."""
    docs = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    extra = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "upper(text) as text", "lang", "source", "n_chars").union(
        spark.createDataFrame([(200000, None, "en", "s", 0), (200001, "", "en", "s", 0), (200002, "Привет мир как дела", "ru", "s", 0)], docs.schema)
    )
    docs = docs.union(extra).union(docs.limit(2))
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = write_and_reload(stage(spark, docs, sf), f"test-{name}")
        if name != "mixing":
            assert docs.columns == columns
        if name == "language":
            gone = {i for i, _ in before} - {i for i, _ in rows(docs)}
            assert {200000, 200001} <= gone <= {200000, 200001, 200002} and docs.count() >= len(before) - 3
        elif name == "exact":
            want = {}
            for i, t in before:
                want[brute.lower(t)] = max(i, want.get(brute.lower(t), i))
            assert sorted(i for i, _ in rows(docs)) == sorted(want.values()) and docs.count() < len(before)
        elif name == "near":
            prints = [brute.fingerprint(t) for _, t in before]
            assert sorted(i for i, _ in rows(docs)) == sorted(set(brute.components(prints, [i for i, _ in before])))
        elif name == "benchmark":
            assert sorted(i for i, _ in rows(docs)) == sorted(i for i, _, hit, _ in brute.leaks(before, items) if not hit) and docs.count() < len(before)
        else:
            found = docs.collect()
            assert sorted(r.doc_id for r in found) == sorted(i for i, _ in before)
            total = sum(r.n_tokens for r in found)
            assert sum(r.p_good * r.expected_tokens for r in found) == pytest.approx(0.85 * total, rel=1e-3)


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
