import brute
import numpy as np
import pytest

from formline.llm import exact, queries, simhash
from formline.llm.common import table, text_pieces
from formline.llm.components import connected_components

EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.edge_docs(spark)


def exact_rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_exact_groups_of_edge_rows(spark, docs):
    found = exact.exact_groups(docs)
    assert exact_rows(found) == brute.exact(brute.EDGE)
    # Repeated rows tie: exactly one row of each group stays.
    assert all(r["n"] == 1 for r in found.groupBy("text_sha256").agg({"kept": "max"}).withColumnRenamed("max(kept)", "k").selectExpr("int(k) as n").collect())
    assert found.filter("kept").count() == len({brute.lower(t) for _, t in brute.EDGE})


def test_smallest_stays_and_null_id_last(docs):
    keep = {r.text_sha256: r.keep_id for r in exact.exact_groups(docs, keep="smallest").collect()}
    assert keep[brute.sha("hello world again my friend")] == 1


@pytest.mark.parametrize("fan_in", [2, 3, 50])
def test_every_fan_in_gives_the_same(spark, sf, fan_in):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    many = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(11)
    assert exact_rows(exact.exact_groups(many, fan_in=fan_in)) == brute.exact(rows)


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "Same Text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    hot = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    assert exact_rows(exact.exact_groups(hot)) == brute.exact(rows)


def test_exact_copies_go_once(docs):
    left = exact.drop_exact_copies(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    want = {}
    for i, t in brute.EDGE:
        if brute.lower(t) not in want or (i is not None and (want[brute.lower(t)][0] is None or i >= want[brute.lower(t)][0])):
            want[brute.lower(t)] = (i, t)
    assert got == sorted(want.values(), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], EMPTY)
    assert exact.exact_groups(empty).collect() == []
    assert exact.drop_exact_copies(empty).collect() == []
    assert simhash.near_groups(empty).collect() == []
    assert simhash.drop_near_copies(empty).collect() == []


def test_query_of_exact_dedup(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert exact_rows(queries.QUERIES["op10_exact_dedup"](spark, sf)) == brute.exact(rows)


# SimHash


def test_fingerprints_equal_the_definition(monkeypatch):
    texts = [t or "" for _, t in brute.EDGE if len(t or "") < 1000] + ["A b", "a  B\tc", " ".join(f"w{i % 7}" for i in range(500))]
    want = [brute.fingerprint(t) for t in texts]
    assert simhash.fingerprints_of([t.encode() for t in texts]).tolist() == want
    # Long texts are worked on in pieces.
    monkeypatch.setattr(simhash, "PIECE_BYTES", 8)
    monkeypatch.setattr(text_pieces, "__defaults__", (8,))
    assert simhash.fingerprints_of([t.encode() for t in texts]).tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_carry_save_counters(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 64, 9000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 12)))) for _ in a], dtype=np.uint64)
    assert (simhash.within(a, a ^ flips, radius) == (np.bitwise_count(flips) <= radius)).all()
    assert not simhash.within(a[:4000], a[4000:8000], radius).any()  # all blocks are abandoned


def cloud(seed, n=90):
    """Chains and balls of fingerprints, so that links are many and components long."""
    rng, out = np.random.default_rng(seed), []
    for centre in rng.integers(0, 1 << 64, 4, dtype=np.uint64):
        for _ in range(n):
            other = centre
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                other ^= np.uint64(1) << np.uint64(b)
            out.append(int(other))
            if rng.random() < 0.5:
                centre = other
    return sorted(set(out))


@pytest.mark.parametrize("forest", [lambda p: simhash.forest_of_one(p, 3), lambda p: simhash.forest_of_many(p, np.full(len(p), len(p)), 3)])
def test_forests_connect_what_all_pairs_connect(forest):
    prints = cloud(5)
    place = {p: k for k, p in enumerate(prints)}
    a, b = forest(np.array(prints, np.uint64))
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        up[max(find(place[x]), find(place[y]))] = min(find(place[x]), find(place[y]))
    assert len(a) < len(prints)
    assert [find(k) for k in range(len(prints))] == brute.components(prints, list(range(len(prints))))


@pytest.mark.parametrize("refine_above", [5, 40, 10_000])
def test_links_with_and_without_refined_files(spark, refine_above):
    prints = cloud(6) + [0, 1, (1 << 64) - 1]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "print bigint"), refine_above=refine_above)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    got = {}
    for k, (p,) in enumerate(signed):
        got.setdefault(found.get(p, p), []).append(k)
    want = {}
    for k, c in enumerate(brute.components(prints, list(range(len(prints))))):
        want.setdefault(c, []).append(k)
    assert sorted(got.values()) == sorted(want.values())


def check_near(found, rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute.components(prints, [i for i, _ in rows]))), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()), key=repr) == want


def test_near_groups_of_edge_rows(docs):
    check_near(simhash.near_groups(docs), brute.EDGE)


def test_query_of_simhash(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check_near(queries.QUERIES["op3_simhash"](spark, sf), rows)


def test_one_document_of_each_near_group_stays(docs):
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    prints = [brute.fingerprint(t) for _, t in brute.EDGE]
    groups = brute.components(prints, [i for i, _ in brute.EDGE])
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(groups))


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    odd = [(5000, 5000), (None, 3), (7000, 6999), (6999, 7000)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(path + hub + odd, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {7000: 6999, 6999: 6999}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
