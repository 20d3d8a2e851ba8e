import brute
import pytest
from pyspark.sql import functions as F

from formline.llm import queries, urls, warc
from formline.llm.common import table
from formline.session import shared_dir

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/", "x"), (2, None, None), (3, "u", "x"), (4, "u\r\nX: y", RECORD), (5, "u", "WARC/1.1\r\n"), (6, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n"),
    (7, "u", "aWARC/1.WARC/1.1\rWARC/1.1\r\nContent-Length: 7\r\n\r\nzz"), (8, "ü", RECORD * 3 + "é" * 5000), (9, "u", ""), (10, "u", RECORD), (None, "u", "x"), (11, "u", "y\r\n\r\n"),
    (11, "v", "y\r\n\r\n"), (12, "u", "é" * 20_000 + "WARC/1.1\r\n" * 50), (13, "u", "\r\n\r\n" + "z" * 200_000), (14, "u", "\r\n"), (15, "u", "WARC/1.1\r\nContent-Length: x\r\n\r\n"),
] + [(i, f"http://b/{i}", f"page {i % 37} " * (i % 9)) for i in range(20, 80)]


def pages_df(spark, rows=PAGES):
    clash = ["id", "digest", "target", "body", "file", "at", "host", "key", "hit"]
    schema = "page_id bigint, url string, html string, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *clash) for r in rows], schema)


@pytest.mark.parametrize("split", ["5k", "128m"])
def test_headers_of_any_length(spark, split, tmp_path):
    rows = [(1, "data:" + "x" * 20_000, "a"), (2, "data:" + "é" * 200_000, RECORD), (3, "u", "a"), (4, "data:" + "y" * 16_384, ""), (5, None, "b")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        folder = shared_dir(spark, "warc")
        warc.write_warc(pages_df(spark, rows).coalesce(1), folder)
        found = warc.page_records(spark, folder)
        assert read_rows(found) == expected(rows) and found.filter("not intact").count() == 0
        # A long header of the block, with bytes that are no text, in front of a payload.
        http = b"HTTP/1.1 200 OK\r\nX: " + b"z\xff\xe2" * 10_000 + b"\r\nContent-Length: 5\r\n\r\n"
        head = b"WARC/1.1\r\nWARC-Type: response\r\nX: \xff\xf0\r\nWARC-Record-ID: <urn:x-page:7>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (len(http) + 5)
        (tmp_path / "a.warc").write_bytes((head + http + b"hello\r\n\r\n") * 2)
        read = warc.read_warc(spark, str(tmp_path)).collect()
        assert [(r.payload_size, r.http_length, r.payload_digest) for r in read] == [(5, 5, brute.base32_sha1("hello"))] * 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def expected(rows, min_bytes=0):
    size = lambda h: len((h or "").encode())
    low = {}
    for i, _, h in rows:
        if i is not None:
            low[brute.base32_sha1(h)] = min(i, low.get(brute.base32_sha1(h), i))
    out = []
    for i, _, h in rows:
        first = low.get(brute.base32_sha1(h))
        again = i is not None and size(h) >= min_bytes and first < i
        out.append((i, size(h), brute.base32_sha1(h), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def read_rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.fixture()
def split_bytes(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split_bytes", ["5k", "128m"], indirect=True)
def test_hostile_payloads_come_back(spark, split_bytes):
    folder = shared_dir(spark, "warc")
    warc.write_warc(pages_df(spark).coalesce(2), folder)
    found = warc.page_records(spark, folder)
    assert read_rows(found) == expected(PAGES) and found.filter("not intact").count() == 0
    bodies = {}
    for r in warc.read_warc(spark, folder, payloads=True).filter("type = 'response'").collect():
        bodies.setdefault(r.record_id, set()).add(bytes(r.payload).decode())
    want = {}
    for i, _, h in PAGES:
        if (i, len((h or "").encode()), brute.base32_sha1(h), "response", None) in expected(PAGES):
            want.setdefault(f"<urn:x-page:{'null' if i is None else i}>", set()).add(h or "")
    assert bodies == want


def test_small_payloads_are_never_revisits(spark):
    folder = shared_dir(spark, "warc")
    warc.write_warc(pages_df(spark), folder, min_bytes=6)
    assert read_rows(warc.page_records(spark, folder)) == expected(PAGES, 6)


def test_no_pages(spark):
    folder = shared_dir(spark, "warc")
    warc.write_warc(pages_df(spark, []), folder)
    assert warc.page_records(spark, folder).collect() == []


def test_a_third_of_all_payloads_are_one(spark):
    rows = [(i, "u", "same" if i % 3 else f"p{i}") for i in range(600)]
    folder = shared_dir(spark, "warc")
    warc.write_warc(pages_df(spark, rows).repartition(8), folder)
    assert read_rows(warc.page_records(spark, folder)) == expected(rows)


def test_query_of_warc(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, sf, "pages").collect()]
    assert read_rows(queries.QUERIES["op1_warc"](spark, sf)) == expected(rows)


# URL filters

URLS = [
    (1, "http://A.Example.org/es/1?x"), (2, "http://example.org/en/12#a"), (3, "https://www.example.org"), (4, "http://badexample.org/es/"), (5, "http://x.com/fr/1"), (6, "ftp://x.com/de/"),
    (7, None), (8, ""), (9, "no scheme /es/"), (10, "http://"), (11, "http://casino-win.example.net?q=1"), (12, "http://m.a.spam.example.com/it/"), (13, "http://spam.com/fr/"),
    (14, "http://spamfarm.example.net/"), (15, "http://www.spam-farm.example.org/es/"), (16, "http://u:p@Casino.example.net:80/a"), (17, "http://x.com/fr"), (17, "http://x.com/fr"),
    (18, "a://b://c/d"), (19, "http://Ünï.example.net/é?"), (20, "http://" + "a." * 3000 + "casino.b.c/" + "p" * 5000), (None, "http://casino.b.c/"),
]


def judge(url, listed, rules=queries.RULES):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = brute.lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    parts = host.split(".")
    return host, path, None, "block" if any(".".join(parts[k:]) in listed for k in range(len(parts))) else "allow"


@pytest.mark.parametrize("max_bits", [1 << 22, 1])
def test_verdicts_by_cascade_and_by_join(spark, max_bits):
    listed = {"casino-win.example.net", "spam.example.com", "casino.b.c", "spam.com", "example.net:80", "not.there"}
    keys = spark.createDataFrame([(k,) for k in sorted(listed)] + [(None,), ("spam.com",)], "key string")
    rows = pages_df(spark, [(i, u, "") for i, u in URLS])
    found = urls.judge_urls(rows, queries.RULES, keys, max_bits=max_bits)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=repr)
    assert got == sorted(((i, *judge(u, listed)) for i, u in URLS), key=repr)


def test_cascade_is_exact_with_few_bits(spark):
    universe = spark.range(4000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 7 = 0")
    cascade = urls.build_cascade(universe, listed, bits_per_key=3)
    assert len(cascade.levels) > 2  # false positives had to be encoded in turn
    wrong = universe.filter(cascade.contains(F.col("key")) != (F.crc32("key") % 7 == 0))
    assert wrong.count() == 0


def test_empty_url_tables(spark):
    none = spark.createDataFrame([], "key string")
    assert urls.judge_urls(pages_df(spark, []), queries.RULES, none).collect() == []
    assert {r.verdict for r in urls.judge_urls(pages_df(spark), [], none).collect()} == {"allow"}
    left = urls.keep_allowed(pages_df(spark, [(i, u, "") for i, u in URLS]), queries.RULES, none)
    assert left.columns == pages_df(spark).columns and left.count() == sum(judge(u, set())[3] == "allow" for _, u in URLS)


def test_query_of_urls(spark, sf):
    rows = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    listed = set()
    for url in rows.values():
        parts = judge(url, set())[0].split(".")[-3:]
        if len(parts) == 3 and set(parts[0].split("-")) & set(queries.BAD_WORDS):
            listed.add(".".join(parts))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.QUERIES["op8_url_filter"](spark, sf).collect()}
    assert got == {i: judge(u, listed) for i, u in rows.items()}
