"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is a map over the pages: each row becomes one record and Spark's text writer, with the record trailer as line
separator, lays the records end to end. Only (page, digest) pairs are shuffled to find equal payloads; a page learns that
it revisits another through a join with the revisits alone.

Reading must split large archives, and a payload may hold the very bytes that begin a record. Tasks therefore read byte
ranges cut at every occurrence of the version line. Each occurrence is a *candidate*: if a header follows, the length that
it states gives the offset of its successor. Only candidates on the chain from the start of the file are records; the rest
are payload. Within a range a task shortens every chain to where it leaves the range; the exits, a few per range, are
resolved by pointer jumping (each round doubles the reach), so a file of any length takes logarithmically many rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.session import write_and_reload

VERSION = "WARC/1.1\r\n"
TRAILER = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# Writing


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 160 bits as twice 60 and once 40."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, start, size), 16, 32), size * 4 // 5, "0") for start, size in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), *_BASE32)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """(id, digest, target) of the pages whose payload of at least ``min_bytes`` bytes a page with a smaller id has too."""
    payload = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    found = pages.select(F.col(id_col).cast("bigint").alias("id"), base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    found = write_and_reload(found.filter(F.col("size") >= min_bytes), "payloads")
    first = found.groupBy("digest").agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.join(first, "digest").filter("id > target")
    return later.select("id", "digest", "target").distinct()


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write one record per row of ``pages`` to the folder ``path``: of equal payloads the page with the smallest id is the
    response and the others revisit it; payloads below ``min_bytes`` bytes are all responses.

    A null payload is the empty one. Rows that repeat the smallest id are all responses; a null id is always a response,
    called ``null``. Line breaks in a url are percent-encoded; a null url is left out. Extra columns are ignored.
    """
    later = write_and_reload(revisits(pages, min_bytes, id_col, body_col), "revisits")
    later = later.select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "target")
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    # The revisits lie in a file of known size: Spark broadcasts them if they are few, and shuffles the pages only if not.
    rows = rows.join(later, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    again = F.col("target").isNotNull()
    crlf = F.lit("\r\n")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(HTTP), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.octet_length("body"))
    head = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(again, "revisit").otherwise("response"), crlf,
        F.lit("WARC-Record-ID: "), _record_id(F.col("id")), crlf, F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, crlf), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), crlf,
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(F.col("target")), crlf)).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, http, F.when(again, "").otherwise(F.col("body")))
    rows.select(record.alias("value")).write.option("lineSep", TRAILER).text(path)


# Reading


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, f"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row per occurrence of the version line, in the order of each byte range: the bytes up to the next occurrence.

    The first row of a file holds what stands before its first version line.
    """
    return spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("piece"),
    )


def _block(piece: Column, head_size: Column, stated: Column) -> Column:
    return F.substring(piece, (head_size + 1).cast("int"), stated.cast("int"))


def _payload(block: Column, content_type: Column) -> dict[str, Column]:
    """What stands behind the HTTP header of a record's block; the whole block where there is none."""
    is_http = F.coalesce(F.lower(content_type).startswith("application/http"), F.lit(False))
    head = F.substring_index(block.cast("string"), TRAILER, 1)
    body = F.when(is_http, F.substring(block, F.octet_length(head) + len(TRAILER) + 1, F.octet_length(block))).otherwise(block)
    return {
        "http_length": F.when(is_http, _field(head, "Content-Length").cast("bigint")), "payload_size": F.octet_length(body).cast("bigint"),
        "payload_digest": base32_sha1(body), "payload": body,
    }


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each piece with what its header states, and the digest of its payload if the stated length ends where the piece ends."""
    # Bytes that are no text stay as they are: the search for the blank line compares bytes, and only the header is read as text.
    found = _pieces(spark, path).withColumn("top", F.substring_index(F.col("piece").cast("string"), TRAILER, 1))
    found = found.withColumn("head", F.when(F.octet_length("top") < F.octet_length("piece"), F.col("top")))
    head = F.col("head")
    found = found.select(
        "file", "block", "file_size", "piece", F.octet_length("piece").cast("bigint").alias("size"),
        (F.octet_length(head) + len(TRAILER)).cast("bigint").alias("head_size"), _field(head, "Content-Length").try_cast("bigint").alias("stated"),
        _field(head, "WARC-Type").alias("type"), _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Target-URI").alias("uri"),
        _field(head, "WARC-Refers-To").alias("refers"), _field(head, "WARC-Payload-Digest").alias("claimed"), _field(head, "Content-Type").alias("content_type"),
    )
    # From the version line of this candidate to that of its successor.
    reach = F.when(F.col("stated") >= 0, F.lit(len(VERSION)) + F.col("head_size") + F.col("stated") + len(TRAILER))
    alone = F.coalesce(reach == F.col("size") + len(VERSION), F.lit(False))
    parts = _payload(_block(F.col("piece"), F.col("head_size"), F.col("stated")), F.col("content_type"))
    return found.select(
        "file", "block", "file_size", "size", "head_size", "stated", "type", "record_id", "uri", "refers", "claimed", "content_type",
        reach.alias("reach"), alone.alias("alone"), *[F.when(alone, parts[c]).alias(c) for c in ("http_length", "payload_size", "payload_digest")],
    )


def _with_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``rel``, the offset of each candidate's version line from the first piece of its byte range.

    Expects the columns file, block and size; the rows of a range come together and in order. No batch spans two ranges.
    """
    now, at = None, 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        start = 0
        for end in range(1, batch.num_rows + 1):
            if end < batch.num_rows and files[end] == files[start] and blocks[end] == blocks[start]:
                continue
            if (files[start], blocks[start]) != now:
                now, at = (files[start], blocks[start]), 0
            ends = at + np.cumsum(sizes[start:end] + len(VERSION))
            rel = np.r_[at, ends[:-1]] - len(VERSION)
            at = int(ends[-1])
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rel, pa.int64())], names=[*part.schema.names, "rel"])
            start = end


def _with_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds for each candidate where its chain leaves the byte range, and its place in the tree of chains of the range.

    ``leaves`` is null if the chain breaks inside the range. Candidate x lies on the chain of e in the same range if and only
    if ``x.first <= e.first < x.first + x.under``.
    """
    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rel, reach = whole.column("rel").to_pylist(), whole.column("reach").to_pylist()
        place = {r: i for i, r in enumerate(rel)}
        end, n = rel[-1] + len(VERSION) + whole.column("size")[-1].as_py(), len(rel)
        # A successor lies later, so chains are shortened from the last candidate backwards.
        after, leaves = [None] * n, [None] * n
        for i in range(n - 1, -1, -1):
            if reach[i] is None:
                continue
            to = rel[i] + reach[i]
            after[i] = place.get(to)
            leaves[i] = leaves[after[i]] if after[i] is not None else to if to >= end else None
        under = [1] * n
        for i in range(n):
            if after[i] is not None:
                under[after[i]] += under[i]
        first, free, roots = [0] * n, [0] * n, 0
        for i in range(n - 1, -1, -1):
            if after[i] is None:
                first[i], roots = roots, roots + under[i]
            else:
                first[i] = free[after[i]]
                free[after[i]] += under[i]
            free[i] = first[i] + 1
        new = [pa.array(x, pa.int64()) for x in (leaves, first, under)]
        return pa.RecordBatch.from_arrays([*whole.columns, *new], names=[*whole.schema.names, "leaves", "first", "under"])

    now, held = None, []
    for batch in _with_offsets(batches):
        mine = (batch.column("file")[0].as_py(), batch.column("block")[0].as_py())
        if mine != now and held:
            yield finish(held)
            held = []
        now = mine
        held.append(batch)
    if held:
        yield finish(held)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + more


def _bases(marked: DataFrame) -> DataFrame:
    """(file, block, base): where the first piece of each byte range begins."""
    totals = marked.groupBy("file", "block").agg(F.sum(F.col("size") + len(VERSION)).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))


def _reached(entries: DataFrame) -> DataFrame:
    """(file, at) of the entries on the chain from offset 0, by pointer jumping over ``entries`` (file, at, to)."""
    jump = entries
    reached = entries.filter("at = 0").select("file", "at")
    size = -1
    while True:
        reached = write_and_reload(reached, "reached")
        grown = reached.count()
        if grown == size:
            return reached
        size = grown
        steps = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        known = entries.select("file", "at")
        reached = reached.union(steps.join(known, ["file", "at"], "left_semi")).distinct()
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = write_and_reload(jump.join(far, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the uncompressed archives in ``path``: file, at, next, type, record_id, uri, refers, claimed (digest),
    payload_size, payload_digest (both of the bytes read), http_length and, if asked for, payload.

    Only records on the chain from the start of their file are returned, whatever their payloads hold. A chain that breaks
    (a damaged or cut archive) ends at the break. Empty files give no records.
    """
    found = _candidates(spark, path)
    marked = write_and_reload(found.mapInArrow(_with_chains, _schema(found, "rel bigint, leaves bigint, first bigint, under bigint")), "candidates")
    bases = write_and_reload(_bases(marked), "ranges")
    marked = marked.join(bases, ["file", "block"]).withColumn("at", F.col("rel") + F.col("base")).filter("at >= 0")
    marked = marked.withColumn("to", F.col("leaves") + F.col("base")).withColumn("next", F.col("at") + F.col("reach"))
    heads = marked.filter("to is not null").select("file", F.col("to").alias("at")).distinct()
    starts = marked.filter("at = 0").select("file", "at")
    entries = marked.join(heads.union(starts).distinct(), ["file", "at"], "left_semi").select("file", "at", "to", "block", "first")
    entries = write_and_reload(entries, "entries")
    true_entries = _reached(entries.select("file", "at", "to"))
    inside = entries.join(true_entries, ["file", "at"], "left_semi").select("file", "block", F.col("first").alias("entry"))
    records = marked.join(inside, ["file", "block"]).filter("first <= entry and entry < first + under and next <= file_size")
    kept = ["file", "at", "next", "type", "record_id", "uri", "refers", "claimed"]
    facts = ["http_length", "payload_size", "payload_digest"]
    records = write_and_reload(records.select(*kept, "head_size", "stated", "content_type", "alone", *facts), "records")
    if payloads:
        whole, rest = records, None
    else:
        whole, rest = records.filter("not alone"), records.filter("alone").select(*kept, *facts)
        if whole.isEmpty():  # no payload holds a version line: all digests are known from the one scan
            return rest
    # Pieces that lie inside a record belong to the last record that begins before them.
    order = Window.partitionBy("file").orderBy("at")
    owned = marked.select("file", "at").join(whole.select("file", "at", F.lit(True).alias("own")), ["file", "at"], "left")
    others = records.join(whole, ["file", "at"], "left_anti").select("file", "at")
    owned = owned.join(others, ["file", "at"], "left_anti")
    owned = owned.withColumn("owner", F.last(F.when(F.col("own"), F.col("at")), ignorenulls=True).over(order)).filter("owner is not null")
    owned = write_and_reload(owned.select("file", "at", "owner"), "owned")
    raw = _pieces(spark, path).withColumn("size", F.octet_length("piece").cast("bigint"))
    raw = raw.mapInArrow(_with_offsets, _schema(raw, "rel bigint")).join(bases, ["file", "block"]).withColumn("at", F.col("rel") + F.col("base"))
    parts = raw.select("file", "at", "piece").join(owned, ["file", "at"]).groupBy("file", "owner")
    joined = parts.agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts")).select("file", F.col("owner").alias("at"), "parts")
    version = F.lit(VERSION).cast("binary")
    # A record is put together from its own pieces only; the payload of the largest record bounds the memory.
    joined = joined.withColumn("piece", F.aggregate("parts", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x["piece"]).otherwise(F.concat(a, version, x["piece"]))))
    whole = whole.drop(*facts).join(joined.drop("parts"), ["file", "at"])
    fresh = _payload(_block(F.col("piece"), F.col("head_size"), F.col("stated")), F.col("content_type"))
    wanted = [*facts, "payload"] if payloads else facts
    whole = whole.select(*kept, *[fresh[c].alias(c) for c in wanted])
    return whole if rest is None else rest.unionByName(whole)


def page_of(record_id: Column) -> Column:
    """The page id in a record id of ``write_warc``; null for another id."""
    return F.regexp_extract(record_id, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("bigint")


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of archives that ``write_warc`` wrote: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Of a response the length and digest are those of the bytes read, of a revisit those that it states for the full payload.
    """
    found = read_warc(spark, path)
    claimed = F.regexp_replace("claimed", "^sha1:", "")
    again = F.col("type") == "revisit"
    return found.select(
        page_of(F.col("record_id")).alias("page_id"), F.when(again, F.col("http_length")).otherwise(F.col("payload_size")).alias("payload_bytes"),
        F.when(again, claimed).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"),
        page_of(F.col("refers")).alias("refers_to"),
        (again | ((claimed == F.col("payload_digest")) & (F.col("http_length") == F.col("payload_size")))).alias("intact"), "file", "at",
    )
