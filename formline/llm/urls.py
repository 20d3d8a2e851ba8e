"""URL filters: prefix rules first, then exact list membership by a cascade of Bloom filters.

The first filter encodes the listed keys; the second encodes the corpus keys that the first accepts wrongly; the third the
listed keys that the second accepts wrongly; and so on until nothing is left. Over the complete universe of corpus keys the
cascade answers exactly, from a few bits per listed key and without a join. Filters are built from bit positions with
``bit_or`` per word and become array literals of the lookup expression, so the lookup is a map over the pages.

The literals are bounded by ``max_bits``; a longer list is looked up by a semi-join instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import free_name
from formline.session import write_and_reload

BITS_PER_KEY = 10
HASHES = 4
MAX_BITS = 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # allow or block, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(length, action, rule) of the longest rule that fits, else null. Equal lengths: block before allow, then the later text."""
    fits = []
    for action, rule_host, rule_path in rules:
        here = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = rule_host + rule_path
        fits.append(F.when(here, F.struct(F.lit(len(text)).alias("length"), F.lit(action).alias("action"), F.lit(text).alias("rule"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def host_keys(host: Column, labels: int) -> Column:
    """The suffixes of a host of at most ``labels`` labels, whole labels only."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))


@dataclass
class Cascade:
    """``levels``: (number of bits, words of 64 bits) of each filter, even ones for the listed keys."""

    levels: list[tuple[int, list[int]]]

    def contains(self, key: Column) -> Column:
        answer = F.lit(False)
        for depth in range(len(self.levels) - 1, -1, -1):
            answer = _has(key, depth, *self.levels[depth]) & (~answer)
        return answer


def _positions(key: Column, depth: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(depth), F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def _has(key: Column, depth: int, bits: int, words: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded into one literal
    found = F.lit(True)
    for at in _positions(key, depth, bits):
        found = found & (F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
    return found


def _filter_of(keys: DataFrame, depth: int, bits: int) -> list[int]:
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), depth, bits))).alias("at"))
    word = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    words = [0] * (bits // 64)
    for row in word.collect():  # bits / 64 rows at most
        words[row["word"]] = row["bits"]
    return words


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS, max_levels: int = 64) -> Cascade | None:
    """A cascade that is exact for every ``key`` of ``universe``; None if a filter would exceed ``max_bits``.

    Null and repeated keys are ignored. Listed keys that are not in the universe need no bits.
    """
    universe = write_and_reload(universe.select("key").filter("key is not null").distinct(), "universe")
    listed = listed.select("key").filter("key is not null").distinct()
    inside = write_and_reload(universe.join(listed, "key", "left_semi"), "listed")
    outside = universe.join(inside, "key", "left_anti")
    levels: list[tuple[int, list[int]]] = []
    while (n := inside.count()) > 0:
        bits = -(-max(64, n * bits_per_key) // 64) * 64
        if bits > max_bits:
            return None
        if len(levels) == max_levels:
            raise RuntimeError("the cascade does not end")
        words = _filter_of(inside, len(levels), bits)
        wrong = write_and_reload(outside.filter(_has(F.col("key"), len(levels), bits, words)), "false-positives")
        levels.append((bits, words))
        inside, outside = wrong, inside
    return Cascade(levels)


def judge_urls(
    pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    ``listed`` has a column ``key`` of hosts: a host is blocked if it or a domain above it is listed. The rule's verdict goes
    before the list's. Null urls have an empty host and path and are allowed. Repeated rows are judged one by one.
    """
    deepest = listed.select(F.max(F.size(F.split("key", "\\."))).alias("n")).first()["n"] or 1
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<length:int,action:string,rule:string>"))
    hosts = rows.select("host").distinct()
    universe = hosts.select(F.explode(host_keys(F.col("host"), deepest)).alias("key"))
    cascade = build_cascade(universe, listed, bits_per_key, max_bits)
    if cascade is not None:
        bad = F.exists(host_keys(F.col("host"), deepest), cascade.contains)
    else:
        keys = hosts.select("host", F.explode(host_keys(F.col("host"), deepest)).alias("key"))
        hit = keys.join(listed.select("key").distinct(), "key", "left_semi").select(F.col("host").alias("hit")).distinct()
        rows = rows.join(hit, F.col("host") == F.col("hit"), "left")
        bad = F.col("hit").isNotNull()
    verdict = F.coalesce(F.col("fit.action"), F.when(bad, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def keep_allowed(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` without the blocked rows, columns as they came."""
    row, = free_name(pages, "url_row")
    judged = judge_urls(pages.select(F.struct("*").alias(row), F.col(url_col).alias("url")), rules, listed, id_col=row)
    return judged.filter("verdict = 'allow'").select("page_id.*")
