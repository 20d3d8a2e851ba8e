"""Mixing to target weights with soft domain membership.

A naive Bayes classifier over hashed words and word endings, fitted on the labelled table, gives each document a posterior
over the domains. Non-negative document rates (expected numbers of copies) are then fitted so that the expected tokens of
each domain, the sum of rate x tokens x posterior, meet the targets: projected gradient on the least squares of the domain
totals, started at rate one, in the metric of the document lengths. In that metric the rate depends on the posterior
alone and a step of one is safe (the posteriors of a document sum to one).

Posteriors are multiples of 1/256, so documents fall into a bounded number of cells whose tokens are summed once; the
iterations run over the cells. Each iteration brings one number per domain to the driver. All of it is DataFrame work.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import bounded_sample
from formline.session import write_and_reload

_LOG = logging.getLogger(__name__)
SLOTS = 1 << 14
SAMPLE_PER_DOMAIN = 4000
STEPS = 256  # a posterior is a multiple of 1 / STEPS
TEMPERATURE = 2.0
_ROUND = 50  # gradient steps between writings of the rates
SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SPACE)


def _slot(value: Column, kind: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(kind)), F.lit(SLOTS)).cast("int")


def _slots(word: Column) -> list[Column]:
    """A word counts as itself and by its last two characters."""
    return [_slot(word, 0), _slot(F.substring(word, -2, 2), 1)]


def _literal(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")  # folded into one literal


def fit_classifier(
    docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], per_domain: int = SAMPLE_PER_DOMAIN, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id",
) -> tuple[list[float], list[list[float]]]:
    """(log priors, log weights per slot) of ``domains``.

    ``domain`` is a column over ``labels``. At most ``per_domain`` labelled rows of each domain (those with the smallest hash
    of their id) are learned from; rows without a domain of the list are left out. A domain without rows gets the smallest prior.
    """
    known = labels.select(F.col(label_id_col).alias("id"), domain.alias("domain")).filter(F.col("domain").isin(*domains) & F.col("id").isNotNull())
    sample = bounded_sample(known.distinct(), ["domain"], per_domain)
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # At most per_domain rows a domain: the bound is proven, so the sample is broadcast and the texts stay where they are.
    learned = text.join(F.broadcast(sample), F.col("doc") == F.col("id"))
    words = learned.select("domain", F.explode(words_of(F.col("text"))).alias("word")).filter("word <> ''")
    counts = words.select("domain", F.explode(F.array(*_slots(F.col("word")))).alias("slot")).groupBy("domain", "slot").count()
    seen = {d: [1.0] * SLOTS for d in domains}  # add-one smoothing
    for row in counts.collect():  # SLOTS rows a domain at most
        seen[row["domain"]][row["slot"]] += row["count"]
    weights = [[math.log(c / sum(seen[d])) for c in seen[d]] for d in domains]
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(sizes.values()) + len(domains)
    return [math.log((sizes.get(d, 0) + 1) / total) for d in domains], weights


def memberships(
    docs: DataFrame, priors: list[float], weights: list[list[float]], temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, cell) for each row; ``cell`` holds the posterior of each domain in units of 1/STEPS."""
    k = len(priors)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col).cast("string")).alias("words"))
    words = rows.select("row", "id", F.explode_outer("words").alias("word"))
    words = words.select("row", "id", F.when(F.col("word") != "", F.col("word")).alias("word"))
    slots = words.select("row", "id", "word", *[s.alias(f"s{i}") for i, s in enumerate(_slots(F.col("word")))])
    # Only differences to the first domain matter.
    sums = []
    for d in range(1, k):
        gain = _literal([a - b for a, b in zip(weights[d], weights[0])])
        sums.append(F.sum(F.when(F.col("word").isNotNull(), F.get(gain, F.col("s0")) + F.get(gain, F.col("s1")))).alias(f"g{d}"))
    scored = slots.groupBy("row").agg(F.first("id").alias("id"), F.count("word").alias("n_tokens"), *sums)
    gains = [F.lit(0.0)] + [(F.coalesce(f"g{d}", F.lit(0.0)) + priors[d] - priors[0]) / temperature for d in range(1, k)]
    top = F.greatest(*gains) if k > 1 else gains[0]
    powers = [F.exp(g - top) for g in gains]
    whole = sum(powers[1:], powers[0])
    # Cumulated shares are rounded, so that the parts sum to STEPS.
    upto = [F.round(sum(powers[1:d + 1], powers[0]) / whole * STEPS).cast("int") for d in range(k)]
    cell = F.array(upto[0], *[upto[d] - upto[d - 1] for d in range(1, k)])
    return scored.select("id", F.col("n_tokens").cast("bigint").alias("n_tokens"), cell.alias("cell"))


def rate_after(steps: list[list[float]], cell: Column, start: Column) -> Column:
    """The rate after gradient ``steps`` from ``start`` (one list over the domains each), projected to non-negative values after each."""
    if not steps:
        return start
    flat = F.split(F.lit(";".join(",".join(f"{g:.12e}" for g in s) for s in steps)), ";")
    table = F.transform(flat, lambda s: F.split(s, ",").cast("array<double>"))

    def step(rate: Column, gradient: Column) -> Column:
        fall = F.aggregate(F.arrays_zip(gradient.alias("g"), cell.alias("p")), F.lit(0.0), lambda a, x: a + x["g"] * x["p"] / STEPS)
        return F.greatest(F.lit(0.0), rate - fall)

    return F.aggregate(table, start, step)


def fit_rates(
    members: DataFrame, targets: Mapping[str, float], domains: list[str], tokens: float | None = None, max_steps: int | None = None, tolerance: float = 1e-6,
):
    """(cells with their rate, report): rates whose expected domain totals meet ``targets`` (shares, scaled to one).

    ``tokens`` is the size of the mix, by default that of the corpus. Steps go on until the largest miss is within
    ``tolerance`` of the mix, or ``_ROUND`` steps lessen it by under a twentieth: then the targets cannot be met, or only by very many
    more steps. The rates so far are written after each round, so that a step replays a bounded number of earlier ones.
    ``max_steps`` ends it sooner if given. The report has each domain's natural, target and expected tokens; a miss is logged.
    """
    cells = write_and_reload(members.groupBy("cell").agg(F.sum("n_tokens").alias("tokens")).withColumn("rate", F.lit(1.0)), "cells")
    k, share = len(domains), sum(targets.get(d, 0.0) for d in domains)
    if share <= 0 or any(targets.get(d, 0.0) < 0 for d in domains):
        raise ValueError("targets are not negative and not all zero")

    def totals(cells: DataFrame, rate: Column) -> list[float]:
        mass = [F.sum(rate * F.col("tokens") * F.get("cell", F.lit(d)) / STEPS) for d in range(k)]
        return [float(x or 0.0) for x in cells.agg(*mass).first()]

    natural = totals(cells, F.lit(1.0))
    size = sum(natural) if tokens is None else tokens
    wanted = [size * targets.get(d, 0.0) / share for d in domains]

    def miss(now: list[float]) -> float:
        return max((abs(a - b) for a, b, m in zip(now, wanted, natural) if m), default=0.0)

    steps, now, taken, before = [], natural, 0, float("inf")
    while miss(now) > tolerance * max(size, 1.0) and (max_steps is None or taken < max_steps):
        if len(steps) == _ROUND:
            if max_steps is None and miss(now) > 0.95 * before:
                break
            cells = write_and_reload(cells.withColumn("rate", rate_after(steps, F.col("cell"), F.col("rate"))), "cells")
            before, steps = miss(now), []
        steps.append([(a - b) / m if m else 0.0 for a, b, m in zip(now, wanted, natural)])
        now, taken = totals(cells, rate_after(steps, F.col("cell"), F.col("rate"))), taken + 1
    report = {d: {"natural": natural[i], "target": wanted[i], "expected": now[i]} for i, d in enumerate(domains)}
    short = {d: r for d, r in report.items() if abs(r["expected"] - r["target"]) > max(tolerance * size, 1e-9)}
    if short:
        _LOG.warning("targets missed after %d steps: %s", taken, short)
    return cells.select("cell", rate_after(steps, F.col("cell"), F.col("rate")).alias("rate")), report


def mix(
    docs: DataFrame, labels: DataFrame, domain: Column, targets: Mapping[str, float], tokens: float | None = None, per_domain: int = SAMPLE_PER_DOMAIN,
    id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, expected_tokens) for each row of ``docs``.

    Null and empty texts have no tokens and the posterior of the priors. Repeated rows each get their rate. Without any
    labelled row all domains are equally likely. Targets that are missed are logged. An empty table gives an empty result. Extra columns are ignored.
    """
    domains = list(targets)
    priors, weights = fit_classifier(docs, labels, domain, domains, per_domain, id_col, text_col, label_id_col)
    members = write_and_reload(memberships(docs, priors, weights, id_col=id_col, text_col=text_col), "members")
    cells, _ = fit_rates(members, targets, domains, tokens)
    cells = write_and_reload(cells, "cell-rates").select(F.col("cell").alias("of"), "rate")
    posteriors = [(F.get("cell", F.lit(i)) / STEPS).alias(f"p_{d}") for i, d in enumerate(domains)]
    return members.join(cells, F.col("cell") == F.col("of")).select(
        F.col("id").alias("doc_id"), "n_tokens", *posteriors, "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens")
    )
