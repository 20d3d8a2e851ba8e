"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for every row.

Rows are numbered in order within their source (range partitions, numbered on from the counts of those before), so the place in
each level of a tree is a digit of that number. The digits are grouped away one after the other: rows of a run become one row
that nests them, runs of a block one row that nests the runs, and the block's digest is a node of the next tier. A block holds at
most ``FAN_OUT ** 2`` nodes, so no row grows with the data, and a tier is one shuffle on (group, block).

Proofs come back down without joins: what a node has above it and the nested block below it meet as two rows of one group, a
transform pairs every nested node with its siblings, and explode emits them as the rows of the next tier down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import write_and_reload

FAN_OUT = 16
#: Bits of a place that one digit takes, and hex letters of a digest.
DIGIT = 4
HEX = 64


def joined_digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``, the place in its group from 0, and ``total``, the size of the group.

    Written once, sorted by range. A group that spans many ranges is numbered on from the row counts of its earlier ranges, one
    small row for each (group, range), so a group with any share of all rows is spread over as many tasks.
    """
    keys = [group, *order]
    placed = rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    stored = write_and_reload(placed.withColumn("mark", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("mark", 33).alias("range_of")
    counts = stored.groupBy(F.col(group).alias("group_of"), part).agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group_of")
    before = F.coalesce(F.sum("n").over(whole.orderBy("range_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("group_of", "range_of", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    same = F.col(group).eqNullSafe(F.col("group_of")) & (F.shiftrightunsigned("mark", 33) == F.col("range_of"))
    return stored.join(starts, same).select(*rows.columns, (F.col("mark") + F.col("shift")).alias("at"), "total")


def _texts(nodes: str) -> Column:
    """The digests of the structs in array ``nodes``, end to end."""
    return F.array_join(F.transform(nodes, lambda n: n["digest"]), "")


def roll_up(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One tier: blocks of two digits, each nesting its runs and their nodes.

    ``nodes``: group, total, at, digest and ``payload``. The last digit is grouped away first: nodes become runs; then the digit
    before it: runs become blocks. A level at which the group has one node left adds no digest.
    """
    dealt = nodes.withColumn("block", F.shiftright("at", 2 * DIGIT)).repartition("group", "block")
    leaf = F.struct("at", "digest", *payload)
    runs = dealt.groupBy("group", "total", "block", F.shiftright("at", DIGIT).alias("run")).agg(F.sort_array(F.collect_list(leaf)).alias("nodes"))
    runs = runs.withColumn("text", _texts("nodes"))
    runs = runs.withColumn("digest", F.when(F.col("total") > 1, F.sha2("text", 256)).otherwise(F.col("text")))
    blocks = runs.groupBy("group", "total", "block").agg(F.sort_array(F.collect_list(F.struct("run", "digest", "text", "nodes"))).alias("runs"))
    blocks = blocks.withColumn("text", _texts("runs"))
    return blocks.withColumn("digest", F.when(F.col("total") > FAN_OUT, F.sha2("text", 256)).otherwise(F.col("text")))


def tiers_of(nodes: DataFrame, payload: list[str], label: str) -> list[DataFrame]:
    """Blocks of every tier, lowest first, each written; the blocks of the last are the roots of their groups."""
    out = []
    while True:
        blocks = write_and_reload(roll_up(nodes, payload), f"{label}-{len(out)}")
        out.append(blocks)
        most = blocks.agg(F.max("total")).first()[0] or 0
        if most <= FAN_OUT**2:
            return out
        of_blocks = F.floor((F.col("total") + FAN_OUT**2 - 1) / FAN_OUT**2).cast("bigint")
        nodes, payload = blocks.select("group", of_blocks.alias("total"), F.col("block").alias("at"), "digest"), []


def _around(text: Column, place: Column, applies: Column) -> Column:
    """The siblings left and right of the digest at ``place`` of ``text``; none where the level does not exist."""
    step = F.struct(
        F.substring(text, F.lit(1), place * HEX).alias("left"), F.substring(text, (place + 1) * HEX + 1, F.length(text)).alias("right")
    )
    return F.when(applies, F.array(step)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def _down(blocks: DataFrame, above: DataFrame, given: list[str], payload: list[str]) -> DataFrame:
    """The nodes of a tier with the siblings on their way up, from its blocks and what is above each block.

    ``above``: group, block, steps and the columns ``given`` from the top. No join: the two rows of a block meet in a group.
    """
    empty = {f.name: f.dataType for f in [*above.schema.fields, *blocks.schema.fields]}
    wide = ["total", "runs", "text", "steps", *given]
    both = blocks.select("group", "block", *[F.col(c) if c in blocks.columns else F.lit(None).cast(empty[c]).alias(c) for c in wide]).unionByName(
        above.select("group", "block", *[F.col(c) if c in above.columns else F.lit(None).cast(empty[c]).alias(c) for c in wide])
    )
    met = both.groupBy("group", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in wide])

    def of_run(run: Column, place: Column) -> Column:
        upper = _around(F.col("text"), place, F.col("total") > FAN_OUT)
        return F.transform(
            run["nodes"],
            lambda node, i: F.struct(
                node["at"].alias("at"), node["digest"].alias("digest"), *[node[c].alias(c) for c in payload],
                F.concat(_around(run["text"], i, F.col("total") > 1), upper).alias("own"),
            ),
        )

    spread = met.select("group", "steps", *given, F.explode(F.flatten(F.transform("runs", of_run))).alias("node"))
    return spread.select("group", *given, "node.at", "node.digest", *[f"node.{c}" for c in payload], F.concat("node.own", "steps").alias("steps"))


def descend(tiers: list[DataFrame], above: DataFrame, given: list[str], payload: list[str]) -> DataFrame:
    """The lowest nodes of ``tiers`` with all steps to the top; ``above`` has one row for each group, its block 0."""
    for k in range(len(tiers) - 1, -1, -1):
        nodes = _down(tiers[k], above, given, payload if k == 0 else [])
        above = nodes.select("group", F.col("at").alias("block"), "steps", *given) if k else nodes
    return above


def fold(digest: Column, steps: Column) -> Column:
    return F.aggregate(steps, digest, lambda node, step: joined_digest(step["left"], node, step["right"]))


def manifest(docs: DataFrame, leaf: Column, source: Column, key: Column, payload: dict[str, Column]) -> DataFrame:
    """Columns of ``payload``, leaf, subroot, root and steps (siblings left and right, level by level) for each row of ``docs``.

    Rows of a source ascend by ``key``, null first, ties by leaf; repeated rows are leaves of their own. Sources ascend bytewise,
    null first. While several nodes are left, each run of 16 becomes the digest of its members' hex texts. An empty table gives an
    empty result. Columns are taken by expression, so extra columns and their names play no part.
    """
    names = list(payload)
    rows = docs.select(source.alias("group"), key.alias("sort_key"), leaf.alias("digest"), *[v.alias(f"p_{n}") for n, v in payload.items()])
    own = [f"p_{n}" for n in names]
    placed = numbered(rows, "group", ["sort_key", "digest"], "leaves")
    of_source = tiers_of(placed.select("group", "total", "at", "digest", *own), own, "blocks")
    subroots = of_source[-1].select(F.lit(0).alias("group"), F.col("group").alias("p_source"), "digest")
    # The group is one row for each source; they are numbered by range like the rows.
    ranked = numbered(subroots, "group", ["p_source"], "sources")
    of_all = tiers_of(ranked, ["p_source"], "source-blocks")
    no_steps = F.array().cast("array<struct<left:string,right:string>>").alias("steps")
    top = of_all[-1].select("group", "block", no_steps, F.col("digest").alias("root"))
    sources = descend(of_all, top, ["root"], ["p_source"])
    above = sources.select(F.col("p_source").alias("group"), F.lit(0).cast("bigint").alias("block"), "steps", "root", F.col("digest").alias("subroot"))
    found = descend(of_source, write_and_reload(above, "above"), ["root", "subroot"], own)
    return found.select(*[F.col(f"p_{n}").alias(n) for n in names], F.col("digest").alias("leaf"), "subroot", "root", "steps")


def verified_manifest(docs: DataFrame, altered: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each with its length. Where ``altered`` holds, A-Z of the text
    are lower-cased after the manifest was made: ``folded_root`` is what the proof then gives, ``verified`` whether it is the root.
    A null text cannot be altered; a null id is a value like any other.
    """
    text = F.col("text").cast("string")

    def leaf(of: Column) -> Column:
        return joined_digest(*[field(F.col(c)) for c in (id_col, "source", "lang", "n_chars")], field(of))

    changed = F.when(altered, leaf(lower_ascii(text))) if altered is not None else F.lit(None).cast("string")
    key = F.col(id_col).cast("bigint")
    found = manifest(docs, leaf(text), F.col("source").cast("string"), key, {"doc_id": key, "changed": changed})
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
