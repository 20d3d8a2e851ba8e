"""The manifest's query as SQL: one common table for each level of the trees, up to 16 ** 4 rows a source and 16 ** 2 sources."""

from __future__ import annotations

DOC_LEVELS, SOURCE_LEVELS = 4, 2


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _level(name: str, nodes: str, group: str) -> str:
    """Runs of 16 nodes: their digests end to end, and the digest of the run if the group has several nodes."""
    return f"""{name} AS (SELECT {group}, place // 16 AS pos, string_agg(node, '' ORDER BY place) AS txt, any_value(many) AS many,
    CASE WHEN any_value(many) THEN sha256(string_agg(node, '' ORDER BY place)) ELSE any_value(node) END AS d
    FROM (SELECT {group}, pos AS place, d AS node, count(*) OVER (PARTITION BY {group}) > 1 AS many FROM {nodes}) GROUP BY {group}, place // 16)"""


def _step(name: str, rows: str, level: str, place: str, k: int, same: str) -> str:
    """Rows one level further up: the siblings join the proof, the folded digest takes them in."""
    own = f"CAST({place} // {16 ** (k - 1)} % 16 AS INTEGER)"
    left, right = f"substr(t.txt, 1, 64 * {own})", f"substr(t.txt, 64 * {own} + 65)"
    return f"""{name} AS (SELECT r.* REPLACE (CASE WHEN t.many THEN proof || {left} || {right} ELSE proof END AS proof,
    CASE WHEN t.many THEN sha256({left} || folded || {right}) ELSE folded END AS folded)
    FROM {rows} r JOIN {level} t ON t.pos = {place} // {16 ** k} AND {same})"""


def _sql() -> str:
    head = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        # The table of CRC-32 from its polynomial.
        """c(i, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8)""",
        "crc AS (SELECT list(v ORDER BY i) AS tab FROM c WHERE k = 8)",
        f"""leaves AS (SELECT doc_id, source, sha256({head} || {_field("text")}) AS leaf, sha256({head} || {_field(lowered)}) AS changed,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda x, y: xor(x >> 8, tab[CAST(xor(x, y) & 255 AS INTEGER) + 1])), 4294967295) % 5 = 0 AS altered FROM documents, crc)""",
        """d0 AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)""",
    ]
    parts += [_level(f"d{k}", f"d{k - 1}", "source") for k in range(1, DOC_LEVELS + 1)]
    parts.append(f"s0 AS (SELECT 0 AS one, source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM d{DOC_LEVELS})")
    parts += [_level(f"s{k}", f"s{k - 1}", "one") for k in range(1, SOURCE_LEVELS + 1)]
    parts.append(
        """f0 AS (SELECT d0.doc_id, d0.source, d0.pos, s0.pos AS source_pos, leaf, s0.d AS subroot, '' AS proof, CASE WHEN altered THEN changed ELSE leaf END AS folded
    FROM d0 JOIN s0 ON d0.source IS NOT DISTINCT FROM s0.source)"""
    )
    parts += [_step(f"f{k}", f"f{k - 1}", f"d{k}", "r.pos", k, "r.source IS NOT DISTINCT FROM t.source") for k in range(1, DOC_LEVELS + 1)]
    parts += [
        _step(f"f{DOC_LEVELS + k}", f"f{DOC_LEVELS + k - 1}", f"s{k}", "r.source_pos", k, "TRUE") for k in range(1, SOURCE_LEVELS + 1)
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM f{DOC_LEVELS + SOURCE_LEVELS}, (SELECT d AS root FROM s{SOURCE_LEVELS})"""


SQL = _sql()
