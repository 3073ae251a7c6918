"""SQL of the manifest and the secret scan, put together level by level and rule by rule."""

from __future__ import annotations

from sitewise.llm.secret_scan import BASE, RULES


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 bit by bit over the digits of the id.
_CRC = """xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _tree(a: str, levels: int) -> str:
    """From nodes {a}0 (g, i, n, h): levels {a}1.., and {a}s0.. with each node's siblings."""
    out = []
    for k in range(levels):
        out.append(f"""{a}{k + 1} AS (
    SELECT g, i // 16 AS i, (max(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {a}{k} WHERE n > 1 GROUP BY g, i // 16
    UNION ALL SELECT g, i, n, h FROM {a}{k} WHERE n = 1
), {a}s{k} AS (
    SELECT g, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {a}{k} WHERE n > 1
)""")
    return ",\n".join(out)


def _climb(a: str, levels: int, start: str, name: str) -> str:
    """Rows of ``start`` (g, i, proof, seen) taken up the tree of {a}; the last table is ``name``."""
    out, before = [], start
    for k in range(levels):
        after = name if k == levels - 1 else f"{name}{k}"
        out.append(f"""{after} AS (
    SELECT p.* EXCLUDE (i, proof, seen), p.i // CASE WHEN s.g IS NULL THEN 1 ELSE 16 END AS i, proof || coalesce(s.l || s.r, '') AS proof,
           CASE WHEN s.g IS NULL THEN seen ELSE sha256(s.l || seen || s.r) END AS seen
    FROM {before} p LEFT JOIN {a}s{k} s ON p.g = s.g AND p.i = s.i
)""")
        before = after
    return ",\n".join(out)


#: Five levels over the rows of a source (a million rows), four over the sources.
MANIFEST = f"""
WITH f AS (
    SELECT *, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS g, doc_id IS NOT NULL AND {_CRC} % 5 = 0 AS bad FROM documents
), leaves AS (
    SELECT doc_id, g,
           sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
           CASE WHEN bad THEN sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', _LOWER)))}) END AS changed
    FROM f
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n,
           '' AS proof, coalesce(changed, leaf) AS seen
    FROM leaves
), a0 AS (SELECT g, i, n, leaf AS h FROM ranked), {_tree('a', 5)},
tops AS (SELECT g AS source_key, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM a5),
b0 AS (SELECT 0 AS g, i, n, h FROM tops), {_tree('b', 4)},
{_climb('a', 5, 'ranked', 'sourced')},
met AS (
    SELECT s.doc_id, s.leaf, t.h AS subroot, s.proof, s.seen, 0 AS g, t.i FROM sourced s JOIN tops t ON s.g = t.source_key
), {_climb('b', 4, 'met', 'done')}
SELECT doc_id, leaf, subroot, (SELECT h FROM b4) AS root, sha256(proof) AS proof_sha256, seen AS folded_root,
       seen = (SELECT h FROM b4) AS verified
FROM done
"""


def _matches(k: int) -> str:
    rule = RULES[k]
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern.replace("'", "''")
    long_enough = f"length(regexp_extract(x, '{pattern}', {rule.group})) >= {rule.least}"
    return f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, string_split_regex(t, '{pattern}') AS gaps, found,
           [{long_enough} FOR x IN found] AS kept
    FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS found FROM d) WHERE len(found) > 0"""


_KINDS = ", ".join(f"'{r.kind}'" for r in BASE)
#: A match begins behind all matches before it and the gaps between them.
SECRETS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
m AS (
    {' UNION ALL '.join(_matches(k) for k in range(len(RULES)))}
), spans AS (
    SELECT r, k, kind, kept[i] AS kept, length(found[i]) AS size,
           list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN found[1:i - 1]]), 0) AS begin
    FROM m, unnest(range(1, len(found) + 1)) u(i)
), told AS (
    SELECT r, k, kind, begin, kind || ':' || CAST(begin AS BIGINT) || ':' || CAST(begin + size AS BIGINT) AS span FROM spans WHERE kept
), per_text AS (
    SELECT r, {', '.join(f"count(*) FILTER (kind = '{b.kind}') AS n_{b.kind}" for b in BASE)},
           string_agg(span, ',' ORDER BY begin, k) FILTER (kind IN ({_KINDS})) AS base, string_agg(span, ',' ORDER BY begin, k) AS spans
    FROM told GROUP BY r
)
SELECT doc_id, {', '.join(f'coalesce(n_{b.kind}, 0) AS n_{b.kind}' for b in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_text USING (r)
"""
