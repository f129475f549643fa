"""Registered queries of the operators on whole corpora and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import merkle, mixing, prefix_trie
from tallyloom.llm.common import table
from tallyloom.llm.queries import query

#: the mix without its schedule: words of the source's stream, repeated, up to the target
OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT *, CAST(list_extract({list(mixing.WEIGHTS)}, CAST(nth % {len(mixing.WEIGHTS)} AS INTEGER) + 1) AS BIGINT) AS weight, {mixing.MOST_REPEATS} * source_size AS most FROM s
), r AS (
  SELECT *, row_number() OVER o AS k, sum(source_size) OVER () - sum(most) OVER o + most AS remaining, sum(weight) OVER () - sum(weight) OVER o + weight AS weighs
  FROM w WINDOW o AS (ORDER BY (6 * source_size) // weight, nth)
), f AS (
  SELECT min(k) AS k, arg_min(remaining, k) AS remaining, arg_min(weighs, k) AS weighs FROM r WHERE remaining * weight <= most * weighs
), t AS (
  SELECT r.source, r.source_size, CASE WHEN r.k >= f.k THEN CAST(r.weight * f.remaining AS DOUBLE) / CAST(f.weighs AS DOUBLE) ELSE CAST(r.most AS DOUBLE) END AS target FROM r, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || chr(31) || CAST(d.size AS VARCHAR)), d.doc_id NULLS FIRST, d.size
      ROWS UNBOUNDED PRECEDING) - d.size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(list_sum(list_transform([0, 1, 2], lambda i: greatest(0, least(i * source_size + ahead + size, words) - i * source_size - ahead))) AS BIGINT) AS taken
FROM p
"""


@query("op11_mixing", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: a number below zero stands for a shift."""
    fed = f"flatten(list_transform(range(length({text})), lambda i: [CAST(ascii(substr({text}, CAST(i AS INTEGER) + 1, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {fed}), lambda c, x: {step}), 4294967295)"


def _leaf(text: str) -> str:
    fields = [text if n == "text" else n for n in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


def _levels(name: str, tree: str, levels: int) -> str:
    """Nodes of each height, and what stands before and after each in its run; name0 has tree, i, node."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k}s AS (
  SELECT {tree}, i, node, count(*) OVER (PARTITION BY {tree}) > 1 AS more,
    coalesce(string_agg(node, '') OVER (PARTITION BY {tree}, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (PARTITION BY {tree}, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k}
), {name}{k + 1} AS (
  SELECT {tree}, i // 16 AS i, CASE WHEN max(more) THEN sha256(string_agg(node, '' ORDER BY i)) ELSE max(node) END AS node FROM {name}{k}s GROUP BY {tree}, i // 16
)""")
    return ", ".join(out)


def merkle_sql(low: int = 5, high: int = 4) -> str:
    """Room for 16^low rows of a source and 16^high sources; heights that are not needed change nothing."""
    steps = [("a", k) for k in range(low)] + [("b", k) for k in range(high)]
    sql = f"""
WITH d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} END AS changed
  FROM documents
), s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth FROM d GROUP BY source
), r AS (
  SELECT doc_id, leaf, changed, nth, row_number() OVER (PARTITION BY nth ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), a0 AS (SELECT nth, i, leaf AS node FROM r), {_levels("a", "nth", low)},
b0 AS (SELECT 1 AS every, nth AS i, node FROM a{low}), {_levels("b", "every", high)},
f0 AS (SELECT doc_id, leaf, nth, i, coalesce(changed, leaf) AS fold, '' AS proof FROM r)"""
    for n, (tree, k) in enumerate(steps):
        at = f"x.nth = f.nth AND x.i = f.i // {16**k}" if tree == "a" else f"x.i = f.nth // {16**k}"
        sql += f""", f{n + 1} AS (
  SELECT f.doc_id, f.leaf, f.nth, f.i, CASE WHEN x.more THEN sha256(x.before || f.fold || x.after) ELSE f.fold END AS fold,
    CASE WHEN x.more THEN f.proof || x.before || x.after ELSE f.proof END AS proof
  FROM f{n} f JOIN {tree}{k}s x ON {at}
)"""
    return sql + f"""
SELECT doc_id, leaf, a{low}.node AS subroot, b{high}.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{high}.node AS verified
FROM f{len(steps)} f JOIN a{low} ON a{low}.nth = f.nth JOIN b{high} ON true
"""


@query("op12_merkle_manifest", merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


#: prefixes as texts of the digests of their turns
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS content, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) - 1 AS nth FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o GROUP BY conv_id
), u AS (
  SELECT c.conv_id, 0 AS part, o.nth, content, bytes FROM c JOIN o ON o.conv_id = c.base AND o.nth < c.h
  UNION ALL SELECT c.conv_id, 1, o.nth, content, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.nth >= c.h
), x AS (
  SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(content, '') OVER w AS path FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), f AS (SELECT conv_id, max(depth) AS depth FROM x GROUP BY conv_id),
n AS (
  SELECT path, any_value(x.depth) AS depth, min(x.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(x.conv_id AS VARCHAR), ',' ORDER BY x.conv_id) FILTER (x.depth = f.depth), '')) AS ends_sha256
  FROM x JOIN f ON x.conv_id = f.conv_id GROUP BY path
), k AS (SELECT left(path, (depth - 1) * 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path),
s AS (
  SELECT left(path, d * 64) AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY 1
)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.path = s.path LEFT JOIN n p ON m.depth > 0 AND p.path = left(m.path, (m.depth - 1) * 64)
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
