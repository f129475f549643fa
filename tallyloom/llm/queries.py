"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe_codec, language_id, packing, quality_classifier, quality_rules, secret_scan, simhash, token_counts, topk, warc
from tallyloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_bpe_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query("op1_topk_search", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# base 32 of a SHA-1 in DuckDB: 32 times five bits of its number
OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> (5 * (7 - i % 8))) % 32 AS INTEGER), 1)), 'string_agg', '') AS digest,
    min(page_id) OVER (PARTITION BY body) AS first_id
  FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


@query("op3_warc_archive", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


_FENCES = ", ".join(
    f"max(q{up}) FILTER (figure = '{n}') + {quality_rules.SPREAD} * (max(q{up}) FILTER (figure = '{n}') - max(q{down}) FILTER (figure = '{n}')) AS {n}_high, "
    f"max(q{down}) FILTER (figure = '{n}') - {quality_rules.SPREAD} * (max(q{up}) FILTER (figure = '{n}') - max(q{down}) FILTER (figure = '{n}')) AS {n}_low"
    for n, (up, down) in quality_rules.QUANTILES.items()
)
_RANKS = ", ".join(f"min(bucket) FILTER (below * 100 >= total * {q}) AS q{q}" for q in (25, 75, 99))


def _level(name: str, keys: str) -> str:
    return f"""{name}_c AS (
  SELECT {keys}, figure, bucket, sum(sum(n)) OVER (PARTITION BY {keys}, figure ORDER BY bucket) AS below, sum(sum(n)) OVER (PARTITION BY {keys}, figure) AS total
  FROM sketch GROUP BY {keys}, figure, bucket
), {name}_q AS (
  SELECT {keys}, figure, max(total) AS total, {_RANKS}
  FROM {name}_c GROUP BY {keys}, figure
), {name} AS (SELECT {keys}, max(total) AS total, {_FENCES} FROM {name}_q GROUP BY {keys})"""


def _pick(n: str) -> str:
    return f"CASE WHEN own.total >= {quality_rules.MIN_GROUP} THEN own.{n} WHEN language.total >= {quality_rules.MIN_GROUP} THEN language.{n} ELSE overall.{n} END"


OP5_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), p AS (
  SELECT row_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), g AS (
  SELECT row_no, i, word || ' ' || lead(word, 1) OVER (PARTITION BY row_no ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY row_no ORDER BY i) AS win FROM p
), r AS (
  SELECT row_no, count(DISTINCT j) AS n FROM (
    SELECT row_no, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY row_no, win) AS c FROM g WHERE win IS NOT NULL) WHERE c > 1
  ) GROUP BY row_no
), f AS (
  SELECT w.row_no, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.row_no = r.row_no
), x AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (1000 * n_symbols) // greatest(word_chars, 1) AS symbols, (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines,
    (1000 * n_repeat_words) // greatest(n_words, 1) AS repeats, (100 * word_chars) // greatest(n_words, 1) AS word_length
  FROM f
), v AS (
  SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS figure, unnest([symbols, dup_lines, repeats, word_length]) AS value FROM x WHERE NOT base_failed
), sketch AS (
  SELECT lang, source, 1 AS every, figure, value - value % (CAST(1 AS BIGINT) << CAST(greatest(length(bin(value)) - 8, 0) AS BIGINT)) AS bucket, count(*) AS n FROM v GROUP BY ALL
), {_level("own", "lang, source")}, {_level("language", "lang")}, {_level("overall", "every")}
SELECT x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed,
  NOT x.base_failed AND coalesce({" AND ".join(f"1000 * x.{a} <= {_pick(n + '_high')} * x.{b} + {1000 * quality_rules.SLACK}" for n, (a, b) in quality_rules.SHARES.items())}
    AND x.word_length BETWEEN {_pick("word_length_low")} AND {_pick("word_length_high")}, false) AS kept
FROM x LEFT JOIN own ON x.lang = own.lang AND x.source = own.source LEFT JOIN language ON x.lang = language.lang LEFT JOIN overall ON true
"""


@query("op5_quality_rules", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
