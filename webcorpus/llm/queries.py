"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_trie, decontamination, html_extraction, language_id, license_scan, ngram_jaccard, quality_rules, repeated_bytes, sanitisation, sentencepiece_lattice, token_alignment, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitisation.digest(_table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_lattice.read_model(sentencepiece_lattice.default_model())
    encoded = sentencepiece_lattice.encode(_table(spark, sf_dir, "documents"), model, decoded=True)
    return encoded.withColumn("decoded_md5", F.md5("decoded")).drop("decoded")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.digest(_table(spark, sf_dir, "conversations"))


_ALL = (
    op1_sentencepiece,
    op2_ngram_jaccard,
    op3_license_scan,
    op4_html_extraction,
    op5_quality_rules,
    op6_token_counts,
    op7_toxicity,
    op8_benchmark_decontamination,
    op9_suffix_dedup,
    op10_sanitisation,
    op11_token_alignment,
    op12_language_id,
    op13_conversation_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


# Words of every text with their place; the same for lines.
_WORDS = r"""
w AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS pos
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents) t)"""

_QUALITY = rf"""
WITH {_WORDS},
windows AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p
                   || ' ' || lead(word, 4) OVER p AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows WHERE g IS NOT NULL) t WHERE c > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2, 3, 4]) AS pos FROM twice) t GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (SELECT d.doc_id, coalesce(d.source, '') AS host, CAST(coalesce(s.n, 0) AS BIGINT) AS n_words, CAST(coalesce(s.chars, 0) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(coalesce(d.text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
            FROM documents d LEFT JOIN sums s USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS k
          FROM judged GROUP BY host),
prior AS (SELECT sum(k) / sum(n) AS mean, count(*) / sum(n) AS chance FROM hosts),
strength AS (SELECT any_value(mean) AS mean, least(greatest(any_value(mean) * (1 - any_value(mean)) / greatest(
               sum(n * pow(k / n - mean, 2)) / sum(n) - any_value(mean) * (1 - any_value(mean)) * any_value(chance), 1e-9) - 1, 1.0), 1e6) AS s
             FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (k + mean * s) / (n + s) <= 0.5 AS kept, round((k + mean * s) / (n + s), 9) AS shrunk_rate
FROM judged JOIN hosts USING (host), strength"""

_JACCARD = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id, doc_id AS low FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.low = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.low) AS component_id FROM sets s JOIN reached r USING (doc_id) GROUP BY s.doc_id, len(s.s)"""


# crc32 of an id's decimal digits: each byte, then its eight bits.
_TRIE = r"""
WITH given AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
                   lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h
          FROM (SELECT DISTINCT conv_id FROM given) t),
parts AS (SELECT c.conv_id, 0 AS side, g.pos, g.role, g.text FROM convs c JOIN given g ON g.conv_id = c.base WHERE g.pos <= c.h
          UNION ALL SELECT c.conv_id, 1, g.pos, g.role, g.text FROM convs c JOIN given g USING (conv_id) WHERE g.pos > c.h),
paths AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path
          FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY side, pos)
          UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT path, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY path),
links AS (SELECT n.path, p.conv_id AS parent_conv_id, p.path AS up FROM nodes n JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)),
kids AS (SELECT up AS path, count(*) AS n_children FROM links GROUP BY up),
sums AS (SELECT left(n.path, 32 * a.k) AS path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
         FROM nodes n LEFT JOIN kids k USING (path), (SELECT unnest(range((SELECT max(depth) + 1 FROM nodes))) AS k) a WHERE a.k <= n.depth GROUP BY 1),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, path FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) t GROUP BY path)
SELECT n.conv_id, n.depth, l.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN links l USING (path) LEFT JOIN kids k USING (path) LEFT JOIN ends e USING (path)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": _JACCARD, "op5_quality_rules": _QUALITY, "op13_conversation_trie": _TRIE}
