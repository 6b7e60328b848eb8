"""Queries of this package over the given tables, and their SQL."""

from pyspark.sql import functions as F

from wardflow.llm import alignment, ann, bytepairs, hilbert, lines, mixing, pieces, quality, repeats, simhash, tokenfiles, toxicity, whitening
from wardflow.llm.stages import share_package


def _table(spark, folder, name):
    share_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark, folder):
    out = quality.document_verdicts(_table(spark, folder, "documents"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op2_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"), n=3, seed=42, radius=3)


def op3_sentencepiece(spark, folder):
    return pieces.encoded_documents(_table(spark, folder, "documents"))


def op4_nearest_neighbours(spark, folder):
    return ann.search(_table(spark, folder, "embeddings"), "id % 100 = 0", 10)


def op5_substring_dedup(spark, folder):
    return repeats.digests(_table(spark, folder, "documents"), window=50)


def op6_token_files(spark, folder):
    return tokenfiles.token_table(_table(spark, folder, "documents"), end_id=0)


def op7_line_dedup(spark, folder):
    return lines.line_verdicts(_table(spark, folder, "documents"))


def op8_toxicity(spark, folder):
    return toxicity.scored_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_soft_mixing(spark, folder):
    return mixing.mixed_rates(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_hilbert_shards(spark, folder):
    return hilbert.document_shards(_table(spark, folder, "documents"), 40)


def op11_byte_pairs(spark, folder):
    return bytepairs.digests(_table(spark, folder, "documents"))


def op12_whitening(spark, folder):
    out = whitening.whiten(_table(spark, folder, "embeddings"), 8)
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_alignment(spark, folder):
    return alignment.align(_table(spark, folder, "documents"))


def pipeline(spark, folder):
    import corpus_pipeline

    share_package(spark)
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules,
    op2_simhash_near_dedup,
    op3_sentencepiece,
    op4_nearest_neighbours,
    op5_substring_dedup,
    op6_token_files,
    op7_line_dedup,
    op8_toxicity,
    op9_soft_mixing,
    op10_hilbert_shards,
    op11_byte_pairs,
    op12_whitening,
    op13_alignment,
    pipeline,
)}

#: Words of the documents, a row each; rid tells repeated rows apart.
_WORDS = r"""docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, string_split_regex(text, '[\x20\x09-\x0D]+') AS ws FROM docs),
loose AS (SELECT rid, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM split),
words AS (SELECT rid, doc_id, w, row_number() OVER (PARTITION BY rid ORDER BY p) AS i FROM loose WHERE w <> '')"""

_QUALITY = rf"""WITH {_WORDS},
three AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM three WHERE w3 IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM seen, (VALUES (0), (1), (2)) AS v(j) WHERE n > 1 GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
repeated AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^ 	-
]') GROUP BY rid),
sizes AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid),
counts AS (SELECT doc_id, source, cast(coalesce(n_words, 0) AS bigint) AS n_words, cast(coalesce(word_chars, 0) AS bigint) AS word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
  cast(coalesce(n_dup_lines, 0) AS bigint) AS n_dup_lines, cast(coalesce(n_repeat_words, 0) AS bigint) AS n_repeat_words
  FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN covered USING (rid)),
rules AS (SELECT source, rule, fails FROM (SELECT source, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeats,
  10 * n_symbols > n_words AS symbols, word_chars > 20 * n_words AS long_words, 10 * n_dup_lines > n_words AS dup_lines FROM counts)
  UNPIVOT (fails FOR rule IN (few_words, repeats, symbols, long_words, dup_lines)) WHERE source IS NOT NULL),
hosts AS (SELECT rule, source, count(*) AS n, cast(count(*) FILTER (WHERE fails) AS double) AS k FROM rules GROUP BY rule, source),
moments AS (SELECT rule, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v FROM hosts GROUP BY rule),
priors AS (SELECT rule, m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 0), 1e6) ELSE 1e6 END AS s FROM moments),
bad AS (SELECT DISTINCT source FROM hosts JOIN priors USING (rule) WHERE (k + m * s) / (n + s) > 0.5),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept FROM judged"""

_REPEATS = rf"""WITH {_WORDS},
windows AS (SELECT rid, doc_id, i, md5(string_agg(w, ' ') OVER o) AS h, count(*) OVER o AS n FROM words
  WINDOW o AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
later AS (SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS gone FROM windows WHERE n = 50),
marked AS (SELECT words.rid, words.i, w, coalesce(max(cast(gone AS int)) OVER (PARTITION BY words.rid ORDER BY words.i
  ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM words LEFT JOIN later USING (rid, i)),
texts AS (SELECT rid, count(*) AS n_words, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY rid)
SELECT doc_id, cast(coalesce(n_words, 0) AS bigint) AS n_words, cast(coalesce(n_removed, 0) AS bigint) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN texts USING (rid)"""

ORACLES = {"op1_quality_rules": _QUALITY, "op5_substring_dedup": _REPEATS}
