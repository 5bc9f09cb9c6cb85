"""One query for each operator of this subpackage, over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, decontam, exact_dedup, langid, line_dedup, lm, minhash, pii, token_output, toxicity
from tallyloom.llm.common import table

OP1_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, pos, line, lkey FROM (
    SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line,
           translate(trim(unnest(ls), E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lkey
    FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), E'\n') AS ls FROM documents))),
hot AS (SELECT lkey FROM lines WHERE lkey <> '' GROUP BY lkey HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (h.lkey IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (h.lkey IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h USING (lkey) GROUP BY rid
"""

OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents")).drop("spans")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), digests_only=True)


def op8_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.katz_scores(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digests(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_toxicity": op2_toxicity, "op3_exact_dedup": op3_exact_dedup, "op4_pii": op4_pii, "op5_language_id": op5_language_id, "op6_minhash": op6_minhash, "op7_bpe": op7_bpe, "op8_katz_lm": op8_katz_lm, "op9_token_output": op9_token_output, "op10_decontamination": op10_decontamination}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_exact_dedup": OP3_SQL}
