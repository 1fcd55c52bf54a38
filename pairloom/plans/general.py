"""Queries of problems 1 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import skew, strictload
from pairloom.staging import table

_READ_COLS = ["ordinal", "forward_barcode", "reverse_barcode", "readseq_first"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_barcodes(table(spark, sf_dir, "read_pair").select(*_READ_COLS))


def p1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.barcode_keys(table(spark, sf_dir, "read_pair").select(*_READ_COLS))


def p1_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each barcode of read_pair with the number of loaded raw lines that carry it: a join whose left side is skewed."""
    reads = table(spark, sf_dir, "read_pair").select("ordinal", "forward_barcode", F.length("readseq_first").alias("bases"))
    raw = strictload.loaded(table(spark, sf_dir, "raw_pairs")).groupBy("forward_barcode").agg(F.count(F.lit(1)).alias("n_raw"))
    rows = skew.fragment_replicate_join(reads, raw, ["forward_barcode"], "ordinal")
    return rows.groupBy("forward_barcode").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bases").alias("n_bases"), F.max("n_raw").alias("n_raw"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strictload.rejected(table(spark, sf_dir, "raw_pairs"))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strictload.loaded(table(spark, sf_dir, "raw_pairs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_keys, p1_matched, p5_found, p5_loaded)}

_KEYS = """
WITH k AS (
  SELECT 'forward' AS key_kind, forward_barcode, '' AS reverse_barcode, ordinal, readseq_first FROM read_pair WHERE forward_barcode IS NOT NULL
  UNION ALL
  SELECT 'reverse', '', reverse_barcode, ordinal, readseq_first FROM read_pair WHERE reverse_barcode IS NOT NULL
  UNION ALL
  SELECT 'pair', forward_barcode, reverse_barcode, ordinal, readseq_first FROM read_pair WHERE forward_barcode IS NOT NULL AND reverse_barcode IS NOT NULL)
SELECT key_kind, forward_barcode, reverse_barcode, count(*) AS n_rows, CAST(sum(coalesce(length(readseq_first), 0)) AS BIGINT) AS n_bases,
       min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal
FROM k GROUP BY ALL"""

_PARSED = r"""
WITH p AS (
  SELECT raw_id, line,
         coalesce(regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*'), true) AS quoted_well,
         regexp_extract_all(line || ',', '(?s)("([^"]|"")*"|[^",]*),', 1) AS raw
  FROM raw_pairs),
f AS (
  SELECT raw_id, quoted_well, coalesce(len(raw), 0) AS n,
         list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS c
  FROM p),
r AS (
  SELECT raw_id, c, CASE
    WHEN NOT quoted_well THEN 'quoting'
    WHEN n <> 11 THEN 'field_count'
    WHEN NOT (regexp_full_match(c[5], '[ACGTNacgtn]+') AND regexp_full_match(c[10], '[ACGTNacgtn]+')) THEN 'seq_chars'
    WHEN NOT (regexp_full_match(c[6], '[!-J]*') AND regexp_full_match(c[11], '[!-J]*')) THEN 'qual_chars'
    WHEN length(c[5]) <> length(c[6]) OR length(c[10]) <> length(c[11]) THEN 'lengths' END AS reason
  FROM f)
"""
_LOADED = ", ".join(f"c[{i + 1}] AS {c}" for i, c in enumerate(strictload.FIELDS))

SQL = {
    "p1_keys": _KEYS,
    "p1_found": f"SELECT key_kind, forward_barcode, reverse_barcode FROM ({_KEYS}) WHERE n_rows >= 0.02 * (SELECT count(*) FROM read_pair)",
    "p1_matched": _PARSED + """, m AS (SELECT c[4] AS forward_barcode, count(*) AS n_raw FROM r WHERE reason IS NULL GROUP BY 1)
SELECT forward_barcode, count(*) AS n_rows, CAST(sum(length(readseq_first)) AS BIGINT) AS n_bases, max(n_raw) AS n_raw
FROM read_pair JOIN m USING (forward_barcode) GROUP BY 1""",
    "p5_found": _PARSED + "SELECT raw_id, reason FROM r WHERE reason IS NOT NULL",
    "p5_loaded": _PARSED + f"SELECT raw_id, {_LOADED} FROM r WHERE reason IS NULL",
}
