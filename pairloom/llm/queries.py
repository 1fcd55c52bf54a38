"""Queries of problems 2, 3, 4, 6, 7, 8 and 9 with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import distinct, formatting, frequent, leakage, paragraphs, spans, survivor, tokens
from pairloom.staging import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.most_frequent(table(spark, sf_dir, "read_pair"), "readseq_first").select("readseq_first")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.most_frequent(table(spark, sf_dir, "read_pair"), "readseq_first").select("readseq_first", "n_rows")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.copies(table(spark, sf_dir, "read_pair"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.groups(table(spark, sf_dir, "read_pair")).select("first_ordinal", "n_copies")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survivor.resolve(table(spark, sf_dir, "read_pair"), table(spark, sf_dir, "feeds"))
    return found.select("first_ordinal", "fbc_ordinal", "rbc_ordinal", "qual_ordinal")


def p4_likeliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose values the feeds' record makes likeliest."""
    return survivor.resolve(table(spark, sf_dir, "read_pair"), table(spark, sf_dir, "feeds"), "posterior")


def p4_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.truths(table(spark, sf_dir, "read_pair")).withColumn("posterior", F.round("posterior", 4))


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survivor.sources(table(spark, sf_dir, "read_pair"))
    return found.withColumns({c: F.round(c, 4) for c in ("sensitivity", "specificity")})


_SETS = [["day", "job_id"], ["day"], ["job_id"], []]


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "read_pair").select(F.col("sequenced_at").cast("date").cast("string").alias("day"), "job_id", "forward_barcode")


def p6_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_counts(_days(spark, sf_dir), "forward_barcode", ["day", "job_id"], _SETS, combined=["job_id"])


def p6_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counts by day and job, from the merged partial results of each feed."""
    rows = table(spark, sf_dir, "read_pair")
    parts = [distinct.pairs(rows.where(c).select("job_id", "forward_barcode"), "forward_barcode", ["job_id"]) for c in ("feed = 'bench'", "feed is null or feed <> 'bench'")]
    return distinct.bucket_counts(distinct.merge(*parts), ["job_id"], [["job_id"]]).groupBy("job_id").agg(F.sum("n").alias("n_distinct"))


def p6_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and jobs that barcodes have in common."""
    found = distinct.distinct_counts(_days(spark, sf_dir), "forward_barcode", ["day", "job_id"], [], combined=["day", "job_id"])
    return found.select("level", "combination", "n_distinct")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), offsets=True)


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("kind = 'verbatim'").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.coverage(table(spark, sf_dir, "documents"))


def p9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicates(table(spark, sf_dir, "documents"))


def p9_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.clusters(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    p2_found, p2_counts, p3_found, p3_groups, p4_found, p4_likeliest, p4_truths, p4_sources, p6_distinct, p6_partials, p6_combinations,
    p7_ids, p7_offsets, p7_round_trip, p8_found, p8_leaks, p9_found, p9_coverage, p9_clusters, p9_paragraphs,
)}

_NORMAL = """
WITH n AS (
  SELECT ordinal, upper(regexp_replace(readseq_first, '[^A-Za-z]', '', 'g')) AS x, upper(regexp_replace(readseq_second, '[^A-Za-z]', '', 'g')) AS y
  FROM read_pair WHERE readseq_first IS NOT NULL AND readseq_second IS NOT NULL),
g AS (SELECT ordinal, least(x, y) AS a, greatest(x, y) AS b FROM n),
f AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY a, b) AS first_ordinal FROM g)
"""

_CLUSTERS = r"""
WITH r AS (
  SELECT p.*, split_part(read_name_first, ' ', 1) AS cluster, coalesce(t.trust, -1) AS trust,
         upper(regexp_replace(forward_barcode, '^\s+|\s+$', '', 'g')) AS fbc, upper(regexp_replace(reverse_barcode, '^\s+|\s+$', '', 'g')) AS rbc,
         length(regexp_replace(readseq_first, '[^A-Za-z]', '', 'g')) AS letters
  FROM read_pair p LEFT JOIN feeds t USING (feed) WHERE job_id IS NOT NULL AND read_name_first IS NOT NULL),
c AS (SELECT job_id, cluster, min(ordinal) AS first_ordinal FROM r GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT r.*, first_ordinal FROM r JOIN c USING (job_id, cluster)),
s AS (
  SELECT first_ordinal, ordinal, trust, received_at,
         CASE WHEN regexp_full_match(fbc, '[ACGTN]{14}') AND fbc <> repeat('N', 14) THEN length(replace(fbc, 'N', '')) END AS f,
         CASE WHEN regexp_full_match(rbc, '[ACGTN]{12}') AND rbc <> repeat('N', 12) THEN length(replace(rbc, 'N', '')) END AS v,
         CASE WHEN regexp_full_match(quality_first, '[!-J]*') AND length(quality_first) = letters THEN letters END AS q
  FROM m),
k AS (
  SELECT first_ordinal,
         first(CASE WHEN f IS NULL THEN -1 ELSE ordinal END) OVER (PARTITION BY first_ordinal ORDER BY f DESC NULLS LAST, trust DESC, received_at DESC NULLS LAST, ordinal DESC) AS fbc_ordinal,
         first(CASE WHEN v IS NULL THEN -1 ELSE ordinal END) OVER (PARTITION BY first_ordinal ORDER BY v DESC NULLS LAST, trust DESC, received_at DESC NULLS LAST, ordinal DESC) AS rbc_ordinal,
         first(CASE WHEN q IS NULL THEN -1 ELSE ordinal END) OVER (PARTITION BY first_ordinal ORDER BY q DESC NULLS LAST, trust DESC, received_at DESC NULLS LAST, ordinal DESC) AS qual_ordinal
  FROM s)
SELECT DISTINCT first_ordinal, fbc_ordinal, rbc_ordinal, qual_ordinal FROM k"""

#: The quality model by recursion: claims, their patterns, and 400 rounds over the patterns' counts.
_MODEL = r"""
WITH RECURSIVE r AS (
  SELECT ordinal, job_id, split_part(read_name_first, ' ', 1) AS cluster, coalesce(feed, '') AS feed, quality_first,
         upper(regexp_replace(forward_barcode, '^\s+|\s+$', '', 'g')) AS forward_barcode, upper(regexp_replace(reverse_barcode, '^\s+|\s+$', '', 'g')) AS reverse_barcode
  FROM read_pair WHERE job_id IS NOT NULL AND read_name_first IS NOT NULL),
m AS (SELECT r.*, min(ordinal) OVER w AS first_ordinal, count(*) OVER w AS size FROM r WINDOW w AS (PARTITION BY job_id, cluster)),
stated AS (
  SELECT first_ordinal, feed, field, value FROM (SELECT first_ordinal, feed, unnest(['forward_barcode', 'reverse_barcode', 'quality_first']) AS field, unnest([forward_barcode, reverse_barcode, quality_first]) AS value FROM m WHERE size > 1)
  WHERE value IS NOT NULL),
said AS (SELECT first_ordinal, field, value, list_sort(list(DISTINCT feed)) AS said FROM stated GROUP BY ALL),
asked AS (SELECT first_ordinal, field, list_sort(list(DISTINCT feed)) AS asked FROM stated GROUP BY ALL),
claims AS (SELECT said.*, list_filter(asked, lambda x: NOT list_contains(said, x)) AS denied FROM said JOIN asked USING (first_ordinal, field)),
pat AS (SELECT field, said, denied, count(*) AS n FROM claims GROUP BY ALL),
votes AS (
  SELECT field, said, denied, n, v.feed AS feed, v.yes AS yes
  FROM (SELECT *, unnest(list_concat(list_transform(said, lambda x: {'feed': x, 'yes': 1.0::DOUBLE}), list_transform(denied, lambda x: {'feed': x, 'yes': 0.0::DOUBLE}))) AS v FROM pat)),
em(i, field, feed, sens, spec) AS (
  SELECT DISTINCT 0, field, feed, 0.8::DOUBLE, 0.8::DOUBLE FROM votes
  UNION ALL
  SELECT any_value(i) + 1, v.field, v.feed, (sum(n * p * yes) + 0.08 * sum(n)) / (sum(n * p) + 0.1 * sum(n)), (sum(n * (1 - p) * (1 - yes)) + 0.08 * sum(n)) / (sum(n * (1 - p)) + 0.1 * sum(n))
  FROM votes v JOIN (
    SELECT any_value(i) AS i, field, said, denied, 1 / (1 + exp(-(ln(1.5) + sum(CASE WHEN yes > 0 THEN ln(sens / (1 - spec)) ELSE ln((1 - sens) / spec) END)))) AS p
    FROM votes JOIN em USING (field, feed) WHERE i < 400 GROUP BY field, said, denied) q USING (field, said, denied)
  GROUP BY v.field, v.feed),
rates AS (SELECT field, feed, sens, spec FROM em WHERE i = 400)
"""

_TOP = "SELECT readseq_first, count(*) AS n_rows FROM read_pair WHERE readseq_first IS NOT NULL GROUP BY 1 ORDER BY n_rows DESC, readseq_first LIMIT 20"

_DAYS = "WITH d AS (SELECT CAST(CAST(sequenced_at AS DATE) AS VARCHAR) AS day, job_id, forward_barcode FROM read_pair WHERE forward_barcode IS NOT NULL)"
_COMBINED = "{name} AS (SELECT forward_barcode, string_agg(DISTINCT {group}, ',' ORDER BY {group}) AS combination FROM d WHERE {group} IS NOT NULL GROUP BY 1)"

_SPANS = "WITH s AS (SELECT doc_id, k, substr(text, k, 300) AS g FROM documents, unnest(range(1, length(text) - 298)) AS u(k) WHERE length(text) >= 300)"

SQL = {
    "p2_counts": _TOP,
    "p2_found": f"SELECT readseq_first FROM ({_TOP})",
    "p3_found": _NORMAL + "SELECT first_ordinal, ordinal FROM f WHERE ordinal <> first_ordinal",
    "p3_groups": _NORMAL + "SELECT first_ordinal, count(*) AS n_copies FROM f GROUP BY 1",
    "p4_found": _CLUSTERS,
    "p4_truths": _MODEL + """,
post AS (
  SELECT field, said, denied, 1 / (1 + exp(-(ln(1.5) + sum(CASE WHEN yes > 0 THEN ln(sens / (1 - spec)) ELSE ln((1 - sens) / spec) END)))) AS p
  FROM votes JOIN rates USING (field, feed) GROUP BY field, said, denied)
SELECT first_ordinal, field, value, round(p, 4) AS posterior FROM claims JOIN post USING (field, said, denied) WHERE p >= 0.5""",
    "p4_sources": _MODEL + "SELECT field, feed, round(sens, 4) AS sensitivity, round(spec, 4) AS specificity FROM rates",
    "p6_distinct": f"""
{_DAYS}, {_COMBINED.format(name="c", group="job_id")}
SELECT 'day+job_id' AS level, day, job_id, NULL AS combination, count(DISTINCT forward_barcode) AS n_distinct FROM d GROUP BY day, job_id
UNION ALL SELECT 'day', day, NULL, NULL, count(DISTINCT forward_barcode) FROM d GROUP BY day
UNION ALL SELECT 'job_id', NULL, job_id, NULL, count(DISTINCT forward_barcode) FROM d GROUP BY job_id
UNION ALL SELECT 'all', NULL, NULL, NULL, count(DISTINCT forward_barcode) FROM d
UNION ALL SELECT 'combination of job_id', NULL, NULL, combination, count(*) FROM c GROUP BY combination""",
    "p6_partials": "SELECT job_id, count(DISTINCT forward_barcode) AS n_distinct FROM read_pair WHERE forward_barcode IS NOT NULL GROUP BY 1",
    "p6_combinations": f"""
{_DAYS}, {_COMBINED.format(name="c", group="job_id")}, {_COMBINED.format(name="e", group="day")}
SELECT 'combination of job_id' AS level, combination, count(*) AS n_distinct FROM c GROUP BY combination
UNION ALL SELECT 'combination of day', combination, count(*) FROM e GROUP BY combination""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(k)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM i, unnest(range(1, len(w) - 11)) AS u(k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_coverage": _SPANS + """,
k AS (SELECT DISTINCT doc_id, k FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1) USING (g)),
m AS (SELECT doc_id, least(300, coalesce(k - lag(k) OVER (PARTITION BY doc_id ORDER BY k), 300)) AS more FROM k)
SELECT doc_id, length(text) AS n_chars, CAST(coalesce(sum(more), 0) AS BIGINT) AS n_shared FROM documents LEFT JOIN m USING (doc_id) WHERE length(text) >= 300 GROUP BY 1, 2""",
    "p9_clusters": _SPANS.replace("WITH", "WITH RECURSIVE", 1) + """,
t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE length(text) >= 300),
e AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM s JOIN t x USING (doc_id) JOIN s o USING (g) JOIN t y ON y.doc_id = o.doc_id WHERE x.class_id <> y.class_id),
reach(a, b) AS (SELECT DISTINCT class_id, class_id FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS class_id, min(b) AS cluster_id FROM reach GROUP BY 1), n AS (SELECT a AS class_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, class_id, cluster_id, coalesce(n_links, 0) AS n_links, doc_id = cluster_id AS kept FROM t JOIN c USING (class_id) LEFT JOIN n USING (class_id)""",
    "p9_paragraphs": r"""
WITH RECURSIVE t AS (SELECT doc_id, string_split_regex(text, '[\r\n]+') AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT doc_id, k - 1 AS place, trim(regexp_replace(lower(parts[k]), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM t, unnest(range(1, len(parts) + 1)) AS u(k)),
q AS (SELECT * FROM p WHERE len(string_split(words, ' ')) >= 5),
s AS (SELECT DISTINCT words, array_to_string(string_split(words, ' ')[k:k + 4], ' ') AS g FROM (SELECT DISTINCT words FROM q), unnest(range(1, len(string_split(words, ' ')) - 3)) AS u(k)),
n AS (SELECT words, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.words AS a, y.words AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.words <> y.words GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n na ON na.words = a JOIN n nb ON nb.words = b WHERE k / (na.n + nb.n - k) >= 0.8),
reach(a, b) AS (SELECT DISTINCT words, words FROM q UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT r.a AS words, min({'d': doc_id, 'p': place}) AS first FROM reach r JOIN q ON q.words = r.b GROUP BY 1),
l AS (SELECT a AS words, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, CAST(place AS INTEGER) AS place, first.d AS class_doc, CAST(first.p AS INTEGER) AS class_place, coalesce(n_links, 0) AS n_links, doc_id = first.d AND place = first.p AS kept
FROM q JOIN c USING (words) LEFT JOIN l USING (words)""",
    "p9_found": """
WITH s AS (SELECT DISTINCT doc_id, substr(text, k, 300) AS g FROM documents, unnest(range(1, length(text) - 298)) AS u(k) WHERE length(text) >= 300)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id""",
}
