"""Queries of the read operators over ``read_pair``, ``jobs``, ``primers`` and ``refs``, with their DuckDB SQL.

Operators whose SQL would be a dynamic programme over whole tables have none and are tested against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pairloom.config import PipelineConfig
from pairloom.functions import seq as S
from pairloom.functions.kernels import common_subsequence
from pairloom.operators import collapse as C
from pairloom.operators import overlap as O
from pairloom.operators import primers as P
from pairloom.operators import reference as R
from pairloom.operators.steps import JOB, called, once
from pairloom.plans import oracle as Q
from pairloom.plans import pipelines
from pairloom.sources import files, sinks
from pairloom.staging import shared_dir, spread, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__.rstrip("_")] = f
        if sql:
            SQL[f.__name__.rstrip("_")] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_pair as pairs of the pipelines, bases in upper case."""
    rows = table(spark, sf_dir, "read_pair").select(
        "ordinal", "job_id", F.col("read_name_first").alias("name1"), F.col("readseq_first").alias("seq1"), F.col("quality_first").alias("qual1"),
        F.col("readseq_second").alias("seq2"), F.col("quality_second").alias("qual2"),
    )
    return once(spread(rows), {"seq1": F.upper("seq1"), "seq2": F.upper("seq2")})


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reads of ACGTN with legal qualities of their own length, and their stated primers and barcodes."""
    rows = table(spark, sf_dir, "read_pair").select(
        "ordinal", "job_id", F.col("read_name_first").alias("name"), F.col("readseq_first").alias("seq"), F.col("quality_first").alias("qual"),
        F.col("forward_primer").alias("vprimer"), F.col("reverse_primer").alias("cprimer"), F.col("forward_barcode").alias("fbarcode"), F.col("reverse_barcode").alias("rbarcode"),
    )
    ok = F.col("seq").rlike(r"^[ACGTN]+\z") & F.col("qual").rlike(r"^[!-J]+\z") & (F.length("seq") == F.length("qual"))
    # once: else the filter goes below the spreading of a small table, where one task does all of it
    rows = once(spread(rows), {"seq": F.upper("seq"), "qual": F.col("qual"), "name": F.col("name")})
    return rows.where(ok & F.col("name").isNotNull()).withColumn("title", S.display_name("name"))


_CLEAN = Q.CLEAN
_TITLED = _CLEAN + f", titled AS (SELECT *, {Q.display('name')} AS title FROM clean)"


# scalar functions -------------------------------------------------------------------------------------------------


@query("SELECT ordinal, reverse(translate(upper(readseq_second), 'ACGT', 'TGCA')) AS rc FROM read_pair")
def rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "read_pair").select("ordinal", S.reverse_complement(F.upper("readseq_second")).alias("rc"))


@query("""
WITH k AS (SELECT substr(upper(readseq_first), i, 5) AS kmer FROM read_pair, unnest(range(1, length(readseq_first) - 3)) AS u(i))
SELECT kmer, count(*) AS n FROM k GROUP BY 1""")
def kmers5(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "read_pair").select(F.explode(S.kmers(F.upper("readseq_first"), 5)).alias("kmer"))
    return reads.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH q AS (SELECT ordinal, ascii(substr(quality_first, i, 1)) - 33 AS q FROM read_pair, unnest(range(1, length(quality_first) + 1)) AS u(i)
           WHERE regexp_full_match(quality_first, '[!-J]+'))
SELECT ordinal, CAST(sum(q) // count(*) AS INTEGER) AS mean_quality FROM q GROUP BY 1""")
def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "read_pair").where(F.col("quality_first").rlike(r"^[!-J]+\z"))
    return rows.select("ordinal", S.mean_quality("quality_first").alias("mean_quality"))


@query(f"SELECT ordinal, {Q.display('read_name_first')} AS name FROM read_pair WHERE read_name_first IS NOT NULL")
def name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "read_pair").where("read_name_first is not null").select("ordinal", S.display_name("read_name_first").alias("name"))


#: How the query makes a degenerate primer of a plain one: a barcode of N, and codes at two places.
_DEGENERATE = "concat(repeat('N', barcode_len), left(seq, 4), 'R', substr(seq, 6, 5), 'B', substr(seq, 12))"


@query(f"""
WITH d AS (SELECT primer_id, {_DEGENERATE} AS line, seq FROM primers),
a(x) AS (VALUES ('A'), ('G')), b(y) AS (VALUES ('C'), ('G'), ('T'))
SELECT primer_id, length(line) - length(seq) AS barcode_len, concat(left(seq, 4), x, substr(seq, 6, 5), y, substr(seq, 12)) AS primer FROM d, a, b""")
def iupac_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "primers").select("primer_id", S.split_primer(F.expr(_DEGENERATE)).alias("p"))
    return rows.select("primer_id", "p.barcode_len", F.explode(S.iupac_expand("p.primer")).alias("primer"))


# filters and joins --------------------------------------------------------------------------------------------------


@query("""
SELECT ordinal FROM read_pair p JOIN jobs j USING (job_id)
WHERE least(length(readseq_first), length(readseq_second)) >= greatest(coalesce(forward_offset, 34), coalesce(reverse_offset, 30))
  AND length(readseq_first) = length(quality_first) AND length(readseq_second) = length(quality_second)""")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("job_id", F.coalesce("forward_offset", F.lit(34)).alias("f"), F.coalesce("reverse_offset", F.lit(30)).alias("r"))
    rows = table(spark, sf_dir, "read_pair").join(jobs, "job_id")
    least = F.least(F.length("readseq_first"), F.length("readseq_second")) >= F.greatest("f", "r")
    return rows.where(least & (F.length("readseq_first") == F.length("quality_first")) & (F.length("readseq_second") == F.length("quality_second"))).select("ordinal")


@query("""
SELECT ordinal, upper(substr(a.readseq_first, 3)) AS seq1, substr(a.quality_first, 3) AS qual1, upper(substr(b.readseq_second, 4)) AS seq2, substr(b.quality_second, 4) AS qual2
FROM read_pair a JOIN read_pair b USING (ordinal)""")
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second reads joined by position, adapters of 2 and 3 bases trimmed."""
    both = table(spark, sf_dir, "read_pair")
    one = both.select("ordinal", F.upper("readseq_first").alias("seq1"), F.col("quality_first").alias("qual1"))
    two = both.select("ordinal", F.upper("readseq_second").alias("seq2"), F.col("quality_second").alias("qual2"))
    return O.trim_adapters(one.join(two, "ordinal"), 2, 3)


_LINES = "regexp_full_match(read_name_first, '@[ -~]*[!-~]') AND regexp_full_match(readseq_first, '[!-~]+') AND regexp_full_match(quality_first, '[!-~]+')"


@query(f"SELECT ordinal, read_name_first AS name, readseq_first AS seq, quality_first AS qual FROM read_pair WHERE {_LINES}")
def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reads written as FASTQ, their ordinals in the names, and read from there in small splits."""
    ok = F.col("read_name_first").rlike(r"^@[ -~]*[!-~]\z") & F.col("readseq_first").rlike(r"^[!-~]+\z") & F.col("quality_first").rlike(r"^[!-~]+\z")
    name = F.concat(F.lit("@"), F.col("ordinal").cast("string"), F.lit(" "), "read_name_first")
    path = f"{shared_dir(spark)}/pairloom/fastq-{uuid.uuid4().hex}"
    table(spark, sf_dir, "read_pair").where(ok).select(F.concat_ws("\n", name, "readseq_first", F.lit("+"), "quality_first")).write.text(path)
    rows = files.read_fastq(spark, path, 1 << 20)
    return rows.select(F.regexp_extract("name", "^@([0-9]+)", 1).cast("long").alias("ordinal"), F.regexp_replace("name", "^@[0-9]+ ", "").alias("name"), "seq", "qual")


# overlap ------------------------------------------------------------------------------------------------------------


@query(f"WITH {Q.well_formed()}, {Q.LCS} SELECT ordinal, CAST(coalesce(x, -1) AS INTEGER) AS x, CAST(coalesce(y, -1) AS INTEGER) AS y, CAST(coalesce(len, 0) AS INTEGER) AS len FROM p LEFT JOIN (FROM lcs WHERE dir = 'r') USING (ordinal)")
def lcs_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = called(O.well_formed(pairs(spark, sf_dir)), {"s": O.longest_common_substring(F.col("seq1"), S.reverse_complement("seq2"))})
    return rows.select("ordinal", "s.x", "s.y", "s.len")


@F.pandas_udf(IntegerType())
def _subsequence(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(common_subsequence(x.tolist(), y.tolist()), index=x.index)


@query(f"WITH {_CLEAN} SELECT ordinal, {Q.subsequence('vprimer', 'substr(seq, 15, 20)')} AS lcs FROM clean WHERE vprimer IS NOT NULL")
def lcsubseq_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir).where("vprimer is not null")
    return rows.select("ordinal", _subsequence(F.col("vprimer"), F.substring("seq", 15, 20)).alias("lcs"))


_OVER = f"{Q.well_formed()}, {Q.LCS}, {Q.WINDOW}"


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.window(O.orient(O.well_formed(pairs(spark, sf_dir))))


@query(f"WITH {_OVER} SELECT ordinal, CAST(ref_start AS INTEGER) AS ref_start, CAST(read_start AS INTEGER) AS read_start, CAST(overlap AS INTEGER) AS overlap FROM w")
def overlap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oriented(spark, sf_dir).select("ordinal", "ref_start", "read_start", "overlap")


@query(f"WITH {_OVER} SELECT ordinal, round(100.0 * count_if(b1 = b2) / count(*), 6) AS identity FROM c GROUP BY 1")
def overlap_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oriented(spark, sf_dir).select("ordinal", F.round(O.identity(), 6).alias("identity"))


@query(f"WITH {_OVER}, {Q.merged()} SELECT ordinal, seq, qual FROM g")
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(_oriented(spark, sf_dir), {"m": O.merged_bases()}).where("m is not null")
    return rows.select("ordinal", F.array_join(F.transform("m", lambda v: v["b"]), "").alias("seq"), F.array_join(F.transform("m", lambda v: S.phred_char(v["q"])), "").alias("qual"))


@query(f"WITH {Q.merge()} SELECT ordinal, seq, qual FROM st")
def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stitch(_oriented(spark, sf_dir)).select("ordinal", "seq", "qual")


@query(f"""
WITH {_OVER}, n AS (SELECT x, y, count(*) AS n FROM c GROUP BY ALL), e AS (SELECT *, {Q.ERRORS} FROM n)
SELECT x, y, n, CASE WHEN x = 0 THEN y WHEN y = 0 THEN x ELSE {Q.SAME} END AS same, CASE WHEN x = 0 THEN y WHEN y = 0 THEN x ELSE {Q.OTHER} END AS other FROM e""")
def quality_merge_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of qualities at all positions of all overlaps, and what the merge tables make of them."""
    each = _oriented(spark, sf_dir).withColumn("i", F.explode(S.places("wxq"))).select(S.phred_at("wxq", F.col("i")).alias("x"), S.phred_at("wyq", F.col("i")).alias("y"))
    seen = each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("x", "y", "n", S.match_quality(F.col("x"), F.col("y")).alias("same"), S.mismatch_quality(F.col("x"), F.col("y")).alias("other"))


@query(f"WITH RECURSIVE {_OVER}, {Q.WINDOWS}, {Q.realigned(95)} SELECT * FROM loc")
def sw_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local realignment of overlaps with less than 95 % identity."""
    return O.realign(once(_oriented(spark, sf_dir), {"identity": O.identity()}).where("identity < 95"), PipelineConfig(overlap_identity=95.0)).select("ordinal", "wx", "wy", "wxq", "wyq")


@query(f"WITH RECURSIVE {_OVER}, {Q.WINDOWS}, {Q.realigned(50)}, {Q.REALIGNED}, {Q.merged('lc')}, {Q.STITCHED} SELECT ordinal, seq, qual FROM st")
def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.merge_pairs(pairs(spark, sf_dir), PipelineConfig(local_overlap=True)).select("ordinal", "seq", "qual")


# primers and barcodes -------------------------------------------------------------------------------------------------


_WINDOW = "substr(seq, 15, 20)"


@query("WITH " + _CLEAN + f"""
SELECT ordinal, CAST(min_by(primer_id, (instr({_WINDOW}, p.seq2), primer_id)) AS INTEGER) AS primer_id
FROM clean JOIN (SELECT primer_id, seq AS seq2 FROM primers WHERE primer_role = 'F' AND orient = 'fwd') p ON contains({_WINDOW}, p.seq2) GROUP BY 1""")
def primer_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.load(table(spark, sf_dir, "primers"))
    rows = clean(spark, sf_dir).withColumn("primer_id", P.exact(P.forward_window(found), found.of("F", "fwd")))
    return rows.where("primer_id is not null").select("ordinal", "primer_id")


@query("WITH " + _CLEAN + f""",
i AS (SELECT primer_id, substr(seq, k, 5) AS kmer FROM primers, unnest(range(1, length(seq) - 3)) AS u(k) WHERE primer_role = 'F' AND orient = 'fwd'),
r AS (SELECT ordinal, substr({_WINDOW}, k, 5) AS kmer FROM clean, unnest(range(1, length({_WINDOW}) - 3)) AS u(k)),
v AS (SELECT ordinal, primer_id, count(*) AS votes FROM r JOIN i USING (kmer) GROUP BY ALL)
SELECT ordinal, primer_id, votes FROM v QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY votes DESC, primer_id) = 1""")
def primer_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = table(spark, sf_dir, "primers").where("primer_role = 'F' and orient = 'fwd'")
    return P.votes(clean(spark, sf_dir), options, "ordinal", F.substring("seq", 15, 20))


@query(f"""
WITH {_CLEAN}, {Q.PRIMERS},
cw AS (SELECT ordinal, substr(seq, fmin + 1, foff - fmin) AS w, CASE WHEN length(seq) >= foff THEN substr(seq, length(seq) - foff + 1, foff - fmin) END AS bw FROM clean, pc),
{Q.exact("fe", "cw", "w", "F", "fwd")}, {Q.exact("be", "cw", "bw", "F", "rc")}, lost AS (SELECT ordinal, w FROM cw ANTI JOIN fe USING (ordinal) ANTI JOIN be USING (ordinal)),
{Q.approximate("fa", "lost", "F", "fwd")} SELECT ordinal, primer_id, CAST(lcs AS INTEGER) AS lcs FROM fa WHERE primer_id IS NOT NULL""")
def primer_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole window of each read in which the exact search finds no primer, in either direction."""
    found = P.load(table(spark, sf_dir, "primers"))
    rows = once(clean(spark, sf_dir), {"w": P.forward_window(found), "bw": P.tail_window(found, "F")})
    lost = P.exact(F.col("w"), found.of("F", "fwd")).isNull() & P.exact(F.col("bw"), found.of("F", "rc")).isNull()
    rows = called(once(rows.where(lost), {"w": F.col("w")}), {"a": P.approximate(found.of("F", "fwd"), PipelineConfig())("w")})
    return rows.where("a.primer_id is not null").select("ordinal", "a.primer_id", "a.lcs")


@query("WITH " + _CLEAN + "SELECT ordinal, left(seq, 14) AS fbarcode, right(seq, 12) AS rbarcode FROM clean")
def barcode_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).select("ordinal", F.left("seq", F.lit(14)).alias("fbarcode"), F.right("seq", F.lit(12)).alias("rbarcode"))


@query("WITH " + _CLEAN + """
SELECT ordinal, substr(seq, 35, length(seq) - 34 - 30) AS seq, substr(qual, 35, length(qual) - 34 - 30) AS qual FROM clean
WHERE length(seq) >= 2 * 34 + 30""")
def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir).withColumns({"fbarcode": F.left("seq", F.lit(14)), "rbarcode": F.right("seq", F.lit(12)), "flen": F.lit(20), "rlen": F.lit(18)})
    return P.strip(rows).select("ordinal", "seq", "qual")


@query(f"WITH {Q.PRIMERS}, {Q.merge()}, {Q.annotated()} SELECT ordinal, vprimer, cprimer, fbarcode, rbarcode, seq FROM an")
def primer_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primers and barcodes of merged pairs, approximate search included."""
    merged = O.merge_pairs(pairs(spark, sf_dir)).select("ordinal", "seq", "qual")
    return P.annotate(merged, P.load(table(spark, sf_dir, "primers"))).select("ordinal", "vprimer", "cprimer", "fbarcode", "rbarcode", "seq")


@query("""
SELECT primer_role, max(length(seq) + barcode_len) AS max_offset, min(barcode_len) AS min_barcode FROM primers WHERE orient = 'fwd' GROUP BY 1""")
def primer_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.offsets(table(spark, sf_dir, "primers"))


# reference ------------------------------------------------------------------------------------------------------------


def _insert() -> Column:
    """The read behind a barcode of 14 and a primer of 20 bases."""
    return F.substring(F.col("seq"), F.lit(35), F.length("seq"))


@query(f"WITH {_CLEAN}, {Q.placed('clean', 35)} SELECT ordinal, ref_id, strand, hits FROM placed")
def orient_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference of each first read behind its primer by shared 8-mers, and strand by those of the first 40 bases."""
    return R.placed(clean(spark, sf_dir), R.references(table(spark, sf_dir, "refs")), _insert(), window=PipelineConfig().window).select("ordinal", "ref_id", "strand", "hits")


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = R.references(table(spark, sf_dir, "refs"))
    reads = clean(spark, sf_dir).where(F.length("seq") > 34).withColumns({"seq": _insert(), "qual": F.substring(F.col("qual"), F.lit(35), F.length("qual"))})
    config = PipelineConfig(mode="reference")
    rows = R.turned(R.placed(reads, refs, F.col("seq"), config.kmer, config.window, take=["ref_name", "ref"]))
    back = F.col("strand") == "-"
    # reads end before the reference does: it is cut to what they can reach, turned ones from where they begin
    rows = once(rows, {"at": F.when(back, R.diagonal("seq", "ref", config.kmer)).otherwise(0), "whole": F.length("seq")})
    lead = F.greatest(-F.col("at"), F.lit(0))
    cut = {c: F.substring(F.col(c), lead + 1, F.col("whole")) for c in ("seq", "qual")}
    rows = once(rows, cut | {"ref": F.substring(F.col("ref"), F.greatest("at", F.lit(0)) + 1, F.col("whole") - lead), "ref_start": F.greatest("at", F.lit(0))})
    # the part of a turned read outside the reference counts for the ratio of lengths
    rows = rows.where((F.col("strand") == "+") | (F.col("whole") <= F.length("ref") * config.length_ratio)).drop("at", "whole")
    return R.banded(rows, config)


_BANDED = f"WITH RECURSIVE {_CLEAN}, {Q.READY}, {Q.banded()}"


@query(f"{_BANDED} SELECT ordinal, ref_id, ref_aln, read_aln, matches, mismatches, gaps FROM al")
def banded_nw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banded(spark, sf_dir).select("ordinal", "ref_id", "ref_aln", "read_aln", "matches", "mismatches", "gaps")


@query(f"""
{_BANDED}, r AS (SELECT ordinal, {Q.CIGAR} AS cigar, ops, regexp_extract_all(ops, 'M+') AS runs FROM al)
SELECT ordinal, cigar, CAST(length(replace(replace(ops, 'I', ''), 'D', '')) AS INTEGER) AS m, CAST(length(ops) - length(replace(ops, 'I', '')) AS INTEGER) AS i,
       CAST(length(ops) - length(replace(ops, 'D', '')) AS INTEGER) AS d, CAST(list_max(list_transform(runs, lambda o: length(o))) AS INTEGER) AS longest_m FROM r""")
def cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _banded(spark, sf_dir).select("ordinal", S.cigar("ref_aln", "read_aln").alias("cigar"))
    return rows.select("ordinal", "cigar", R.cigar_counts(F.col("cigar")).alias("c")).select("ordinal", "cigar", "c.*")


@query(f"""
{_BANDED} SELECT 0 AS part, concat('@SQ\tSN:', ref_name, '\tLN:', length(ref)) AS value FROM ref
UNION ALL SELECT 1, concat_ws('\t', title, '0', ref_name, ref_start + 1, '255', {Q.CIGAR}, '*', '0', '0', seq, qual) FROM al""")
def sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sam_lines(R.sam(_banded(spark, sf_dir)), R.references(table(spark, sf_dir, "refs")))


@query(Q.job(f"{_BANDED}, {Q.cells()}, {Q.STATS} SELECT job_id, ref_id, ref_pos, n, round(mu, 5) AS mu, round(sigma, 5) AS sigma, n_a, n_c, n_g, n_t FROM stats"))
def position_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each job, reference and position, from the alignments."""
    return R.position_stats(_banded(spark, sf_dir), [JOB, "ref_id"]).withColumns({"mu": F.round("mu", 5), "sigma": F.round("sigma", 5)})


@query(f"{_BANDED}, {Q.cells()} SELECT ordinal, string_agg(CASE WHEN op = 'M' AND (b = 'N' OR q < 30) THEN r WHEN b = '-' THEN '' ELSE b END, '' ORDER BY pos) AS seq FROM cell GROUP BY 1")
def correct_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.correct_base(_banded(spark, sf_dir)).select("ordinal", "seq")


@query(f"{_BANDED}, {Q.cells()}, {Q.STATS}, {Q.ZSCORE} SELECT ordinal, seq FROM fixed")
def correct_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction within job and reference."""
    return R.correct_zscore(stage(_banded(spark, sf_dir), "aligned"), [JOB, "ref_id"]).select("ordinal", "seq")


# aggregation ----------------------------------------------------------------------------------------------------------


_PRIMED = _TITLED + ", primed AS (SELECT * FROM titled WHERE vprimer IS NOT NULL AND cprimer IS NOT NULL)"
_GOOD = f"{_PRIMED}, {Q.good('primed')}"


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_quality(clean(spark, sf_dir).where("vprimer is not null and cprimer is not null"), 25)


@query(f"WITH {_GOOD}, {Q.collapsed('primed_good', pipelines.KEYS)} SELECT * FROM col")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse(_good(spark, sf_dir), ["vprimer", "cprimer"])


_BARCODED = _PRIMED + ", bar AS (SELECT * FROM primed WHERE fbarcode IS NOT NULL AND rbarcode IS NOT NULL)"
_G = "vprimer, cprimer, fbarcode, rbarcode"


def _barcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).dropna(subset=pipelines.BARCODE_KEYS)


@query("WITH " + _BARCODED + f"""
SELECT {_G}, len, n FROM (SELECT {_G}, length(seq) AS len, count(*) AS n FROM bar GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY n DESC, len DESC) = 1""")
def modal_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.modal_length(_barcoded(spark, sf_dir), pipelines.BARCODE_KEYS)


_CONSENSUS = f"{_BARCODED}, {Q.consensus('cf', 'bar', pipelines.BARCODE_KEYS)}"


@query("WITH " + _CONSENSUS + "SELECT * FROM cf")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consensus(_barcoded(spark, sf_dir), pipelines.BARCODE_KEYS)


@query(f"WITH {_CONSENSUS}, {Q.recollapsed('cf', pipelines.KEYS)} SELECT * FROM again")
def recollapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recollapse(stage(C.consensus(_barcoded(spark, sf_dir), pipelines.BARCODE_KEYS), "consensuses"), pipelines.KEYS)


@query("WITH " + _GOOD + "SELECT vprimer, cprimer, count(*) AS reported FROM primed_good GROUP BY ALL")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads behind all collapsed records: the sum of their counts."""
    made = C.collapse(_good(spark, sf_dir), ["vprimer", "cprimer"])
    return made.groupBy("vprimer", "cprimer").agg(F.sum("dupcount").alias("reported"))


# The queries above take all jobs as one. Each job is a run of its own: those below are the same within jobs.


def _within_jobs(sql: str) -> str:
    """SQL of a query above with the job among its keys; no job is a job as well, in joins too."""
    keyed = sql.replace("vprimer, cprimer", "job_id, vprimer, cprimer").replace("SELECT ordinal, job_id, read_name", "SELECT ordinal, coalesce('=' || job_id, '') AS job_id, read_name")
    return Q.job(keyed)


_JOB_KEYS = [JOB, *pipelines.KEYS]
_JOB_BARCODE_KEYS = [JOB, *pipelines.BARCODE_KEYS]


@query(_within_jobs(SQL["collapse"]))
def collapse_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse(_good(spark, sf_dir), _JOB_KEYS)


@query(_within_jobs(SQL["modal_length"]))
def modal_length_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.modal_length(_barcoded(spark, sf_dir), _JOB_BARCODE_KEYS)


@query(_within_jobs(SQL["consensus"]))
def consensus_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consensus(_barcoded(spark, sf_dir), _JOB_BARCODE_KEYS)


@query(_within_jobs(SQL["recollapse"]))
def recollapse_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recollapse(stage(C.consensus(_barcoded(spark, sf_dir), _JOB_BARCODE_KEYS), "consensuses"), _JOB_KEYS)


@query(_within_jobs(SQL["totals"]))
def totals_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse(_good(spark, sf_dir), _JOB_KEYS).groupBy(*_JOB_KEYS).agg(F.sum("dupcount").alias("reported"))


# pipelines ------------------------------------------------------------------------------------------------------------


def _primers(spark: SparkSession, sf_dir: str) -> P.Primers:
    return P.load(table(spark, sf_dir, "primers"))


_KEYED, _KEYED_BARCODES = [JOB, *pipelines.KEYS], [JOB, *pipelines.BARCODE_KEYS]


@query(Q.job(f"WITH {Q.prepared()}, {Q.collapsed('pt', _KEYED)} SELECT * FROM col"))
def pipeline_referenceless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.referenceless(pairs(spark, sf_dir), _primers(spark, sf_dir))


@query(Q.job(f"WITH {Q.prepared(True)}, {Q.consensus('cf', 'pt', _KEYED_BARCODES)}, {Q.recollapsed('cf', _KEYED, True)} SELECT * FROM again"))
def pipeline_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referenceless with barcode consensus, collapsed again."""
    return pipelines.referenceless(pairs(spark, sf_dir), _primers(spark, sf_dir), PipelineConfig(barcoded=True, dupcount=True, print_barcode=True))


_PREPARED = f"{Q.PRIMERS}, {Q.merge('(SELECT greatest(foff, roff) FROM pc)')}, {Q.annotated()}, {Q.STRIPPED}"
_GUIDED = f"WITH RECURSIVE {_PREPARED}, {Q.GUIDED}, {Q.banded(1.5)}, {Q.good('al')}"


@query(Q.job(f"""
{_GUIDED}, {Q.cells('al_good')}, {Q.STATS}, {Q.ZSCORE},
done AS (SELECT al_good.* REPLACE (fixed.seq AS seq), name || '|VPRIMER=' || vprimer || '|CPRIMER=' || cprimer AS title, {Q.CIGAR} AS cigar FROM al_good JOIN fixed USING (ordinal)),
{Q.collapsed('done', [*_KEYED, 'ref_name', 'cigar'])} SELECT * FROM col"""))
def pipeline_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads here carry a joint behind the part that the reference covers, hence the wider ratio of lengths."""
    config = PipelineConfig(mode="reference", length_ratio=1.5)
    return pipelines.guided(pairs(spark, sf_dir), _primers(spark, sf_dir), R.references(table(spark, sf_dir, "refs")), config)


@query(Q.job(f"""
{_GUIDED}, done AS (SELECT *, name || '|CIGAR=' || {Q.CIGAR} || '|VPRIMER=' || vprimer || '|CPRIMER=' || cprimer AS title, {Q.CIGAR} AS cigar FROM al_good),
{Q.consensus('cf', 'done', _KEYED_BARCODES, extra=['cigar'])} SELECT * FROM cf"""))
def pipeline_reference_barcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference-guided with barcode consensus: groups are of primers and barcodes, whatever their reads' CIGARs."""
    config = PipelineConfig(mode="reference", length_ratio=1.5, barcoded=True)
    return pipelines.guided(pairs(spark, sf_dir), _primers(spark, sf_dir), R.references(table(spark, sf_dir, "refs")), config)


@query(Q.job(f"""
WITH {Q.PRIMERS}, {Q.SIDES}, {Q.merge(src='sides')}
SELECT st.job_id, fbarcode, rbarcode, name1 AS title, ordinal AS first_ordinal, st.seq, st.qual, conscount FROM st JOIN sides USING (ordinal)"""))
def pipeline_barcode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.barcode_first(pairs(spark, sf_dir), _primers(spark, sf_dir))


@query(f"""
SELECT job_id, concat('@', title, '|DUPCOUNT=', dupcount, chr(10), seq, chr(10), '+', chr(10), qual) AS value FROM ({SQL['collapse_by_job']})""")
def output_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of reads collapsed within their job, as FASTQ."""
    return sinks.collapsed(C.collapse(_good(spark, sf_dir), _JOB_KEYS), fastq=True)
