"""Scalar functions on reads, as Column expressions that stay inside the JVM."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: The bases that each IUPAC code stands for, in order of expansion.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
#: Largest quality of a base (``J``), and the least error probability that gives it.
MAX_QUALITY = 41
LEAST_ERROR = 0.000079


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(c: ColumnOrName) -> Column:
    """Complement of upper-case ACGT; other letters stay."""
    return F.translate(_c(c), "ACGT", "TGCA")


def reverse_complement(c: ColumnOrName) -> Column:
    return F.reverse(complement(c))


def base_code(c: ColumnOrName) -> Column:
    """A, C, G, T as 0 to 3; -1 for anything else."""
    return F.coalesce(F.nullif(F.instr(F.lit("ACGT"), _c(c)) - 1, F.lit(-1)), F.lit(-1))


def chars(c: ColumnOrName) -> Column:
    """The characters of a string, as an array (empty for the empty string)."""
    return F.when(_c(c) == "", F.array().cast("array<string>")).otherwise(F.split(_c(c), ""))


def places(c: ColumnOrName) -> Column:
    """The positions of a string, from 1; none for an empty or null string. Exploding them and taking the characters
    one by one is compiled, unlike functions over arrays of characters."""
    return F.when(F.length(_c(c)) > 0, F.sequence(F.lit(1), F.length(_c(c))))


def char_at(c: ColumnOrName, at: Column) -> Column:
    return F.substring(_c(c), at, F.lit(1))


def phred_at(c: ColumnOrName, at: Column) -> Column:
    return F.ascii(char_at(c, at)) - 33


def phred(c: ColumnOrName) -> Column:
    """Qualities of a Phred+33 string, as integers."""
    return F.transform(chars(c), lambda x: F.ascii(x) - 33)


def phred_char(q: Column) -> Column:
    return F.char(q + 33)


def mean_quality(c: ColumnOrName) -> Column:
    """Integer mean quality; null for an empty or null string."""
    total = F.aggregate(phred(c), F.lit(0), lambda acc, q: acc + q)
    return F.when(F.length(_c(c)) > 0, F.floor(total / F.length(_c(c))).cast("int"))


def display_name(c: ColumnOrName) -> Column:
    """The read name up to its first space; of that the fields from the fifth on, with every other character than a
    digit as ``_``, or, if there are none, the name without its first character."""
    head = F.substring_index(_c(c), " ", 1)
    fields = F.split(head, ":")
    tail = F.array_join(F.slice(fields, 5, F.greatest(F.size(fields) - 4, F.lit(1))), ":")
    return F.when(F.length(tail) > 0, F.regexp_replace(tail, "[^0-9]", "_")).otherwise(F.substring(head, F.lit(2), F.length(head)))


def kmers(c: ColumnOrName, k: int) -> Column:
    """All k-mers in order; empty for shorter strings, null for null."""
    s = _c(c)
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, made).when(s.isNotNull(), F.array().cast("array<string>"))


def log_quality(q: Column) -> Column:
    """log10 of the chance that a base of quality q is right; 0 for q = 0."""
    return F.when(q == 0, F.lit(0.0)).otherwise(F.log10(1 - F.pow(F.lit(10.0), -q / 10.0)))


def log_error(q: Column) -> Column:
    """log10 of the chance that it is one given other base; 0 for q = 0."""
    return F.when(q == 0, F.lit(0.0)).otherwise(F.log10(F.pow(F.lit(10.0), -q / 10.0) / 3.0))


def merge_rule(x: int, y: int, same: bool) -> int:
    """Quality of a merged base. Error chances on the scale 10 ** (-q / 12) reproduce the published merge tables; a
    quality of 0 leaves the other one as it is."""
    if x == 0 or y == 0:
        return x or y
    a, b = 10 ** (-max(x, y) / 12), 10 ** (-min(x, y) / 12)
    p = a * b / ((1 - a) * (1 - b) + a * b) if same else a / (a + b - a * b)
    return min(MAX_QUALITY, math.floor(0.5 - 10 * math.log10(p)))


@functools.cache
def _merge_table(same: bool) -> str:
    grid = range(MAX_QUALITY + 1)
    return ",".join(str(merge_rule(x, y, same)) for x in grid for y in grid)


def _merged(x: Column, y: Column, same: bool) -> Column:
    # the optimizer folds the table into one literal array
    table = F.split(F.lit(_merge_table(same)), ",").cast("array<int>")
    return F.get(table, x * (MAX_QUALITY + 1) + y)


def match_quality(x: Column, y: Column) -> Column:
    """Quality (0 to 41) of two equal bases; the other quality where one is 0."""
    return _merged(x, y, True)


def mismatch_quality(x: Column, y: Column) -> Column:
    """Quality (0 to 41) of the better of two different bases; the other quality where one is 0."""
    return _merged(x, y, False)


def probability_quality(p: Column) -> Column:
    """Quality of a base that is right with probability p, at most 41."""
    return F.floor(-10 * F.log10(F.greatest(F.lit(LEAST_ERROR), 1 - p)) + 0.5).cast("int")


def iupac_expand(c: ColumnOrName) -> Column:
    """All concrete sequences of a degenerate one, in order; none if it has an unknown letter."""
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, v)])
    def grow(acc: Column, ch: Column) -> Column:
        return F.flatten(F.transform(acc, lambda p: F.transform(chars(F.coalesce(table[ch], F.lit(""))), lambda b: F.concat(p, b))))

    return F.aggregate(chars(c), F.array(F.lit("")), grow)


def split_primer(c: ColumnOrName) -> Column:
    """barcode_len: letters through the last N; primer: the rest."""
    s = _c(c)
    primer = F.regexp_extract(s, "^(.*N)?([^N]*)$", 2)
    return F.struct((F.length(s) - F.length(primer)).alias("barcode_len"), primer.alias("primer"))


def cigar_ops(c: ColumnOrName) -> Column:
    """Operations of a CIGAR string as structs of ``n`` and ``op``."""
    return F.transform(
        F.regexp_extract_all(_c(c), F.lit("(\\d+[MIDNX])"), 1),
        lambda x: F.struct(F.regexp_extract(x, "^\\d+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")),
    )


def cigar(ref: ColumnOrName, read: ColumnOrName) -> Column:
    """CIGAR of two gapped strings of equal length: equal and substituted bases M, only reference D, only read I."""
    r, q = _c(ref), _c(read)
    ops = F.array_join(F.zip_with(chars(r), chars(q), lambda a, b: F.when(b == "-", "D").when(a == "-", "I").otherwise("M")), "")
    runs = F.transform(F.regexp_extract_all(ops, F.lit("(M+|I+|D+)"), 1), lambda x: F.concat(F.length(x).cast("string"), F.left(x, F.lit(1))))
    whole = F.when(F.length(r) > 0, F.concat(F.length(r).cast("string"), F.lit("M"))).otherwise("")
    return F.when((F.instr(r, "-") == 0) & (F.instr(q, "-") == 0), whole).otherwise(F.array_join(runs, ""))


def register(spark: SparkSession) -> None:
    """Make the commonest functions callable from Spark SQL."""
    for name, args, body in (
        ("reverse_complement", "s STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
        ("phred", "s STRING", "transform(filter(split(s, ''), x -> x <> ''), x -> ascii(x) - 33)"),
        ("mean_quality", "s STRING", "CASE WHEN length(s) > 0 THEN aggregate(filter(split(s, ''), x -> x <> ''), 0, (a, x) -> a + ascii(x) - 33) div length(s) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {'ARRAY<INT>' if name == 'phred' else 'BIGINT' if name == 'mean_quality' else 'STRING'} RETURN {body}")
