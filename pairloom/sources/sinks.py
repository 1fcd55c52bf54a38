"""Records as text lines, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _record(head: Column, fastq: bool, compat: bool) -> Column:
    """One text value with the lines of a record. FASTQ headers begin with ``@``, with ``compat`` with ``>``."""
    mark = F.lit("@" if fastq and not compat else ">")
    lines = [F.concat(mark, head), F.col("seq")] + ([F.lit("+"), F.col("qual")] if fastq else [])
    return F.concat_ws("\n", *lines)


def title(barcode: bool = False) -> Column:
    """Display name with primers, and with the barcodes if asked."""
    return F.concat(F.col("name"), title_tail(barcode))


def title_tail(barcode: bool = False) -> Column:
    """What follows the name in a title."""
    parts = [F.lit("|VPRIMER="), F.col("vprimer"), F.lit("|CPRIMER="), F.col("cprimer")]
    if barcode:
        parts += [F.lit("|BARCODE="), F.col("fbarcode"), F.lit("/"), F.col("rbarcode")]
    return F.concat(*parts)


def _job(rows: DataFrame) -> list[str]:
    """Each job has its own output: its records carry it."""
    return [c for c in ("job_id",) if c in rows.columns]


def collapsed(rows: DataFrame, fastq: bool = False, compat: bool = False) -> DataFrame:
    head = F.concat("title", F.lit("|DUPCOUNT="), F.col("dupcount").cast("string"))
    if "cigar" in rows.columns:
        head = F.concat(head, F.lit("|CIGAR="), "cigar")
    return rows.orderBy("first_ordinal").select(*_job(rows), _record(head, fastq, compat).alias("value"))


def consensus(rows: DataFrame, fastq: bool = False, compat: bool = False) -> DataFrame:
    head = F.concat("title", F.lit("|CONSCOUNT="), F.col("conscount").cast("string"))
    return rows.orderBy("first_ordinal").select(*_job(rows), _record(head, fastq, compat).alias("value"))


def recollapsed(rows: DataFrame, fastq: bool = False) -> DataFrame:
    head = F.concat("title", F.lit("|DUPCOUNT="), F.col("dupcount").cast("string"), F.lit("|CONSCOUNT="), F.col("conscount").cast("string"))
    return rows.orderBy("first_ordinal").select(*_job(rows), _record(head, fastq, False).alias("value"))


def barcode_first(rows: DataFrame) -> DataFrame:
    head = F.concat("title", F.lit("|BARCODE="), "fbarcode", F.lit("_"), "rbarcode", F.lit("|CONSCOUNT="), F.col("conscount").cast("string"))
    return rows.orderBy("first_ordinal").select(*_job(rows), _record(head, True, True).alias("value"))


def sam_lines(records: DataFrame, refs: DataFrame) -> DataFrame:
    """``@SQ`` lines of the references, then the records; ``part`` orders them."""
    head = refs.select(F.lit(0).alias("part"), F.concat(F.lit("@SQ\tSN:"), "ref_name", F.lit("\tLN:"), F.length("ref").cast("string")).alias("value"))
    return head.unionByName(records.select(F.lit(1).alias("part"), F.concat_ws("\t", *[F.col(c).cast("string") for c in records.columns]).alias("value")))


def with_references(lines: DataFrame, refs: DataFrame, fastq: bool = False, compat: bool = False) -> DataFrame:
    """The references' records before all others."""
    head = refs.select(F.lit(0).alias("part"), _record(F.col("title"), fastq, compat).alias("value"))
    return head.unionByName(lines.select(F.lit(1).alias("part"), "value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text files, in order of the parts' names; an existing folder is replaced."""
    lines.select("value").write.mode("overwrite").text(path)
