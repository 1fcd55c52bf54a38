"""Problem 3: records that differ only in their writing.

Merkle-style digests from the leaves up: each read is normalised and digested, the two digests are sorted (the
reads' node has no order) and digested again. Records are grouped by root digest, and the full normalised structures of
a group are compared, so equal roots alone never make two records copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import fragment_replicate_join, plan_counts
from pairloom.staging import stage, tasks


def letters(c: str | Column) -> Column:
    """Only the ASCII letters, in upper case; strings of nothing else, the usual case, are not rebuilt."""
    text = F.col(c) if isinstance(c, str) else c
    return F.upper(F.when(text.rlike(r"^[A-Za-z]*\z"), text).otherwise(F.regexp_replace(text, "[^A-Za-z]+", "")))


def leaf(value: Column) -> Column:
    return F.md5(value)


def unordered(digests: list[Column]) -> Column:
    """Digest of a node whose children have no order."""
    return F.md5(F.array_join(F.sort_array(F.array(*digests)), "/"))


def canonical(reads: DataFrame) -> DataFrame:
    """``ordinal``, ``root`` digest and ``whole``, the normalised structure: both reads, the smaller first. Records with a
    null read are left out."""
    rows = reads.select("ordinal", letters("readseq_first").alias("x"), letters("readseq_second").alias("y")).where("x is not null and y is not null")
    whole = F.concat(F.least("x", "y"), F.lit("/"), F.greatest("x", "y"))
    return rows.select("ordinal", F.unhex(unordered([leaf(F.col("x")), leaf(F.col("y"))])).alias("root"), whole.alias("whole"))


def groups(reads: DataFrame) -> DataFrame:
    """One record for each set of copies: ``first_ordinal``, ``n_copies`` (1 or more), ``root`` and ``whole``.

    Copies have the same two reads, in either order, when only ASCII letters count, in either case; reads without
    letters are equal to each other. Copies are combined before rows move, so a group of a third of all rows is no
    burden. Empty tables give no rows; columns other than the two reads and ``ordinal`` are not read.
    """
    return canonical(reads).groupBy("root", "whole").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n_copies"))


def copies(reads: DataFrame) -> DataFrame:
    """``first_ordinal``, ``ordinal``: a row for each copy but the first of its group (see :func:`groups`).

    Records are normalised and digested once, into a table. Roots are counted from the digests alone; only structures
    under a root that occurs twice or more are kept, by a join that splits roots too frequent for one task and is
    planned from the exact counts. The structures of a root are then compared whole: those that are the same are
    copies, whatever their digests."""
    rows = stage(canonical(reads), "canonical")
    roots = stage(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "roots")
    bins = tasks(reads.sparkSession)
    alike = fragment_replicate_join(rows, roots.select("root"), ["root"], "ordinal", "left_semi", plan_counts(roots, ["root"], "n", rows.count(), bins))
    alike = stage(alike, "alike")
    firsts = alike.groupBy("root", "whole").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stage(firsts, "firsts")
    plan = plan_counts(firsts, ["root"], "n", alike.count(), bins)
    found = fragment_replicate_join(alike, firsts.select("root", F.col("whole").alias("same"), "first_ordinal"), ["root"], "ordinal", "inner", plan)
    return found.where("whole = same and ordinal <> first_ordinal").select("first_ordinal", "ordinal")
