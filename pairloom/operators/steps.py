"""Evaluating expressions once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


JOB = "job_id"


def sealed(df: DataFrame) -> DataFrame:
    """The job as a string that is never null, so that joins find the rows without a job as well; without the column,
    the table as it is."""
    return df.withColumn(JOB, F.coalesce(F.concat(F.lit("="), JOB), F.lit(""))) if JOB in df.columns else df


def unsealed(df: DataFrame) -> DataFrame:
    """The job as it was before :func:`sealed`."""
    return df.withColumn(JOB, F.when(F.col(JOB) != "", F.substring(F.col(JOB), F.lit(2), F.length(JOB)))) if JOB in df.columns else df


def once(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that are computed once for a row, whatever refers to them later. A generator of one row
    keeps the optimizer from copying a long expression into every filter and projection above it."""
    kept = [F.col(c) for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))


def called(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Add columns computed by Python functions, once for a row: a filter on one of them would otherwise be moved
    below the projection, and the function run again for it."""
    return once(df.withColumns(dict(cols)), {c: F.col(c) for c in cols})
