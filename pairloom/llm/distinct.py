"""Problem 6: distinct identifiers by day, group and combination, exactly.

Identifiers are divided by hash into disjoint buckets. Within a bucket each identifier is kept once with each
combination of groups; distinct counts are exact there and, as no identifier is in two buckets, add up. The
deduplicated pairs are the mergeable partial results (their union, deduplicated again, is that of the united data),
and the counts by bucket are partial sums. The error bound is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def pairs(df: DataFrame, identifier: str, groups: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``identifier`` and the group columns, once each: the mergeable partial result. Repeats are removed
    before rows move, so a hot identifier is no burden. A null identifier counts nowhere; a null group is a group."""
    rows = df.select(F.col(identifier).alias("identifier"), *groups).where("identifier is not null").distinct()
    return rows.withColumn("bucket", F.pmod(F.xxhash64("identifier"), F.lit(buckets)).cast("int"))


def merge(*parts: DataFrame) -> DataFrame:
    """The partial result of the united data of several partial results."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def bucket_counts(found: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]], combined: Sequence[str] = ()) -> DataFrame:
    """Exact counts within each bucket: ``level``, the group columns (null where not part of the level), ``combination``,
    ``bucket``, ``n``. A level is a set of group columns, named by them joined with ``+`` (``all`` for none), or, for
    columns in ``combined``, ``combination of`` the column: there each identifier counts once, for all the groups that it
    is in, sorted and joined by commas.

    The deduplicated pairs of a bucket meet in one task, and every level is counted there: no level is shuffled. What
    an identifier gathers is bounded by the number of groups."""
    kinds = {g: found.schema[g].dataType for g in groups}

    def row(level: str, of: dict[str, Column], combination: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), *[of.get(g, F.lit(None)).cast(kinds[g]).alias(g) for g in groups], combination.alias("combination"))

    none = F.lit(None).cast("string")
    def of_set(s: Sequence[str]) -> Column:
        return F.array_distinct(F.transform("of", lambda x: row("+".join(s) or "all", {g: x[g] for g in s}, none)))

    def of_combination(g: str) -> Column:
        names = F.array_sort(F.array_distinct(F.filter(F.transform("of", lambda x: x[g].cast("string")), lambda v: v.isNotNull())))
        return F.filter(F.array(row(f"combination of {g}", {}, F.array_join(names, ","))), lambda x: x["combination"] != "")

    levels = [*map(of_set, sets), *map(of_combination, combined)]
    each = found.repartition("bucket").groupBy("bucket", "identifier").agg(F.collect_set(F.struct(*groups)).alias("of"))
    each = each.select("bucket", F.explode(F.flatten(F.array(*levels))).alias("x")).select("bucket", "x.*")
    return each.groupBy("bucket", "level", *groups, "combination").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, identifier: str, groups: Sequence[str], sets: Sequence[Sequence[str]], buckets: int = BUCKETS, combined: Sequence[str] = ()) -> DataFrame:
    """``level``, the group columns, ``combination`` and ``n_distinct``: the exact number of distinct identifiers of every
    group of every set, and of every combination of groups that identifiers have in common (see :func:`bucket_counts`).
    The number of any union or intersection of groups is a sum of combinations. Null groups are groups, but no part of
    combinations. An empty table gives no rows. Identifiers compare as stored. Other columns are not read."""
    counts = bucket_counts(pairs(df, identifier, groups, buckets), groups, sets, combined)
    return counts.groupBy("level", *groups, "combination").agg(F.sum("n").alias("n_distinct"))
