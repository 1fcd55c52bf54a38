"""Problem 1: per-key work when a few keys hold most rows.

Fragment-replicate by estimated load. One pass over all rows gives a bounded frequent-items summary of the keys;
from it the driver makes a :class:`ShardPlan`: keys whose load exceeds a share of a task are split into shards in
proportion to their load, shards and slices of the remaining keys are packed to tasks (largest first, to the least
loaded task). Rows are then sent to exactly the task the plan names; a matching side is copied only to the shards
of the keys that were split. The plan steers placement alone: whatever the estimates, results are exact.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.staging import tasks

#: Items that the frequent-items summary tracks at least, for each task, and at most (the function's own limit).
TRACKED, TRACKED_PER_TASK, MOST_TRACKED = 20_000, 16, 1_000_000
#: Keys with at least this share of a task's mean load are placed one by one.
HEAVY_SHARE = 0.25
#: Hash slices of the remaining keys for each task.
SLICES = 8
#: Rows below which one task suffices.
ROWS_PER_TASK = 20_000

KEY, SHARD, BIN, SPLIT = "__key", "__shard", "__bin", "__split"


@dataclass(frozen=True)
class ShardPlan:
    """heavy: for each split or singly placed key its tasks, one for each shard. light: the task of each hash slice."""

    bins: int
    heavy: dict[str, list[int]]
    light: list[int]
    total: int

    @property
    def splits(self) -> bool:
        """Whether any key has several shards."""
        return any(len(places) > 1 for places in self.heavy.values())

    def loads(self, counts: dict[str, int]) -> list[float]:
        """Rows that each task would get if keys had these counts."""
        out = [0.0] * self.bins
        rest = sum(counts.values())
        for k, places in self.heavy.items():
            rest -= counts.get(k, 0)
            for b in places:
                out[b] += counts.get(k, 0) / len(places)
        for b in self.light:
            out[b] += rest / len(self.light)
        return out


def _text_key(df: DataFrame, keys: Sequence[str]) -> Column:
    """One string for a composite key; the length before each part keeps different keys apart."""
    texts = [F.when(F.col(k).isNotNull(), F.hex(k) if isinstance(df.schema[k].dataType, T.BinaryType) else F.col(k).cast("string")) for k in keys]
    return F.concat_ws("|", *[F.concat_ws(":", F.length(t).cast("string"), t) for t in texts])


def _null_key(keys: Sequence[str]) -> Column:
    return functools.reduce(Column.__or__, [F.col(k).isNull() for k in keys])


def pack(loads: dict[str, int], total: int, bins: int) -> ShardPlan:
    """The plan for estimated ``loads`` of the most frequent keys among ``total`` rows."""
    mean = max(1.0, total / bins)
    pieces: list[tuple[float, str, int]] = []
    rest = float(total)
    for k, n in sorted(loads.items()):
        if n >= HEAVY_SHARE * mean:
            shards = max(1, math.ceil(n / (HEAVY_SHARE * mean)) if n > mean else 1)
            pieces += [(n / shards, k, i) for i in range(shards)]
            rest -= n
    slices = bins * SLICES
    pieces += [(max(0.0, rest) / slices, "", i) for i in range(slices)]
    least = [(0.0, b) for b in range(bins)]
    heavy: dict[str, dict[int, int]] = {}
    light = [0] * slices
    for load, k, i in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        at, b = heapq.heappop(least)
        heapq.heappush(least, (at + load, b))
        if k:
            heavy.setdefault(k, {})[i] = b
        else:
            light[i] = b
    return ShardPlan(bins, {k: [v[i] for i in sorted(v)] for k, v in heavy.items()}, light, total)


def plan_shards(df: DataFrame, keys: Sequence[str], bins: int | None = None) -> ShardPlan:
    """Estimate the load of the keys of ``df`` over all its rows and pack them. Rows with a null in a key count as
    rows but not as a key.

    No more than ``bins / HEAVY_SHARE`` keys can have a share that is placed by itself, so that many are asked for, of
    a summary whose error (3.5 / tracked items of all rows) lies below that share; the driver receives no more."""
    key = F.when(_null_key(keys), None).otherwise(_text_key(df, keys))
    most = bins or tasks(df.sparkSession)
    tracked = min(MOST_TRACKED, max(TRACKED, TRACKED_PER_TASK * most))
    found = df.select(key.alias(KEY)).agg(
        F.count(KEY).alias("keyed"),
        F.expr(f"approx_top_k({KEY}, {min(tracked, math.ceil(most / HEAVY_SHARE))}, {tracked})").alias("top"),
    ).head()
    if bins is None:
        bins = max(1, min(most, math.ceil(found["keyed"] / ROWS_PER_TASK)))
    loads = {x["item"]: x["count"] for x in found["top"] if x["item"] is not None}
    return pack(loads, found["keyed"], bins)


def plan_counts(counts: DataFrame, keys: Sequence[str], n: str, total: int, bins: int) -> ShardPlan:
    """The plan from a table of keys with their exact numbers of rows; the driver receives as many as can be heavy."""
    top = counts.select(_text_key(counts, keys).alias(KEY), n).where(F.col(n) >= HEAVY_SHARE * total / bins).orderBy(F.desc(n)).limit(math.ceil(bins / HEAVY_SHARE)).collect()
    return pack({r[KEY]: r[n] for r in top}, total, bins)


def _place(df: DataFrame, keys: Sequence[str], plan: ShardPlan, spread: Column | None) -> DataFrame:
    """Add key text, shard, task and whether the key is split. spread: what chooses among a key's shards; None copies
    rows to every shard.

    The plan's tables are bounded by ``bins / HEAVY_SHARE`` keys and ``bins * SLICES`` slices, whatever the data."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("__places", T.ArrayType(T.IntegerType()))])
    placed = spark.createDataFrame(list(plan.heavy.items()) or [], schema)
    slices = spark.createDataFrame(list(enumerate(plan.light)), "__slot int, __light int")
    out = df.withColumn(KEY, _text_key(df, keys)).join(F.broadcast(placed), KEY, "left")
    out = out.withColumn("__slot", F.pmod(F.xxhash64(KEY), F.lit(len(plan.light))).cast("int")).join(F.broadcast(slices), "__slot")
    light = F.array("__light")
    if spread is not None:  # rows with a null key match nothing, so they are spread instead of sharing one task
        light = F.when(_null_key(keys), F.array(F.pmod(F.xxhash64(spread), F.lit(plan.bins)).cast("int"))).otherwise(light)
    out = out.withColumn("__places", F.coalesce("__places", light)).withColumn(SPLIT, F.size("__places") > 1).drop("__slot", "__light")
    if spread is None:
        return out.select("*", F.posexplode("__places").alias(SHARD, BIN)).drop("__places")
    out = out.withColumn(SHARD, F.pmod(F.xxhash64(spread), F.size("__places")).cast("int"))
    return out.withColumn(BIN, F.element_at("__places", F.col(SHARD) + 1)).drop("__places")


def placed(df: DataFrame, keys: Sequence[str], spread: str, plan: ShardPlan) -> DataFrame:
    """``df`` with every row on the task of its key's shard, and SPLIT: whether the key has several shards. Only the
    groups of split keys have to be merged after work within the tasks."""
    return _place(df, keys, plan, F.col(spread)).repartitionById(plan.bins, BIN).drop(KEY, SHARD, BIN)


def per_key(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, str]], spread: str, plan: ShardPlan | None = None) -> DataFrame:
    """Per-key results with no overloaded task.

    ``aggs``: output name -> (``sum``, ``min`` or ``max``, input column). ``spread``: a column that varies within a
    key, by which large keys are split. Rows with a null key are left out; keys compare as stored. An empty table
    gives no rows. Columns of ``df`` other than those named are not read, so clashing names do no harm.
    """
    plan = plan or plan_shards(df, keys)
    need = list(dict.fromkeys([*keys, spread, *(c for _, c in aggs.values())]))
    rows = _place(df.select(*need).dropna(subset=list(keys)), keys, plan, F.col(spread))
    rows = rows.repartitionById(plan.bins, BIN)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    part = rows.groupBy(BIN, SHARD, *keys).agg(*[fold[f](c).alias(out) for out, (f, c) in aggs.items()])
    return part.groupBy(*keys).agg(*[fold[f](out).alias(out) for out, (f, _) in aggs.items()])


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str, how: str = "inner", plan: ShardPlan | None = None) -> DataFrame:
    """Join on ``keys`` with the large keys of ``left`` split into shards and the matching rows of ``right`` copied to
    those shards only. ``how``: ``inner``, ``left``, ``left_semi`` or ``left_anti``. Null keys match nothing, as in
    SQL; ``left`` and ``left_anti`` keep such rows. Columns of ``right`` other than ``keys`` that are in ``left`` too come
    out with ``_right`` appended, as often as it takes to make them differ.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r} is not supported: rows of the right side are copied")
    taken = {c.lower() for c in [*left.columns, *keys]}
    for c in [c for c in right.columns if c not in keys and c.lower() in taken]:
        new = c
        while new.lower() in taken | {x.lower() for x in right.columns}:
            new += "_right"
        right = right.withColumnRenamed(c, new)
    plan = plan or plan_shards(left, keys)
    a = _place(left, keys, plan, F.col(spread)).repartitionById(plan.bins, BIN)
    b = _place(right.dropna(subset=list(keys)), keys, plan, None).repartitionById(plan.bins, BIN)
    out = a.join(b.drop(KEY, SPLIT), [BIN, SHARD, *keys], how)
    kept = [c for c in left.columns] + ([c for c in right.columns if c not in keys] if how in ("inner", "left") else [])
    return out.select(*kept)


def barcode_keys(reads: DataFrame) -> DataFrame:
    """Rows of each forward barcode, reverse barcode and pair of both: ``key_kind``, the barcodes (``''`` where not
    part of the key), ``n_rows``, ``n_bases`` (bases of the first reads), ``first_ordinal``, ``last_ordinal``.

    Barcodes count as stored (case and blanks matter, ``''`` is a key); a null barcode is no key. Pairs are counted
    first, with map-side combination, so that the rows that move afterwards are pairs of barcodes, not reads.
    """
    from pairloom.staging import stage

    pairs = stage(
        reads.groupBy("forward_barcode", "reverse_barcode").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.coalesce(F.length("readseq_first"), F.lit(0)).cast("long")).alias("n_bases"),
            F.min("ordinal").alias("first_ordinal"),
            F.max("ordinal").alias("last_ordinal"),
        ),
        "barcode_pairs",
    )
    f, r, none = F.col("forward_barcode"), F.col("reverse_barcode"), F.lit("")
    kinds = F.array(
        F.struct(F.lit("forward").alias("key_kind"), f.alias("f"), F.when(f.isNotNull(), none).alias("r")),
        F.struct(F.lit("reverse").alias("key_kind"), F.when(r.isNotNull(), none).alias("f"), r.alias("r")),
        F.struct(F.lit("pair").alias("key_kind"), f.alias("f"), r.alias("r")),
    )
    rows = pairs.withColumn("k", F.explode(kinds)).select(
        "k.key_kind", F.col("k.f").alias("forward_barcode"), F.col("k.r").alias("reverse_barcode"), "n_rows", "n_bases", "first_ordinal", "last_ordinal"
    )
    sums = {c: ("sum", c) for c in ("n_rows", "n_bases")} | {"first_ordinal": ("min", "first_ordinal"), "last_ordinal": ("max", "last_ordinal")}
    return per_key(rows, ["key_kind", "forward_barcode", "reverse_barcode"], sums, "first_ordinal")


def heavy_barcodes(reads: DataFrame, share: float = 0.02) -> DataFrame:
    """Keys of :func:`barcode_keys` that hold at least ``share`` of all rows of ``reads``, those without a key included."""
    total = reads.count()
    return barcode_keys(reads).where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select("key_kind", "forward_barcode", "reverse_barcode")
