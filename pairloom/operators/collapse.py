"""Collapsing equal reads, consensus of barcode groups, and collapsing consensuses again."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import seq as S
from pairloom.operators.positions import Kind, fold

BASES = ("A", "T", "C", "G")
#: Share of one base in a column of a group above which it is taken without comparing likelihoods.
CLEAR = 0.95
#: Log chances are summed as whole numbers of this part of one, so that sums and ties don't depend on the order of rows.
UNIT = 1e-9


def filter_quality(reads: DataFrame, least: int) -> DataFrame:
    """Reads whose integer mean quality is at least that; empty reads are dropped."""
    return reads.where(S.mean_quality("qual") >= least)


def _group_id(keys: Sequence[str]) -> Column:
    """Digest of a group's keys: lengths keep them apart, null is a key like any other."""
    texts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat_ws(":", F.length(t).cast("string"), t), F.lit("-")) for t in texts]))


def _grouped(rows: DataFrame, group: Sequence[str], title: str, order: str, kind: Kind, weight: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Fold ``rows`` by ``group``; the groups' columns, ``title`` and ``extra`` come from the first row by ``order``. Missing
    qualities count as ``!``, and those beyond a read's end don't count; rows without a ``seq`` are left out."""
    cols = [c for c in dict.fromkeys([*group, *extra]) if c != "seq"]
    qual = F.rpad(F.coalesce("qual", F.lit("")), F.length("seq"), "!").alias("qual")
    rows = rows.where("seq is not null").select(*cols, F.col(title).alias("title"), F.col(order).alias("first_ordinal"), "seq", qual, weight.cast("long").alias("weight"), _group_id(group).alias("gid"))
    heads = {c: rows.schema[c].dataType for c in [*cols, "title", "first_ordinal"]}
    return fold(rows, kind, heads)


def _qualities(reads: np.ndarray, quals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the qualities and of the weights; the reads of a group are equal, so any of them is the group's."""
    return np.stack([quals * weights[:, None], np.broadcast_to(weights[:, None], quals.shape), reads * weights[:, None]])


def _mean_quality(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    total = np.maximum(sums[1], 1)
    return (sums[2] // total).astype(np.uint32), (np.rint(sums[0] / total) + 33).astype(np.uint8)


_MEAN = Kind(3, ("seq", "qual"), _qualities, _mean_quality)


def collapse(reads: DataFrame, keys: Sequence[str], title: str = "title", order: str = "ordinal", least: int = 0) -> DataFrame:
    """Equal reads with equal ``keys`` become one: the keys, ``seq``, ``dupcount``, ``title`` of the first read by
    ``order``, and ``qual``, the mean quality of each base, halves to even. Null keys are keys, and empty reads are
    reads; an empty table gives no rows."""
    out = _grouped(reads, [*keys, "seq"], title, order, _MEAN, F.lit(1)).where(F.col("n_rows") >= least)
    return out.select(*keys, "seq", F.col("n_rows").alias("dupcount"), "first_ordinal", "title", "qual")


def modal_length(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``len`` and ``n``: the most frequent length of each group, the larger among equals."""
    counts = reads.groupBy(*keys, F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    # count and length in one number, so that hash aggregation can keep the largest
    best = counts.groupBy(*keys).agg(F.max(F.shiftleft("n", 31) + F.col("len")).alias("m"))
    return best.select(*keys, F.col("m").bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int").alias("len"), F.shiftright("m", 31).alias("n"))


def _log_chances() -> tuple[np.ndarray, np.ndarray]:
    """Log chances, in units, that a base of a quality is right and that it is one given other base; 0 for quality 0."""
    q = np.arange(1, 94)
    right, wrong = np.log10(1 - 10 ** (-q / 10)), np.log10(10 ** (-q / 10) / 3)
    return tuple(np.concatenate([[0], np.rint(v / UNIT)]).astype(np.int64) for v in (right, wrong))


def _evidence(reads: np.ndarray, quals: np.ndarray, weights: np.ndarray) -> np.ndarray:  # noqa: ARG001
    """What reads say about the base at a position: its log chance if the base were another than read, for each base how
    much likelier the read makes it, how often it was read, and how many reads there are."""
    right, wrong = _log_chances()
    gain = right - wrong
    each = [reads == ord(b) for b in BASES]
    return np.stack([wrong[quals], *[np.where(e, gain[quals], 0) for e in each], *each, np.ones_like(quals)])


def _verdict(shortcut: bool):  # noqa: ANN202
    def call(sums: np.ndarray) -> tuple[np.ndarray, ...]:
        log, count, n = sums[0] + sums[1:5], sums[5:9], sums[9]
        share = 10.0 ** ((log - log.max(axis=0)) * UNIT)
        p = np.where(count > 0, share / share.sum(axis=0), -1.0)
        best, most = p.argmax(axis=0), p.max(axis=0)  # the first among equals
        base, chance = np.where(most >= 0, best, 4), np.maximum(most, 0.0)
        if shortcut:
            for i in range(4):
                clear = (count[i] > CLEAR * n) & (n > 0)
                base, chance = np.where(clear, i, base), np.where(clear, 10.0 ** (log[i] / np.maximum(count[i], 1) * UNIT), chance)
        quality = np.floor(-10 * np.log10(np.maximum(S.LEAST_ERROR, 1 - chance)) + 0.5)
        return np.frombuffer("".join([*BASES, "N"]).encode(), np.uint8)[base], (quality + 33).astype(np.uint8)

    return call


def consensus(reads: DataFrame, keys: Sequence[str], title: str = "title", order: str = "ordinal", least: int = 0, shortcut: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """One read for each group of ``keys``: ``seq``, ``qual``, ``conscount`` (reads of the modal length, which alone
    take part) and ``title`` and ``extra`` columns of the group's first read. Rows with a null key are left out; among
    the keys ``job_id`` may be null, which is a group like any other. Reads without bases take no part.

    At each position a base with a share above CLEAR is taken, its chance the geometric mean of its reads'; else the
    base of the greatest posterior.
    """
    rows = reads.dropna(subset=[k for k in keys if k != "job_id"]).where(F.length("seq") > 0)
    kind = Kind(10, ("seq", "qual"), _evidence, _verdict(shortcut))
    lengths = _grouped(rows, keys, title, order, kind, F.lit(1), extra)
    head = F.min(F.struct(F.col("first_ordinal").isNull(), "first_ordinal", "title", *keys, *extra)).alias("h")
    out = lengths.groupBy("gid").agg(F.max(F.struct("n_rows", "len", "seq", "qual")).alias("m"), head).where(F.col("m.n_rows") >= least)
    return out.select(
        *[F.col(f"h.{k}").alias(k) for k in keys], "m.seq", "m.qual", F.col("m.n_rows").alias("conscount"),
        F.col("h.title").alias("title"), F.col("h.first_ordinal").alias("first_ordinal"), *[F.col(f"h.{c}").alias(c) for c in extra],
    )


def recollapse(consensuses: DataFrame, keys: Sequence[str], barcodes: bool = False) -> DataFrame:
    """Equal consensuses with equal ``keys`` become one: ``dupcount`` groups, ``conscount`` reads, ``qual`` the mean
    weighted by reads, ``title`` of the first; with ``barcodes`` their ``forward_reverse`` barcodes joined by commas
    (the output lists all of them, however many)."""
    group = [*keys, "seq"]
    out = _grouped(consensuses, group, "title", "first_ordinal", _MEAN, F.col("conscount"))
    if barcodes:
        names = consensuses.select(_group_id(group).alias("gid"), F.concat_ws("_", "fbarcode", "rbarcode").alias("code"))
        out = out.join(names.groupBy("gid").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("barcodes")), "gid")
    return out.select(*keys, "seq", F.col("n_rows").alias("dupcount"), F.col("weight").alias("conscount"), "title", "first_ordinal", *["barcodes"] * barcodes, "qual")
