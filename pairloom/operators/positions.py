"""Aggregates over the positions of the reads of a group.

Spark has no aggregate over the elements of strings, and a row for each position would be mostly keys. Reads move once,
to the task that a plan of the groups' loads names for them (:mod:`pairloom.operators.skew`); within a task they are
sorted by group and folded, an Arrow batch at a time, into sums by position. Groups too large for one task are split
into shards, whose sums are then folded once more. A task holds one batch and the sums of one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairloom.functions.kernels import padded, strings
from pairloom.operators import skew
from pairloom.staging import stage, tasks

#: Cells of a matrix of reads and positions that are worked on at once.
CELLS = 1 << 18
#: Qualities count from 0 to this; whatever else stands in a quality string counts as the nearest.
MOST = 93


@dataclass(frozen=True)
class Kind:
    """evidence: from characters of reads and of qualities (code matrices) and weights to sums (names x reads x
    positions). verdict: from the sums of groups (names x groups x positions) to characters of each text."""

    names: int
    texts: tuple[str, ...]
    evidence: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    verdict: Callable[[np.ndarray], tuple[np.ndarray, ...]]


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(size):
        widest = np.maximum.accumulate(size[lo : lo + CELLS])
        n = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, "right")))
        yield lo, lo + n
        lo += n


def _parts(b: pa.RecordBatch, kind: Kind) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their lengths and evidence: of reads, or of shards that are sums already."""
    shards = "sums" in b.schema.names
    size = b.column("len").to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in _slices(size):
        part = b.slice(lo, hi - lo)
        if shards:
            cells = np.zeros((kind.names, hi - lo, int(size[lo:hi].max())), np.int64)
            for i, raw in enumerate(part.column("sums").to_pylist()):
                cells[:, i, : size[lo + i]] = np.frombuffer(raw, np.int64).reshape(kind.names, -1)
        else:
            texts = [part.column(c).to_pylist() for c in ("seq", "qual")]
            reads, quals = (padded(t, 33, not all(map(str.isascii, t)))[0] for t in texts)
            cells = kind.evidence(reads, np.clip(quals.astype(np.int64) - 33, 0, MOST), part.column("weight").to_numpy().astype(np.int64))
        yield part, size[lo:hi], cells


def _fold(kind: Kind, heads: Sequence[str], schema: pa.Schema, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray] | None = None  # the group that may go on

        def finished(rows: pa.RecordBatch, size: np.ndarray, counts: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
            split = rows.column(skew.SPLIT).to_numpy(zero_copy_only=False) & (not last)
            made = dict(zip(kind.texts, (strings(c, size) for c in kind.verdict(cells)), strict=True))
            cols = {c: rows.column(c) for c in [skew.SPLIT, "gid", "len", *heads]} | {"n_rows": pa.array(counts[0]), "weight": pa.array(counts[1])}
            cols |= {t: pa.array([None if s else x for s, x in zip(split, made[t], strict=True)], pa.string()) for t in kind.texts}
            cols["sums"] = pa.array([np.ascontiguousarray(cells[:, i, : size[i]]).tobytes() if split[i] else None for i in range(len(size))], pa.binary())
            return pa.RecordBatch.from_arrays([cols[c].cast(schema.field(c).type) for c in schema.names], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            for part, size, cells in _parts(b, kind):
                differ = pc.or_(pc.not_equal(part.column("gid").slice(1), part.column("gid").slice(0, len(size) - 1)), pa.array(size[1:] != size[:-1]))
                starts = np.concatenate([[0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1])
                rows, width = part.take(pa.array(starts)), size[starts]
                own = part.column("n_rows").to_numpy() if "n_rows" in part.schema.names else np.ones(len(size), np.int64)
                counts = np.stack([np.add.reduceat(own, starts), np.add.reduceat(part.column("weight").to_numpy().astype(np.int64), starts)])
                sums = np.add.reduceat(cells, starts, axis=1)
                if held is not None:
                    if held[0].column("gid")[0] == rows.column("gid")[0] and held[1][0] == width[0]:
                        sums[:, 0, : width[0]] += held[3][:, 0, : width[0]]
                        counts[:, 0] += held[2][:, 0]
                        rows = pa.Table.from_batches([held[0], rows.slice(1)]).combine_chunks().to_batches()[0]
                    else:
                        yield finished(*held)
                if len(starts) > 1:
                    yield finished(rows.slice(0, len(starts) - 1), width[:-1], counts[:, :-1], sums[:, :-1])
                held = rows.slice(len(starts) - 1), width[-1:], counts[:, -1:], sums[:, -1:, : width[-1]].copy()
        if held is not None:
            yield finished(*held)

    return fold


def fold(rows: DataFrame, kind: Kind, heads: Mapping[str, T.DataType], order: str = "first_ordinal") -> DataFrame:
    """A row for each ``gid`` and length of ``rows`` (``gid``, ``seq`` and ``qual`` of the same length, ``weight`` and the
    columns ``heads``): ``gid``, ``len``, ``n_rows``, ``weight`` (their sum), the ``heads`` of the first row by ``order``
    (nulls last), and the texts of ``kind``."""
    plan = skew.plan_shards(rows, ["gid"], tasks(rows.sparkSession))
    by = ["gid", "len", F.asc_nulls_last(order)]
    fields = [T.StructField(skew.SPLIT, T.BooleanType()), T.StructField("gid", T.StringType()), T.StructField("len", T.IntegerType()), *[T.StructField(h, t) for h, t in heads.items()]]
    fields += [T.StructField("n_rows", T.LongType()), T.StructField("weight", T.LongType()), *[T.StructField(t, T.StringType()) for t in kind.texts], T.StructField("sums", T.BinaryType())]
    schema = T.StructType(fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    rows = rows.select("gid", F.length("seq").alias("len"), *heads, "seq", "qual", "weight")
    out = skew.placed(rows, ["gid"], order, plan).sortWithinPartitions(*by).mapInArrow(_fold(kind, list(heads), arrow, not plan.splits), schema)
    if plan.splits:  # the shards of a group, no more than there are tasks, meet once more
        out = stage(out, "shards")
        shards = out.where(skew.SPLIT).drop(*kind.texts).repartition("gid").sortWithinPartitions(*by)
        out = out.where(~F.col(skew.SPLIT)).unionByName(shards.mapInArrow(_fold(kind, list(heads), arrow, True), schema))
    return out.drop(skew.SPLIT, "sums")
