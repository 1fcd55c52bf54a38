"""Problem 2: the most frequent values of a column, in bounded memory.

A count sketch with signed hashes is kept for every prefix length (8, 16, ... 64 bits) of the values' 64-bit hashes.
Each task folds its rows into one sketch of fixed size, sketches add up, and the driver descends from heavy
prefixes to heavy hashes. A second scan counts the values with those hashes exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits by which prefixes grow from level to level; hashes have 64 bits.
STEP = 8
LEVELS = 64 // STEP
ROWS = 5
WIDTH = 1 << 12
#: Widest sketch (42 MB); data whose top values don't stand out even there are counted exactly instead.
MAX_WIDTH = 1 << 17
#: Standard errors of an estimate that the descent allows for.
ERRORS = 4.0
#: Prefixes of a level that a descent goes on from at most, which bounds what the driver holds; a threshold that more
#: prefixes reach is too low for this sketch.
KEPT = 1 << 14


def _cells(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of hash prefixes in one row of one level."""
    with np.errstate(over="ignore"):
        x = (prefix + np.uint64(0x9E3779B97F4A7C15 * (level * ROWS + row + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return (x & np.uint64(width - 1)).astype(np.int64), 1 - 2 * ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def _prefixes(h: np.ndarray, level: int) -> np.ndarray:
    return h >> np.uint64(64 - STEP * (level + 1))


def _fold(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((LEVELS, ROWS, width), np.int64)
        for b in batches:
            h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            for level in range(LEVELS):
                for row in range(ROWS):
                    at, sign = _cells(_prefixes(h, level), level, row, width)
                    sums[level, row] += np.bincount(at, sign * n, width).astype(np.int64)
        flat = sums.ravel()
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "n"])

    return fold


def sketch(hashes: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The sketch (levels x rows x width) of a column of 64-bit hashes. The driver receives its cells, not the data."""
    cells = hashes.mapInArrow(_fold(width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(LEVELS * ROWS * width, np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return out.reshape(LEVELS, ROWS, width)


def estimates(s: np.ndarray, prefix: np.ndarray, level: int) -> np.ndarray:
    """Approximate counts of hash prefixes: medians over the sketch's rows."""
    each = []
    for row in range(ROWS):
        at, sign = _cells(prefix, level, row, s.shape[2])
        each.append(s[level, row][at] * sign)
    return np.median(np.array(each), axis=0)


def error(s: np.ndarray, level: int) -> float:
    """Allowance for the error of one estimate: the sketch's standard error, from its second moment."""
    return ERRORS * float(np.sqrt(np.median((s[level].astype(float) ** 2).sum(axis=1)) / s.shape[2]) / np.sqrt(ROWS / 1.57))


def descend(s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashes, with estimates, of all values that occur ``least`` times or more (up to the sketch's error); None if more
    than KEPT prefixes of a level do."""
    prefix = np.arange(1 << STEP, dtype=np.uint64)
    for level in range(LEVELS):
        if level:
            prefix = ((prefix << np.uint64(STEP))[:, None] | np.arange(1 << STEP, dtype=np.uint64)[None, :]).ravel()
        est = estimates(s, prefix, level)
        keep = est >= max(0.5, least - error(s, level))
        prefix, est = prefix[keep], est[keep]
        if len(prefix) > KEPT:
            return None
    return prefix, est


def without(s: np.ndarray, known: dict[int, int]) -> np.ndarray:
    """The sketch of the rows but those of hashes whose counts are known."""
    out = s.copy()
    h, n = np.array(list(known), np.uint64), np.array(list(known.values()), np.int64)
    for level in range(LEVELS):
        for row in range(ROWS):
            at, sign = _cells(_prefixes(h, level), level, row, s.shape[2])
            np.subtract.at(out[level, row], at, sign * n)
    return out


def _heavy(s: np.ndarray, known: dict[int, int], k: int) -> tuple[dict[int, float], bool]:
    """Hashes that stand out from a sketch without the known ones, with estimates, and whether these and the known ones
    certainly hold the ``k`` most frequent. The threshold starts at 1/k of what the largest count can be and is halved
    until ``k`` hashes certainly exceed it, or it sinks to the sketch's error, below which a descent would keep everything."""
    err = max(error(s, level) for level in range(LEVELS))
    most = max([float(np.sqrt(np.median((s[0].astype(float) ** 2).sum(axis=1))) + 1), *known.values()])
    least, out = max(most / k, 2 * err), {}
    while (got := descend(s, least)) is not None:
        out = dict(zip(got[0].tolist(), got[1].tolist(), strict=True))
        sure = int((got[1] - err >= least).sum()) + sum(n >= least for n in known.values())
        if sure >= k or least < 1:
            return out, True
        if least / 2 < 2 * err:
            break
        least /= 2
    return out, False


def most_frequent(df: DataFrame, column: str, k: int = 20, width: int = WIDTH) -> DataFrame:
    """The ``k`` most frequent non-null values of ``column``: the value, ``n_rows`` (exact, from the second scan) and
    ``estimate`` (the sketch's, or the exact count where that was needed to see others). Ties go to the smaller value. Values compare as stored; nulls are no value, ``''``
    is one. Fewer than ``k`` distinct values give as many rows; an empty table none. Other columns are not read.

    Where ``k`` values don't stand out, those that do are counted in a scan and taken out of the sketch, whose error they
    make; where that doesn't help, the sketch is made four times as wide, up to MAX_WIDTH. Should not even that tell the
    top values from the rest, as when all are about as frequent, the values are counted exactly by a (spilling)
    aggregation: memory stays bounded and the result whole, at the price of a shuffle of all distinct values.
    """
    spark = df.sparkSession
    values = df.select(F.col(column).alias("value")).where("value is not null").withColumn("h", F.xxhash64("value"))
    known: dict[int, int] = {}

    def among(hashes: dict[int, float]) -> DataFrame:
        rows = [(int(np.uint64(h).astype(np.int64)), float(e)) for h, e in hashes.items()]
        return values.join(F.broadcast(spark.createDataFrame(rows, "h long, estimate double")), "h")

    counted, s = None, sketch(values.select("h"), width)
    while counted is None:
        found, enough = _heavy(without(s, known), known, k)
        if enough:
            counted = among(known | found).groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"), F.max("estimate").alias("estimate"))
        elif len(found.keys() - known.keys()) > 0 and max(found.values()) > 2 * error(without(s, known), 0):
            fresh = {h: e for h, e in found.items() if h not in known}
            known |= {int(np.int64(r["h"]).astype(np.uint64)): r["n"] for r in among(fresh).groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect()}
        elif width < MAX_WIDTH:
            width = min(4 * width, MAX_WIDTH)
            s = sketch(values.select("h"), width)
        else:
            counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("estimate", F.col("n_rows").cast("double"))
    top = counted.orderBy(F.desc("n_rows"), "value").limit(k)
    return top.withColumnRenamed("value", column)
