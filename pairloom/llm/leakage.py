"""Problem 8: evaluation passages inside training text.

Latent semantic retrieval. Words are weighted by their inverse document frequency over the whole corpus; the TF-IDF
passages of the evaluation items span a latent space found by randomised SVD; every document is cut into overlapping
windows of words, the windows are projected, and a window is a candidate for a passage if their product can hold what
a run of RUN shared words contributes at least. That bound (and an allowance for what the space leaves out) makes the
search complete: no document with such a run is missed. Candidates are then compared word by word: longest common run,
longest common subsequence, and whether the item's answer follows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive shared words that make a leak.
RUN = 13
#: Passages longer than PIECE words are cut into pieces that overlap by RUN - 1 words.
PIECE = 40
#: Items taken at a time; what is broadcast is bounded by BLOCK items, PIECES pieces and RANK dimensions.
BLOCK, PIECES, RANK = 512, 1024, 1024
#: A window with at least this cosine (less for pieces longer than a window, by the root of the share it holds), and a common subsequence of this share of the passage, counts as a paraphrase.
COSINE, SUBSEQUENCE = 0.6, 0.6
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of Unicode letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Space:
    """A block of items in latent space. products: for each vocabulary word (and a zero row for all others) the product of
    its vector with each piece's, so that a window's products are sums of rows; lengths: words of the whole passages,
    least: the product with a window that a shared run reaches at least."""

    vocabulary: dict[str, int]
    pieces: list[list[int]]
    items: list[int]
    lengths: list[int]
    answers: list[list[str]]
    products: np.ndarray
    norms2: np.ndarray
    sizes: np.ndarray
    residual: np.ndarray
    least: np.ndarray


def _pieces(ids: list[str]) -> list[list[str]]:
    step = PIECE - RUN + 1
    return [ids[i : i + PIECE] for i in range(0, max(1, len(ids) - RUN + 1), step)]


def _frequency(vocabulary: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = vocabulary.keys(), Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                seen.update(known & set(words(x)))
                seen[""] += 1
        ids = [vocabulary.get(w, -1) for w in seen]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return count


def document_frequency(docs: DataFrame, vocabulary: dict[str, int], text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each vocabulary word, and all documents; counted over the whole corpus."""
    counts = docs.select(text).mapInArrow(_frequency(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(len(vocabulary)), 0
    for word, n in counts:
        if word < 0:
            total = n
        else:
            df[word] = n
    return df, total


def _dense(piece: list[int], idf: np.ndarray) -> np.ndarray:
    return np.bincount(piece, minlength=len(idf)) * idf


def randomised_svd(spark, pieces: list[list[int]], idf: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:  # noqa: ANN001
    """Orthonormal basis (words x rank) of the leading right singular vectors of the pieces' TF-IDF matrix. Rows are
    spread over tasks; only products with the random matrix and with the found range come back, as rows of the words
    that occur (at most PIECES x PIECE of them, of ``rank`` numbers of four bytes)."""
    k = min(rank, len(pieces), len(idf))
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "row int, ids array<int>").repartition(max(1, min(8, len(pieces) // 64)), "row")

    def sums(matrix: np.ndarray, transposed: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(matrix)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
                a = np.array([_dense(p, idf) for p in ids])
                # of the transposed product only the rows of the words that these pieces have
                rows = np.unique(np.concatenate([np.array(p) for p in ids])) if transposed else at
                out = a[:, rows].T @ shared.value[at] if transposed else a @ shared.value
                flat = pa.array(out.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1], flat)], ["row", "v"])

        got = rows.mapInArrow(part, "row int, v array<float>").toArrow()
        total = np.zeros((len(idf) if transposed else len(pieces), matrix.shape[1]))
        np.add.at(total, got.column("row").to_numpy(), got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, matrix.shape[1]) if got.num_rows else np.zeros((0, matrix.shape[1])))
        shared.destroy()
        return total

    draw = np.random.default_rng(seed).standard_normal((len(idf), k))
    left, _ = np.linalg.qr(sums(draw, False))  # range of A
    basis, _ = np.linalg.qr(sums(left, True))  # range of A^T, one power step
    core = sums(basis, False)  # A restricted to the range
    _, _, turn = np.linalg.svd(core, full_matrices=False)
    return basis @ turn.T


def fit(docs: DataFrame, items: list[tuple[int, str, str]], rank: int = RANK, text: str = "text") -> Iterator[Space]:
    """The latent spaces of a block of items (id, passage, answer): one for each PIECES pieces, so none if no passage
    has RUN words, and several if passages are very long."""
    cut = [(i, p, words(a), len(w)) for i, passage, a in items for w in [words(passage)] for p in _pieces(w) if len(p) >= RUN]
    for lo in range(0, len(cut), PIECES):
        yield _space(docs, cut[lo : lo + PIECES], rank, text)


def _space(docs: DataFrame, cut: list[tuple[int, list[str], list[str], int]], rank: int, text: str) -> Space:
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, p, _, _ in cut for w in p}))}
    pieces = [[vocabulary[w] for w in p] for _, p, _, _ in cut]
    df, total = document_frequency(docs, vocabulary, text)
    idf = np.log((1 + total) / (1 + df)) + 1e-3  # positive, so that every shared word counts
    basis = randomised_svd(docs.sparkSession, pieces, idf, rank)
    dense = np.array([_dense(p, idf) for p in pieces])
    inside = dense @ basis
    least = []
    for p, d in zip(pieces, dense, strict=True):
        w = np.array([idf[x] * d[x] for x in p])
        runs = np.convolve(w, np.ones(RUN), "valid")
        least.append(runs.min() * (1 - 1e-4))
    products = np.zeros((len(vocabulary) + 1, len(pieces)), np.float32)
    products[:-1] = (idf[:, None] * basis) @ inside.T
    size = np.linalg.norm(dense, axis=1)
    gap = np.sqrt(np.maximum(0, size**2 - (inside**2).sum(axis=1)))
    gap[gap < 1e-6 * size] = 0
    norms2 = np.append(idf**2, 0).astype(np.float32)
    return Space(vocabulary, pieces, [i for i, _, _, _ in cut], [n for _, _, _, n in cut], [a for _, _, a, _ in cut], products, norms2, size, gap, np.array(least, np.float32))


def longest_run(x: list[int], y: list[int]) -> int:
    """Length of the longest common run of two short id lists; unknown words (below 0) match nothing."""
    where: dict[int, list[int]] = {}
    for j, c in enumerate(y):
        where.setdefault(c, []).append(j)
    best, run = 0, {}
    for c in x:  # runs that end here, by their place in y
        run = {j: run.get(j - 1, 0) + 1 for j in where.get(c, ())} if c >= 0 else {}
        best = max(best, *run.values(), 0)
    return best


def common_subsequence(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, with the bits of one integer as the row."""
    where: dict[int, int] = {}
    for i, c in enumerate(y):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(y)) - 1, (1 << len(y)) - 1
    for c in x:
        hit = row & where.get(c, 0) if c >= 0 else 0
        row = ((row + hit) | (row - hit)) & full
    return len(y) - row.bit_count()


#: Blocks of RUN words that are projected at once.
_SLICE = 1024


def _search(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = SimpleNamespace(**shared.value)
        # a window holds 2 * RUN words of a longer piece
        needed = np.array([COSINE * min(1.0, math.sqrt(2 * RUN / len(p))) for p in s.pieces], np.float32)
        lowest, closest, widest = s.least.min(), (needed * s.sizes).min() * (1 - 1e-6), s.residual.max()
        get, other = s.vocabulary.get, len(s.vocabulary)

        def documents() -> Iterator[tuple[object, np.ndarray, list[str]]]:
            for b in batches:
                for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = words(x)
                    if w:
                        yield key, np.fromiter((get(t, other) for t in w), np.int32, len(w)), w

        def flush(part: list[tuple[object, np.ndarray, list[str]]]) -> Iterator[tuple]:
            padded, starts, at = [], [], 0
            for _, ids, _ in part:
                n = -(-len(ids) // RUN)
                padded += [ids, np.full(n * RUN - len(ids), other, np.int32)]
                starts.append(at)
                at += n
            flat = np.concatenate(padded)
            places = np.array(starts)
            last = np.zeros(at, bool)
            last[[x - 1 for x in [*starts[1:], at]]] = True
            best: dict[tuple[int, int], tuple] = {}
            answered: set[tuple[int, int]] = set()
            for lo in range(0, at, _SLICE):
                hi = min(at, lo + _SLICE + 1)
                span = flat[lo * RUN : hi * RUN].reshape(-1, RUN)
                blocks, weight = s.products[span[:, 0]], s.norms2[span].sum(axis=1)
                for i in range(1, RUN):
                    blocks += s.products[span[:, i]]
                windows, mass = blocks.copy(), weight.copy()
                joined = np.flatnonzero(~last[lo : hi - 1])
                windows[joined] += blocks[joined + 1]
                mass[joined] += weight[joined + 1]
                n = min(_SLICE, at - lo)
                # no window below the least that any piece asks for, with the most that the space leaves out, can be a candidate
                lengths2 = mass[:n]
                slack = np.sqrt(RUN * 2 * lengths2) * widest
                near = np.flatnonzero((lengths2 > 0) & (windows[:n].max(axis=1) + slack >= np.minimum(lowest, closest * np.sqrt(lengths2))))
                product, measure = windows[near], np.sqrt(lengths2[near])[:, None]
                bound = product + math.sqrt(RUN * 2) * measure * s.residual[None, :]
                cosine = product / np.maximum(1e-9, measure * s.sizes[None, :])
                for r, p in zip(*np.nonzero((bound >= s.least) | (cosine >= needed)), strict=True):
                    w = near[r]
                    d = int(np.searchsorted(places, lo + w, "right")) - 1
                    first = (lo + int(w) - starts[d]) * RUN
                    yield_key = (d, s.items[p])
                    ids = part[d][1]
                    around = ids[max(0, first - RUN) : first + 3 * RUN]
                    around = np.where(around == other, -1, around).tolist()
                    run = longest_run(around, s.pieces[p])
                    close = float(cosine[r, p])
                    lcs = common_subsequence(around, s.pieces[p]) if run >= RUN or close >= needed[p] else run
                    if run < RUN and lcs < SUBSEQUENCE * len(s.pieces[p]):
                        continue
                    answer, rest = s.answers[p], part[d][2][first : first + max(2 * PIECE, s.lengths[p] + PIECE) + 2 * RUN]
                    if answer and yield_key not in answered and any(rest[i : i + len(answer)] == answer for i in range(len(rest))):
                        answered.add(yield_key)
                    mine = (run, lcs, close, len(s.pieces[p]))
                    best[yield_key] = max(best.get(yield_key, mine), mine)
            for (d, item), (run, lcs, close, size) in best.items():
                yield part[d][0], item, run, lcs, size, close, (d, item) in answered

        def parts() -> Iterator[list[tuple[object, np.ndarray, list[str]]]]:
            part, size = [], 0
            for doc in documents():
                part.append(doc)
                size += len(doc[1])
                if size > 100_000:
                    yield part
                    part, size = [], 0
            if part:
                yield part

        names = ["doc_id", "item_id", "run", "lcs", "passage_words", "cosine", "answer"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
        for part in parts():
            out = list(flush(part))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return search


def leaks(docs: DataFrame, items: DataFrame, rank: int = RANK) -> DataFrame:
    """Documents that hold passages of evaluation items, a row for each: ``doc_id``, ``item_id``, ``run`` (longest run
    of consecutive common words found), ``lcs`` (longest common subsequence with the passage), ``passage_words``,
    ``cosine``, ``answer`` (the item's answer follows) and ``kind``: ``verbatim`` if ``run`` is RUN or more, else
    ``paraphrase``.

    Verbatim rows are complete and exact. Null and empty texts and passages, and passages of fewer than RUN words,
    match nothing; passages of any length are taken whole. Rows that share a ``doc_id`` count as one document, items
    that share an ``item_id`` as one item with several passages. Items are taken in blocks of about BLOCK (they are
    held-out material, a fixed set), and a block's pieces in groups of PIECES, each a pass over the corpus, so what
    goes to every task is bounded. No shuffle of texts.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, run int, lcs int, passage_words int, cosine double, answer boolean"
    blocks = max(1, math.ceil(items.count() / (BLOCK * 0.8)))
    texts, out = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null"), spark.createDataFrame([], schema)
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "passage", F.coalesce("answer", F.lit("")).alias("answer"))
        for space in fit(docs, [tuple(r) for r in mine.where("passage is not null").orderBy("item_id", "passage").collect()], rank):
            # plain values, so that tasks can read them wherever this package lies
            out = out.unionByName(texts.mapInArrow(_search(spark.sparkContext.broadcast(vars(space))), schema))
    cells = F.struct("run", "lcs", "cosine", "passage_words")
    best = out.groupBy("doc_id", "item_id").agg(F.max(cells).alias("m"), F.bool_or("answer").alias("answer"))
    best = best.select("doc_id", "item_id", *[f"m.{c}" for c in ("run", "lcs", "passage_words", "cosine")], "answer")
    return best.withColumn("kind", F.when(F.col("run") >= RUN, "verbatim").otherwise("paraphrase"))
