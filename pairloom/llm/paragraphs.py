"""Problem 9 on paragraphs as written: near-duplicate paragraphs by MinHash banding, and which of them to remove.

Bands are tuned for recall at the similarity asked for; paragraphs that collide are joined and verified by their exact
Jaccard similarity; connected components are the classes of which one paragraph stays. Spans that begin anywhere in a
paragraph are the business of :mod:`pairloom.llm.spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.spans import _mix
from pairloom.operators.skew import fragment_replicate_join, plan_counts
from pairloom.staging import stage, tasks

#: Words of a shingle, and the Jaccard similarity from which paragraphs are duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Hash functions of a signature, and the recall at that similarity that its bands must reach.
HASHES, RECALL = 128, 0.99
#: Different paragraphs of a bucket up to which they become candidate pairs; fuller buckets are compared block by block,
#: which yields nothing but true links.
FEW = 64
#: Paragraphs of a block.
BLOCK = 256
#: Characters that are hashed at once.
CHUNK = 1 << 20


def bands(similarity: float = SIMILARITY, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int, float]:
    """Rows of a band, bands, and the chance that two paragraphs of that similarity collide: the most rows, hence the
    fewest false candidates, with which the recall is reached."""
    for rows in range(hashes, 0, -1):
        n = hashes // rows
        chance = 1 - (1 - similarity**rows) ** n
        if chance >= recall:
            return rows, n, chance
    raise ValueError(f"no banding of {hashes} hashes reaches a recall of {recall} at {similarity}")


def normal(text: Column) -> Column:
    """Words (runs of letters and digits) in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``place`` (from 0), ``words`` and their ``digest``, of the paragraphs (between line breaks) of SHINGLE
    words or more."""
    each = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", r"[\r\n]+")).alias("place", "t"))
    each = each.select("doc_id", "place", normal(F.col("t")).alias("words"))
    return each.where(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) >= SHINGLE - 1).withColumn("digest", F.md5("words"))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of some texts, one after the other, and where each text's begin. Hashes are of
    characters, from sums of powers of an odd base."""
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    base, blank = 0x5851F42D4C957F2D, codes == 32
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), base, np.uint64)]))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), pow(base, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes.astype(np.uint64)) * powers[:-1], dtype=np.uint64)])
        words = np.array([t.count(" ") + 1 for t in texts])
        first = np.concatenate([[0], np.cumsum(words)])[:-1]
        at = np.concatenate([np.arange(a, a + n - SHINGLE + 1) for a, n in zip(first, words, strict=True)])
        lo, hi = begin[at], end[at + SHINGLE - 1]
        return _mix((sums[hi] - sums[lo]) * back[lo]), np.concatenate([[0], np.cumsum(words - SHINGLE + 1)])[:-1]


def _parts(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHUNK:
            yield keys[lo : i + 1], texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield keys[lo:], texts[lo:]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, n, _ = bands()
    for b in batches:
        for keys, texts in _parts(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h, starts = shingles(texts)
            for band in range(n):
                key = np.full(len(texts), band, np.uint64)
                with np.errstate(over="ignore"):
                    for row in range(rows):
                        seed = _mix(np.array([band * rows + row + 1], np.uint64))
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(_mix(h ^ seed), starts))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(key.view(np.int64))], ["digest", "bucket"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for a, c, x, y in zip(*(b.column(n).to_pylist() for n in ("a", "b", "words", "words_b")), strict=True):
            s, t = (np.unique(shingles([w])[0]) for w in (x, y))
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append((a, c, both / (len(s) + len(t) - both)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "jaccard"])


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within a block, or between two, by products of the rows of one table of paragraphs and shingles."""
    rows = rows.sort_values("digest", ignore_index=True)
    h, starts = shingles(rows["words"].tolist())
    _, which = np.unique(h, return_inverse=True)
    held = np.zeros((len(rows), int(which.max()) + 1), np.float32)
    held[np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(h)))), which] = 1
    both, size = held @ held.T, held.sum(axis=1)
    jaccard = both.astype(float) / (size[:, None] + size[None, :] - both)
    apart = (rows["block"].to_numpy()[:, None] != rows["block"].to_numpy()[None, :]) | (rows["lo"].to_numpy() == rows["hi"].to_numpy())[:, None]
    a, b = np.nonzero(np.triu((jaccard >= SIMILARITY) & apart, 1))
    return pd.DataFrame({"a": rows["digest"].to_numpy()[a], "b": rows["digest"].to_numpy()[b], "jaccard": jaccard[a, b]})


def links(kinds: DataFrame) -> DataFrame:
    """``a`` < ``b``, ``jaccard``: pairs of different paragraphs that collide in a band and whose exact Jaccard similarity is
    SIMILARITY or more."""
    texts = kinds.select("digest", "words")
    members = stage(texts.mapInArrow(_signatures, "digest string, bucket long"), "signatures")
    sizes = stage(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    few = members.join(sizes.where(F.col("n") <= FEW).select("bucket"), "bucket")
    pairs = few.select("bucket", F.col("digest").alias("a")).join(few.select("bucket", F.col("digest").alias("b")), "bucket").where("a < b").select("a", "b")
    pairs = stage(pairs.distinct(), "candidates")
    both = fragment_replicate_join(pairs, texts.withColumnRenamed("digest", "a"), ["a"], "b")
    both = fragment_replicate_join(both, texts.select(F.col("digest").alias("b"), F.col("words").alias("words_b")), ["b"], "a")
    found = both.mapInArrow(_similar, "a string, b string, jaccard double").where(F.col("jaccard") >= SIMILARITY)

    full = stage(sizes.where(F.col("n") > FEW), "full_buckets")
    plan = plan_counts(full, ["bucket"], "n", members.count(), tasks(kinds.sparkSession))
    many = fragment_replicate_join(members, full.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), ["bucket"], "digest", plan=plan)
    many = many.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("digest", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    many = fragment_replicate_join(many, texts, ["digest"], "bucket")
    return found.unionByName(many.groupBy("bucket", "lo", "hi").applyInPandas(_block, "a string, b string, jaccard double")).dropDuplicates(["a", "b"])


def duplicates(docs: DataFrame) -> DataFrame:
    """A row for each paragraph of SHINGLE words or more: ``doc_id``, ``place``, the paragraph ``class_doc``, ``class_place``
    that stands for its class (its first), ``n_links`` (different paragraphs similar to it) and ``kept``: whether it is
    the one that stays.

    Paragraphs are the same if their words are, and duplicates if the Jaccard similarity of their shingles is SIMILARITY
    or more; a class is a connected component of duplicates. Equal paragraphs are one from the start, combined before
    rows move, so that what stands in a third of all pages is compared once. A pair at the similarity itself is found with
    the chance that :func:`bands` computes, more similar ones with a higher one; no pair of a bucket is dropped. Null and empty texts have no paragraphs, rows without an id are left out, a repeated
    row counts once, other columns are not read, and an empty table gives no rows.
    """
    each = paragraphs(docs)
    kinds = each.groupBy("digest").agg(F.min("words").alias("words"), F.min(F.struct("doc_id", "place")).alias("at"), F.count(F.lit(1)).alias("n"))
    kinds = stage(kinds, "paragraph_kinds")
    near = stage(links(kinds), "paragraph_links")
    part = components(near, "a", "b").select(F.col("id").alias("digest"), "component")
    ends = near.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_links"))
    of = kinds.drop("words").join(part, "digest", "left").join(ends, "digest", "left")
    of = stage(of.select("digest", "n", "at", F.coalesce("component", "digest").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "paragraph_classes")
    firsts = of.groupBy("class").agg(F.min("at").alias("first"))
    info = of.join(firsts, "class").select("digest", F.col("first.doc_id").alias("class_doc"), F.col("first.place").alias("class_place"), "n_links")
    rows = each.select("doc_id", "place", "digest").distinct()
    total = of.agg(F.sum("n")).head()[0] or 0
    out = fragment_replicate_join(rows, info, ["digest"], "doc_id", plan=plan_counts(of, ["digest"], "n", total, tasks(docs.sparkSession)))
    kept = (F.col("doc_id") == F.col("class_doc")) & (F.col("place") == F.col("class_place"))
    return out.select("doc_id", "place", "class_doc", "class_place", "n_links", kept.alias("kept"))
