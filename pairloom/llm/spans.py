"""Problem 9: long spans that several documents share verbatim.

MinHash banding over paragraphs of a fixed length: every stretch of SPAN characters of a text is a paragraph, its
shingles are all its GRAM-character substrings, and its MinHash is the smallest of their hashes. With one row in one
band, two equal paragraphs always collide, so recall is 1 wherever a shared span begins; and as neighbouring
paragraphs mostly share their minimum, a text keeps only about 2 in SPAN - GRAM + 2 of its positions. Colliding
places are verified on the characters around them. Exact copies of a text are one class throughout and become pairs
of documents only in the last join; clusters are connected components of the classes' links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.operators.skew import fragment_replicate_join, plan_counts
from pairloom.staging import stage, tasks

SPAN = 300
GRAM = 200
SIDE = SPAN - GRAM
#: Characters that are hashed at once.
CHUNK = 1 << 21
#: Distinct places with the same shingle up to which they are compared pair by pair; more are matched by hashing.
FEW = 32


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, size: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """64-bit hashes of all substrings of ``size`` code points, from sums of powers of an odd base."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - size, inverse, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes.astype(np.uint64)) * powers, dtype=np.uint64)])
        return _mix((sums[size:] - sums[:-size]) * back)


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of each ``width`` consecutive hashes."""
    at = np.arange(len(h))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        reach += step
    return at


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _parts(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    k, t, size = [], [], 0
    for key, x in zip(keys, texts, strict=True):
        k.append(key)
        t.append(x)
        size += len(x)
        if size > CHUNK:
            yield k, t
            k, t, size = [], [], 0
    if k:
        yield k, t


def fingerprints(keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, MinHash and place of the paragraphs of some texts; equal neighbours once."""
    codes = _codes(texts)
    ends = np.cumsum([len(x) for x in texts])
    h = rolling(codes, GRAM)
    at = least_positions(h, SIDE + 1)  # of the paragraph that begins at each code point
    doc = np.searchsorted(ends, np.arange(len(at)), "right")
    inside = np.arange(len(at)) + SPAN <= ends[doc]
    doc, at = doc[inside], at[inside]
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    doc, at = doc[fresh], at[fresh]
    starts = ends - np.array([len(x) for x in texts])
    return keys[doc], h[at].view(np.int64), (at - starts[doc]).astype(np.int32)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, texts in _parts(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = fingerprints(np.array(keys, np.int64), texts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["doc_id", "print", "place"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part.slice(lo, 500) for part in batches for lo in range(0, part.num_rows, 500)):
        out: list[tuple] = []
        for key, text, places in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            seen = {(text[p : p + GRAM], text[max(0, p - SIDE) : p], text[p + GRAM : p + SPAN]) for p in places}
            out += [(key, hashlib.md5(g.encode("utf-8", "surrogatepass")).digest(), left, right) for g, left, right in seen]
        # a place was chosen by a paragraph around it, so every segment has SPAN characters at least
        kinds = [pa.int64(), pa.binary(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "gram", "before", "after"])


def _common(x: str, y: str) -> int:
    n = 0
    for a, b in zip(x, y):  # noqa: B905
        if a != b:
            break
        n += 1
    return n


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of places with the same shingle, those whose equal stretch has SPAN characters."""
    for b in batches:
        names = ["before_a", "after_a", "before_b", "after_b"]
        cells = zip(*(b.column(n).to_pylist() for n in names), strict=True)
        ok = [(n := _common(ra, rb)) >= SIDE or n + _common(la[::-1], lb[::-1]) >= SIDE for la, ra, lb, rb in cells]
        yield b.select(["seg_a", "seg_b"]).filter(pa.array(ok, pa.bool_()))


def _long(docs: DataFrame) -> DataFrame:
    """Documents with an id and at least SPAN characters; no others can share a span."""
    return docs.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= SPAN)).select("doc_id", "text")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``rep`` of the documents with at least SPAN characters: documents with the same text have the same
    ``rep``, the smallest of their ids. Digests are combined before they move; the text itself is not shuffled."""
    digest = _long(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    return digest.join(first, "digest").select("doc_id", "rep")


def _hits(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``doc_id``, ``places``: of one document of each class, the places whose shingle occurs in another class."""
    texts = _long(docs)
    prints = stage(texts.mapInArrow(_prints, "doc_id long, print long, place int"), "prints")
    copies = members.where("doc_id <> rep").select("doc_id")
    own = prints.join(copies, "doc_id", "left_anti")
    shared = own.groupBy("print").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = stage(shared.select("print", "n"), "shared_prints")
    # what stands on a third of all pages is one print: its rows are split over tasks
    plan = plan_counts(shared, ["print"], "n", prints.count(), tasks(docs.sparkSession))
    hits = fragment_replicate_join(own, shared.select("print"), ["print"], "doc_id", "left_semi", plan)
    return hits.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def linked_classes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``a`` < ``b``: representatives of two classes of texts that share SPAN characters."""
    texts = _long(docs)
    places = texts.join(_hits(docs, members), "doc_id").select("doc_id", "text", "places")
    found = places.mapInArrow(_segments, "doc_id long, gram binary, before string, after string")
    whole = F.concat_ws(":", F.hex("gram"), F.char_length("before").cast("string"), F.concat("before", "after"))
    found = stage(found.withColumn("seg", F.unhex(F.md5(whole))), "segments")
    kinds = found.groupBy("gram", "before", "after").agg(F.min("seg").alias("seg"), F.count(F.lit(1)).alias("n"))
    sizes = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows")).where("rows > 1")
    kinds = stage(kinds.join(sizes, "gram").select("gram", "before", "after", "seg", "kinds"), "segment_kinds")

    few = kinds.where(F.col("kinds").between(2, FEW))
    left = few.select("gram", F.col("seg").alias("seg_a"), F.col("before").alias("before_a"), F.col("after").alias("after_a"))
    right = few.select("gram", F.col("seg").alias("seg_b"), F.col("before").alias("before_b"), F.col("after").alias("after_b"))
    near = left.join(right, "gram").where("seg_a < seg_b").drop("gram").mapInArrow(_reaching, "seg_a binary, seg_b binary")

    many = kinds.where(F.col("kinds") > FEW)
    shift = F.explode(F.sequence(F.lit(0), F.lit(SIDE))).alias("shift")
    cut = many.select("gram", "before", "after", "seg", shift).where((F.char_length("before") >= F.lit(SIDE) - F.col("shift")) & (F.char_length("after") >= F.col("shift")))
    head = F.when(F.col("shift") == SIDE, "").otherwise(F.expr(f"right(before, {SIDE} - shift)"))
    cut = cut.select(F.unhex(F.md5(F.concat_ws("\x1f", F.hex("gram"), "shift", head, F.expr("left(after, shift)")))).alias("window"), "seg")
    far = cut.select("window", F.col("seg").alias("seg_a")).join(cut.select("window", F.col("seg").alias("seg_b")), "window").where("seg_a < seg_b").select("seg_a", "seg_b")

    by = found.join(kinds.select("seg").distinct(), "seg", "left_semi").select("seg", "doc_id").distinct()
    same = by.select("seg", F.col("doc_id").alias("x")).join(by.select("seg", F.col("doc_id").alias("y")), "seg").where("x < y").select("x", "y")
    pairs = near.unionByName(far).distinct()
    cross = pairs.join(by.select(F.col("seg").alias("seg_a"), F.col("doc_id").alias("x")), "seg_a").join(by.select(F.col("seg").alias("seg_b"), F.col("doc_id").alias("y")), "seg_b").where("x <> y").select("x", "y")
    return same.unionByName(cross).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shared_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id_a`` < ``doc_id_b``: every pair of documents whose texts share a verbatim span of SPAN code points or
    more. Null, empty and shorter texts share nothing; exact copies of a text of SPAN characters are pairs. Rows without
    an id are left out, a repeated row counts once, and no id may stand at two different texts. Other columns are not
    read; an empty table gives no rows. Nothing is dropped, however often a shingle
    occurs: places with the same shingle are compared pair by pair while they are few, and beyond that matched by the
    digests of all windows around them, which yields only pairs that are part of the result.
    """
    members = stage(classes(docs), "text_classes")
    links = linked_classes(docs, members)
    ma = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    mb = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    cross = links.join(ma, "a").join(mb, "b").select("x", "y")
    within = ma.join(mb, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return cross.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def clusters(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (its exact copies), ``cluster_id`` (its connected component of shared spans, smallest
    representative), ``n_links`` (other classes it shares a span with) and ``kept`` (the one document of the component
    that stays if shared text is to be removed), for documents of at least SPAN characters."""
    members = stage(classes(docs), "text_classes")
    links = stage(linked_classes(docs, members), "class_links")
    part = components(links, "a", "b").select(F.col("id").alias("rep"), F.col("component").alias("cluster_id"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(part, "rep", "left").join(ends, "rep", "left")
    return out.select("doc_id", F.col("rep").alias("class_id"), F.coalesce("cluster_id", "rep").alias("cluster_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("doc_id") == F.coalesce("cluster_id", "rep")).alias("kept"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, text, places in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            codes = _codes([text])
            h = [rolling(codes, SPAN, base).view(np.int64) for base in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]
            n = len(h[0])
            near = np.zeros(n + 1, np.int32)
            for p in places:
                near[max(0, p - SIDE)] += 1
                near[min(n, p + 1)] -= 1
            at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32)), pa.array(h[0][at]), pa.array(h[1][at])], ["doc_id", "start", "h1", "h2"])


def coverage(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``n_shared``: how many characters of each text of at least SPAN characters lie in spans
    (of SPAN or more) that another document holds too. Exact copies are shared whole. Windows of SPAN characters
    compare by two independent 64-bit hashes; no pairs are formed."""
    members = stage(classes(docs), "text_classes")
    texts = _long(docs)
    places = texts.join(_hits(docs, members), "doc_id").select("doc_id", "text", "places")
    windows = stage(places.mapInArrow(_windows, "doc_id long, start int, h1 long, h2 long"), "windows")
    elsewhere = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2")
    from pyspark.sql import Window

    w = Window.partitionBy("rep").orderBy("start")
    step = F.coalesce(F.col("start") - F.lag("start").over(w), F.lit(SPAN))
    part = windows.join(elsewhere, ["h1", "h2"]).select(F.col("doc_id").alias("rep"), "start").withColumn("more", F.least(step, F.lit(SPAN))).groupBy("rep").agg(F.sum("more").alias("part"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    chars = texts.select("doc_id", F.char_length("text").alias("n_chars")).distinct()
    out = chars.join(members.join(sizes, "rep").join(part, "rep", "left"), "doc_id")
    return out.select("doc_id", "n_chars", F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("n_shared"))
