"""Alignment of reads to reference sequences, SAM records, and error correction against the reference."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.functions import seq as S
from pairloom.functions.kernels import align, matrices
from pairloom.operators.steps import called, once, sealed, unsealed
from pairloom.staging import stage

#: Most bases of all references together for which their k-mers go to every task; beyond, reads and k-mers are joined.
MAX_REFERENCE = 2_000_000
#: Counters of reads and strands that are held at once.
COUNTERS = 1 << 22


def references(table: DataFrame) -> DataFrame:
    """``ref_id``, ``ref_name`` without trailing blanks, ``ref`` in upper case."""
    return table.select("ref_id", F.rtrim("ref_name").alias("ref_name"), F.upper(F.trim("seq")).alias("ref"))


def kmer_index(refs: DataFrame, k: int = 8) -> DataFrame:
    """``ref_id``, ``strand`` (+/-) and ``kmer``: the k-mers of ACGT of both strands, once each."""
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("ref").alias("s")), F.struct(F.lit("-").alias("strand"), S.reverse_complement("ref").alias("s")))
    each = refs.select("ref_id", F.explode(strands).alias("x")).select("ref_id", "x.strand", F.explode(S.kmers("x.s", k)).alias("kmer"))
    return each.where(F.col("kmer").rlike("^[ACGT]+$")).distinct()


def kmer_hits(reads: DataFrame, refs: DataFrame, key: str, part: Column, k: int = 8) -> DataFrame:
    """``key``, ``ref_id``, ``strand``, ``hits``: how many k-mers of a part of each read occur in each strand."""
    index = kmer_index(refs, k)
    starts = F.explode(F.sequence(F.lit(1), F.length("s") - k + 1)).alias("i")
    mers = reads.select(key, part.alias("s")).where(F.length("s") >= k).select(key, "s", starts).select(key, F.substring("s", F.col("i"), F.lit(k)).alias("kmer"))
    return mers.join(index, "kmer").groupBy(key, "ref_id", "strand").agg(F.count(F.lit(1)).alias("hits"))


class KmerTable(NamedTuple):
    """The k-mers of both strands of all references, as sorted numbers; strand 2 i is reference i forward, 2 i + 1
    reversed. The strands of k-mer j are ``strands[starts[j]:starts[j + 1]]``."""

    ids: list
    kmers: np.ndarray
    starts: np.ndarray
    strands: np.ndarray


def _codes(text: bytes, k: int) -> np.ndarray:
    """Numbers of the k-mers of a text in base 4, -1 where a letter is none of ACGT."""
    base = np.full(256, -1, np.int64)
    base[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    x = base[np.frombuffer(text, np.uint8)]
    n = max(0, len(x) - k + 1)
    code, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        code = code * 4 + x[i : i + n]
        bad |= x[i : i + n] < 0
    return np.where(bad, -1, code)


def _kmer_table(refs: list[tuple[object, str]], k: int) -> KmerTable:
    turn = str.maketrans("ACGT", "TGCA")
    found = [np.unique(_codes(s.encode("latin-1", "replace"), k)) for _, ref in refs for s in (ref, ref.translate(turn)[::-1])]
    strand = np.repeat(np.arange(len(found)), [len(f) for f in found])
    kmer = np.concatenate([*found, np.zeros(0, np.int64)])
    strand, kmer = strand[kmer >= 0], kmer[kmer >= 0]
    order = np.lexsort((strand, kmer))
    kmers, starts = np.unique(kmer[order], return_index=True)
    return KmerTable([i for i, _ in refs], kmers, np.append(starts, len(kmer)), strand[order].astype(np.int32))


def _hit_counts(texts: list[str], t: KmerTable, k: int, first: np.ndarray | None = None, window: int = 0) -> np.ndarray:
    """Texts x strands: how many k-mers of each text occur in each strand; with ``window`` only those within so many
    letters from ``first`` on."""
    flat = "\n".join(texts).encode("latin-1", "replace")
    size = np.array([len(x) for x in texts])
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    code = _codes(flat, k)
    at = np.flatnonzero(code >= 0)
    where = np.searchsorted(t.kmers, code[at])
    known = (where < len(t.kmers)) & (t.kmers[np.minimum(where, len(t.kmers) - 1)] == code[at])
    at, where = at[known], where[known]
    row = np.searchsorted(begin, at, "right") - 1
    if window:
        inside = (at - begin[row] >= first[row]) & (at - begin[row] <= first[row] + window - k)
        where, row = where[inside], row[inside]
    n = t.starts[where + 1] - t.starts[where]
    which = np.repeat(t.starts[where] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    width = 2 * len(t.ids)
    return np.bincount(np.repeat(row, n) * width + t.strands[which], minlength=len(texts) * width).reshape(len(texts), width)


def _placer(shared, k: int, window: int):  # noqa: ANN001, ANN202
    """Function of a read's part and of the first base of the window that decides on its strand."""

    @F.pandas_udf("ref long, strand string, hits long")
    def run(part: pd.Series, first: pd.Series) -> pd.DataFrame:
        t = KmerTable(*shared.value)
        out = pd.DataFrame({"ref": pd.array([None] * len(part), "Int64"), "strand": None, "hits": pd.array([None] * len(part), "Int64")}, index=part.index)
        known = np.flatnonzero(part.notna().to_numpy())
        step = max(1, COUNTERS // max(1, 2 * len(t.ids)))
        for rows in (known[lo : lo + step] for lo in range(0, len(known) if len(t.kmers) else 0, step)):
            texts = part.iloc[rows].tolist()
            hits = _hit_counts(texts, t, k)
            best, i = hits.argmax(axis=1), np.arange(len(rows))  # the lowest reference, forward before reverse
            top, ref, strand = hits[i, best], best // 2, best % 2
            if window:
                near = _hit_counts(texts, t, k, first.iloc[rows].to_numpy(), window)
                strand = (near[i, 2 * ref] < near[i, 2 * ref + 1]).astype(int)
            rows, ref, strand, top = rows[top > 0], ref[top > 0], strand[top > 0], top[top > 0]
            out.iloc[rows, 0] = pd.array([t.ids[x] for x in ref], "Int64")
            out.iloc[rows, 1] = np.where(strand == 0, "+", "-")
            out.iloc[rows, 2] = pd.array(top, "Int64")
        return out

    return run


def placed(reads: DataFrame, refs: DataFrame, part: Column, k: int = 8, window: int = 0, first: Column | None = None, key: str = "ordinal", take: Sequence[str] = ()) -> DataFrame:
    """``reads`` with ``ref_id``, ``strand``, ``hits`` and the columns ``take`` of the reference: the reference that shares most k-mers with a part of the read on
    one strand, the lowest id among equals, forward before reverse. Reads without hits are dropped, k-mers with other
    letters than ACGT count nowhere.

    With ``window`` the strand is that which shares more of the k-mers within so many bases from ``first`` (from 0) on,
    forward if they share as many. References of up to MAX_REFERENCE bases go to every task, so nothing is shuffled;
    longer ones are joined by k-mer (``key`` must be unique, and the whole part decides on the strand)."""
    spark = reads.sparkSession
    if (refs.agg(F.sum(F.length("ref"))).head()[0] or 0) > MAX_REFERENCE:
        found = reads.join(place(reads, refs, key, part, k), key)
        return found.join(refs.select("ref_id", *take), "ref_id") if take else found
    known = [(r["ref_id"], r["ref"]) for r in refs.where("ref_id is not null and ref is not null").orderBy("ref_id").collect()]
    # plain values, so that tasks can read them wherever this package lies
    shared = spark.sparkContext.broadcast(tuple(_kmer_table(known, k)))
    found = called(reads, {"__spot": _placer(shared, k, window)(part, F.lit(0) if first is None else first)}).where("__spot.ref is not null")
    found = found.select(*reads.columns, F.col("__spot.ref").cast(refs.schema["ref_id"].dataType).alias("ref_id"), "__spot.strand", "__spot.hits")
    return found.join(F.broadcast(refs.select("ref_id", *take)), "ref_id") if take else found  # their size is checked above


def place(reads: DataFrame, refs: DataFrame, key: str, part: Column, k: int = 8) -> DataFrame:
    """``key``, ``ref_id``, ``strand``, ``hits`` as in :func:`placed`, by a join on k-mers."""
    # hits, then the id downwards, then the strand, in one number, so that hash aggregation can keep the largest
    top = 1 << 31
    rank = F.col("hits") * F.lit(2 * top) + (F.lit(top - 1) - F.col("ref_id").cast("long")) * 2 + (F.col("strand") == "+").cast("long")
    found = kmer_hits(reads, refs, key, part, k).groupBy(key).agg(F.max(rank).alias("m"))
    ref_id = (F.lit(top - 1) - F.shiftright("m", 1).bitwiseAND(F.lit(top - 1).cast("long"))).cast("int").alias("ref_id")
    return found.select(key, ref_id, F.when(F.col("m") % 2 == 1, "+").otherwise("-").alias("strand"), F.shiftright("m", 32).alias("hits"))


def turned(reads: DataFrame) -> DataFrame:
    """Reads (``seq``, ``qual``) placed on ``strand`` - turned."""
    back = F.col("strand") == "-"
    return once(reads, {"seq": F.when(back, S.reverse_complement("seq")).otherwise(F.col("seq")), "qual": F.when(back, F.reverse("qual")).otherwise(F.col("qual"))})


def diagonal(read: str, ref: str, k: int = 8) -> Column:
    """Where in the reference (from 0, negative before it) a read begins by most of its k-mers, each at its first
    place; the lowest among equals, 0 without any."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(read) - k + 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.instr(F.col(ref), F.substring(F.col(read), i, F.lit(k))).alias("p")))
    found = F.transform(F.filter(at, lambda x: x["p"] > 0), lambda x: x["p"] - x["i"])
    most = F.array_max(F.transform(F.array_distinct(found), lambda v: F.struct(F.size(F.filter(found, lambda x: x == v)).alias("n"), (-v).alias("d"))))
    return F.coalesce(-most["d"], F.lit(0))


def _bodies(x: list[str], y: list[str], head: np.ndarray, body: np.ndarray) -> list[tuple]:
    """Of gapped alignments the part beside the reference's body, from ``head`` to ``body`` bases of x: both strings, bases
    of y before it and up to its end, matches, mismatches with and without deletions, and gaps; nothing where x ends
    before the body does."""
    r, size, q, _ = matrices(x, y)
    shown = np.arange(r.shape[1])[None, :] < size[:, None]
    ref, read = shown & (r != ord("-")), shown & (q != ord("-"))
    before = np.cumsum(ref, axis=1) - ref
    upto = shown & (before < body[:, None])
    kept = upto & (before >= head[:, None])
    same = kept & (r == q)
    cells = [(upto & read & ~kept), (upto & read), same, kept & ref & (r != q), kept & ref & read & (r != q), kept & ~(ref & read)]
    counts = np.stack([c.sum(axis=1) for c in cells], axis=1).tolist()
    lo, hi = np.where(kept.any(axis=1), kept.argmax(axis=1), 0).tolist(), (np.where(kept.any(axis=1), r.shape[1] - kept[:, ::-1].argmax(axis=1), 0) if r.shape[1] else 0 * size).tolist()
    whole = ((upto & ref).sum(axis=1) == body) & kept.any(axis=1)
    return [(a[p:e], b[p:e], *n) if ok else (None,) * 8 for a, b, p, e, n, ok in zip(x, y, lo, hi, counts, whole.tolist(), strict=True)]


def _global(gap: int, band: int):  # noqa: ANN202
    @F.pandas_udf("ref_aln string, read_aln string, lead int, used int, matches int, mismatches_raw int, mismatches int, gaps int")
    def run(x: pd.Series, y: pd.Series, head: pd.Series, body: pd.Series) -> pd.DataFrame:
        got = align(x.fillna("").tolist(), y.fillna("").tolist(), gap, band, False)
        rows = _bodies([g.x for g in got], [g.y for g in got], head.to_numpy(), body.to_numpy()) if got else []
        out = pd.DataFrame(rows, columns=["ref_aln", "read_aln", "lead", "used", "matches", "mismatches_raw", "mismatches", "gaps"])
        return out.astype({c: "Int32" for c in out.columns[2:]})

    return run


def banded(reads: DataFrame, config: PipelineConfig | None = None, front: str | None = None, back: str | None = None) -> DataFrame:
    """Align ``seq`` to ``ref`` (both columns of ``reads``), with the primers ``front`` and ``back`` around the reference
    if named. Adds ``ref_aln``, ``read_aln`` (the body, without primers), ``matches``, ``mismatches_raw`` (deletions
    count), ``mismatches``, ``gaps``; ``seq`` and ``qual`` become the aligned part.

    Dropped: lengths that differ by more than the ratio, alignments that don't reach the body's end, identity below
    the threshold, and with ``exclude_indels`` any gap. The longer string is cut to the shorter first.
    """
    config = config or PipelineConfig(mode="reference")
    head, tail = F.col(front) if front else F.lit(""), F.col(back) if back else F.lit("")
    whole = F.concat(head, F.col("ref"), tail)
    a, b = F.length("__whole"), F.length("seq")
    near = (a <= b * config.length_ratio) & (b <= a * config.length_ratio) & (b > 0)
    rows = once(reads, {"__whole": whole, "__body": F.length(head) + F.length("ref"), "__head": F.length(head)}).where(near)
    n = F.least(F.length("__whole"), F.length("seq"))
    rows = once(rows, {"__whole": F.left(F.col("__whole"), n), "seq": F.left(F.col("seq"), n), "qual": F.left(F.col("qual"), n)})
    rows = called(rows, {"al": _global(config.gap, config.kband)("__whole", "seq", "__head", "__body")}).where("al.ref_aln is not null")
    if config.exclude_indels:
        rows = rows.where("al.gaps = 0")
    rows = rows.where(100.0 * F.col("al.matches") / F.col("al.used") >= config.global_identity)
    part = lambda c: F.substring(F.col(c), F.col("al.lead") + 1, F.col("al.used") - F.col("al.lead")).alias(c)
    kept = [c for c in rows.columns if c not in ("__whole", "__body", "__head", "al", "seq", "qual")]
    return rows.select(*kept, *[f"al.{c}" for c in ("ref_aln", "read_aln", "matches", "mismatches_raw", "mismatches", "gaps")], part("seq"), part("qual"))


def sam(aligned: DataFrame, name: str = "title") -> DataFrame:
    """The eleven columns of a SAM record. With ``ref_start``, where in the reference (from 0) the alignment begins."""
    pos = F.col("ref_start") + 1 if "ref_start" in aligned.columns else F.lit(1)
    return aligned.select(
        F.col(name).alias("qname"), F.lit(0).alias("flag"), F.col("ref_name").alias("rname"), pos.alias("pos"), F.lit(255).alias("mapq"),
        S.cigar("ref_aln", "read_aln").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), "seq", "qual",
    )


def cigar_counts(cigars: Column) -> Column:
    """Total bases of M, I and D and the longest M of a CIGAR string."""
    ops = S.cigar_ops(cigars)
    total = lambda k: F.aggregate(F.filter(ops, lambda o: o["op"] == k), F.lit(0), lambda acc, o: acc + o["n"])
    longest = F.coalesce(F.array_max(F.transform(F.filter(ops, lambda o: o["op"] == "M"), lambda o: o["n"])), F.lit(0))
    return F.struct(total("M").alias("m"), total("I").alias("i"), total("D").alias("d"), longest.alias("longest_m"))


def _spread(aligned: DataFrame) -> DataFrame:
    """Add ``qual_aln``: the qualities beside the gapped read, ``!`` at deletions. Reads without any keep theirs."""
    step = lambda acc, c: F.when(
        c == "-", F.struct(F.concat(acc["out"], F.lit("!")).alias("out"), acc["at"].alias("at"))
    ).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col("qual"), acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")))
    spread = F.aggregate(S.chars("read_aln"), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: acc["out"])
    return once(aligned, {"qual_aln": F.when(F.instr("read_aln", "-") > 0, spread).otherwise(F.col("qual"))})


def _position(at: Column, start: Column | int = 0) -> Column:
    """Reference position (from 0) of an aligned column: its place less the insertions before it, from ``start``."""
    before = F.left(F.col("ref_aln"), at)
    return F.lit(start) + F.when(F.instr("ref_aln", "-") == 0, at).otherwise(F.length(F.replace(before, F.lit("-"), F.lit(""))))


def _start(aligned: DataFrame) -> Column:
    """Where in the reference the alignments begin."""
    return F.col("ref_start") if "ref_start" in aligned.columns else F.lit(0)


def _cells() -> Column:
    """Aligned columns as structs ``r``, ``b`` and ``q`` (a quality character)."""
    return F.arrays_zip(S.chars("ref_aln").alias("r"), S.chars("read_aln").alias("b"), S.chars("qual_aln").alias("q"))


def correct_base(aligned: DataFrame, least: int = 30) -> DataFrame:
    """``seq`` with N and aligned bases of a quality below ``least`` replaced by the reference's; insertions stay."""
    low = chr(least + 33)
    fix = lambda c: F.when((c["r"] == "-") | (c["b"] == "-"), c["b"]).when((c["b"] == "N") | (c["q"] < low), c["r"]).otherwise(c["b"])
    fixed = F.translate(F.array_join(F.transform(_cells(), fix), ""), "-", "")
    return once(_spread(aligned), {"seq": fixed}).drop("qual_aln")


def position_stats(aligned: DataFrame, ref: str | Sequence[str] = "ref_id") -> DataFrame:
    """For each reference (or job and reference) and position (from 0): ``n``, expected errors ``mu`` and their deviation ``sigma``, counts of
    the four bases. Only aligned bases count. Sums are combined before rows move."""
    ref = [ref] if isinstance(ref, str) else list(ref)
    rows = _spread(aligned).select(*ref, "ref_aln", "read_aln", "qual_aln", _start(aligned).alias("__start"))
    at = F.col("at")
    each = rows.withColumn("at", F.explode(S.places("ref_aln")))
    each = each.where((S.char_at("ref_aln", at) != "-") & (S.char_at("read_aln", at) != "-"))
    # first by quality as well: few groups for each position, and the powers are taken once for each
    each = each.select(*ref, _position(at - 1, F.col("__start")).alias("ref_pos"), S.char_at("read_aln", at).alias("b"), S.phred_at("qual_aln", at).alias("q"))
    each = each.groupBy(*ref, "ref_pos", "b", "q").agg(F.count(F.lit(1)).alias("k"))
    p = F.pow(F.lit(10.0), -F.col("q") / 10.0)
    counts = [F.sum(F.when(F.col("b") == b, F.col("k")).otherwise(0)).alias(f"n_{b.lower()}") for b in "ACGT"]
    return each.groupBy(*ref, "ref_pos").agg(F.sum("k").alias("n"), F.sum(p * F.col("k")).alias("mu"), F.sqrt(F.sum(p * (1 - p) * F.col("k"))).alias("sigma"), *counts)


def z_scores(stats: DataFrame) -> DataFrame:
    """Add ``z_a`` to ``z_t``: by how many deviations a base is commoner than errors explain; without deviation, infinity."""
    def z(b: str) -> Column:
        spread = F.col("sigma") / F.sqrt(F.lit(3.0))
        return F.when(spread > 0, (F.col(f"n_{b}") + 0.5 - F.col("mu") / 3) / spread).otherwise(F.lit(float("inf")))

    return stats.withColumns({f"z_{b}": z(b) for b in "acgt"})


def correct_zscore(aligned: DataFrame, ref: str | Sequence[str] = "ref_id", least: float = 1.645) -> DataFrame:
    """``seq`` with aligned bases that differ from the reference replaced by its base where they are no commoner at
    their position than errors explain. Bases other than ACGT stay. The kept bases of each reference position are one
    short array for a reference, written once and joined to its reads: nothing is taken apart and put together again.
    ``aligned`` is read twice, so it should be a table, not the alignment itself."""
    ref = [ref] if isinstance(ref, str) else list(ref)
    aligned = sealed(aligned)
    kept = F.concat(*[F.when(F.col(f"z_{b.lower()}") >= least, b).otherwise("") for b in "ACGT"])
    table = z_scores(position_stats(aligned, ref)).groupBy(*ref).agg(F.map_from_entries(F.collect_list(F.struct("ref_pos", kept.alias("k")))).alias("kept"))
    table = table.select(*ref, F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("kept"))), lambda i: F.coalesce(F.col("kept")[i], F.lit(""))).alias("kept"))
    rows = aligned.join(stage(table, "kept_bases"), ref, "left")

    def fix(c: Column, at: Column) -> Column:
        return (
            F.when((c["r"] == c["b"]) | (c["r"] == "-") | (c["b"] == "-"), c["b"])
            .when(F.instr(F.lit("ACGT"), c["b"]) == 0, c["b"])
            .when(F.instr(F.get(F.col("kept"), _position(at, _start(rows))), c["b"]) > 0, c["b"])
            .otherwise(c["r"])
        )

    cells = F.arrays_zip(S.chars("ref_aln").alias("r"), S.chars("read_aln").alias("b"))
    fixed = F.translate(F.array_join(F.transform(cells, fix), ""), "-", "")
    same = F.col("ref_aln") == F.col("read_aln")
    return unsealed(once(rows, {"seq": F.when(same, F.col("read_aln")).otherwise(fixed)}).drop("kept"))


def reference_records(refs: DataFrame) -> DataFrame:
    """The records of the references themselves, which precede reference-guided output."""
    return refs.select(F.lit("CONSENSUS").alias("title"), F.col("ref").alias("seq"), F.expr("repeat('J', length(ref))").alias("qual"))
