"""Merging a read pair where its reads overlap.

Only the search for the longest common substring and the optional local realignment run in Python, on Arrow batches;
everything else is Column expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.config import PipelineConfig
from pairloom.functions import seq as S
from pairloom.functions.kernels import align, common_substring
from pairloom.operators.steps import called, once

# a type object, as a string would need a session on import
_LCS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "len")])


@F.pandas_udf(_LCS)
def longest_common_substring(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Start in x, start in y and length of the longest common substring; null strings count as empty."""
    return pd.DataFrame(common_substring(x.fillna("").tolist(), y.fillna("").tolist()), columns=["x", "y", "len"])


def local_realign(gap: int) -> Column:
    """Function of two windows: both with gaps, aligned locally and padded to cover the whole windows."""

    @F.pandas_udf("ref string, read string")
    def realign(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        keep = x.notna() & y.notna()
        a, b = x[keep].tolist(), y[keep].tolist()
        got = []
        for (_, gx, gy, i0, i1, j0, j1), p, q in zip(align(a, b, gap, None, True), a, b, strict=True):
            lead, tail = min(i0, j0), min(len(p) - i1, len(q) - j1)
            head_x = p[: i0 - lead] + "-" * (j0 - lead) + p[i0 - lead : i0]
            head_y = "-" * (i0 - lead) + q[: j0 - lead] + q[j0 - lead : j0]
            rest_x, rest_y = len(p) - i1 - tail, len(q) - j1 - tail
            got.append((head_x + gx + p[i1:] + "-" * rest_y, head_y + gy + q[j1 : j1 + tail] + "-" * rest_x + q[j1 + tail :]))
        out = pd.DataFrame(None, index=x.index, columns=["ref", "read"], dtype=object)
        out.loc[keep, ["ref", "read"]] = got or None
        return out

    return realign


def well_formed(pairs: DataFrame, offset: int = 0) -> DataFrame:
    """Pairs whose reads have qualities of their own length, legal ones, and at least ``offset`` bases."""
    ok = F.least(F.length("seq1"), F.length("seq2")) >= max(offset, 1)
    for n in "12":
        ok = ok & (F.length(f"seq{n}") == F.length(f"qual{n}")) & F.col(f"qual{n}").rlike(r"^[!-J]*\z")
    return pairs.where(ok)


def trim_adapters(pairs: DataFrame, first: int, second: int) -> DataFrame:
    """Cut that many leading bases from the first and the second reads, and from their qualities."""
    cuts = {f"{c}{n}": F.substring(F.col(f"{c}{n}"), F.lit(k + 1), F.length(f"{c}{n}")) for n, k in (("1", first), ("2", second)) if k for c in ("seq", "qual")}
    return pairs.withColumns(cuts) if cuts else pairs


def orient(pairs: DataFrame) -> DataFrame:
    """Add ``q``, ``qq`` (the second read and its quality, turned where that agrees better with the first), ``ri`` and
    ``qi``, where their longest common substring starts. Ties turn the read; pairs without any common base in one of
    the two directions are dropped."""
    rc = F.col("rc2")
    both = once(pairs, {"rc2": S.reverse_complement("seq2")})
    both = called(both, {"f": longest_common_substring("seq1", "seq2"), "r": longest_common_substring("seq1", "rc2")})
    both = both.where((F.col("f.len") > 0) & (F.col("r.len") > 0))
    turned = F.col("r.len") >= F.col("f.len")
    return once(both, {
        "q": F.when(turned, rc).otherwise(F.col("seq2")), "qq": F.when(turned, F.reverse("qual2")).otherwise(F.col("qual2")),
        "ri": F.when(turned, F.col("r.x")).otherwise(F.col("f.x")), "qi": F.when(turned, F.col("r.y")).otherwise(F.col("f.y")),
    }).drop("f", "r", "rc2")


def window(pairs: DataFrame) -> DataFrame:
    """Add the ungapped overlap: ``ref_start``, ``read_start``, ``overlap`` and both windows with their qualities."""
    sub, add = F.least("ri", "qi"), F.least(F.length("seq1") - F.col("ri"), F.length("q") - F.col("qi"))
    out = once(pairs, {"ref_start": F.col("ri") - sub, "read_start": F.col("qi") - sub, "overlap": sub + add})
    cut = lambda c, at: F.substring(F.col(c), F.col(at) + 1, F.col("overlap"))
    return once(out, {"wx": cut("seq1", "ref_start"), "wxq": cut("qual1", "ref_start"), "wy": cut("q", "read_start"), "wyq": cut("qq", "read_start")})


def identity(x: str = "wx", y: str = "wy") -> Column:
    """Per cent of equal characters of two windows of the same length."""
    same = F.aggregate(F.zip_with(S.chars(x), S.chars(y), lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, n: acc + n)
    return 100.0 * same / F.length(x)


def _with_gaps(qual: str, gapped: Column) -> Column:
    """Qualities spread over a gapped string, ``!`` at gaps."""
    step = lambda acc, c: F.when(
        c == "-", F.struct(F.concat(acc["out"], F.lit("!")).alias("out"), acc["at"].alias("at"))
    ).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col(qual), acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")))
    return F.aggregate(S.chars(gapped), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: acc["out"])


def realign(pairs: DataFrame, config: PipelineConfig) -> DataFrame:
    """Replace windows of poor identity by their padded local alignment. Only those go to Python."""
    poor = identity() < config.overlap_identity
    asked = called(once(pairs, {"poor": poor}), {"re": local_realign(config.gap)(F.when(F.col("poor"), F.col("wx")), F.when(F.col("poor"), F.col("wy")))})
    new = {"wx": F.col("re.ref"), "wxq": _with_gaps("wxq", F.col("re.ref")), "wy": F.col("re.read"), "wyq": _with_gaps("wyq", F.col("re.read"))}
    return once(asked, {c: F.when(F.col("poor"), e).otherwise(F.col(c)) for c, e in new.items()}).drop("poor", "re")


def merged_bases(x: str = "wx", xq: str = "wxq", y: str = "wy", yq: str = "wyq") -> Column:
    """Array of structs ``b``, ``q`` of the merged overlap; a gap counts as N of quality 0. Null if any position has
    N in both reads."""
    base = lambda c: S.chars(F.translate(F.col(c), "-", "N"))
    left = F.zip_with(base(x), S.phred(xq), lambda b, q: F.struct(b.alias("b"), q.alias("q")))
    right = F.zip_with(base(y), S.phred(yq), lambda b, q: F.struct(b.alias("b"), q.alias("q")))

    def merge(m: Column, n: Column) -> Column:
        bx, qx, by, qy = m["b"], m["q"], n["b"], n["q"]
        pick = lambda b, q: F.struct(b.alias("b"), q.alias("q"))
        return (
            F.when(bx == "N", n).when(by == "N", m)
            .when(bx == by, pick(bx, S.match_quality(qx, qy)))
            .when(qx > qy, pick(bx, S.mismatch_quality(qx, qy)))
            .when(qx < qy, pick(by, S.mismatch_quality(qx, qy)))
            .otherwise(pick(F.greatest(bx, by), qx))
        )

    hidden = F.zip_with(base(x), base(y), lambda a, b: (a == "N") & (b == "N"))
    return F.when(~F.exists(hidden, lambda h: h), F.zip_with(left, right, merge))


def stitch(pairs: DataFrame) -> DataFrame:
    """``seq`` and ``qual`` of the merged pair: what precedes the overlap in the read that starts first, the merged
    overlap, and what follows it in the other. A read inside the other loses its overhang. Pairs without a merged
    base somewhere are dropped."""
    done = once(pairs, {"m": merged_bases()}).where("m is not null")
    mid = {"seq": F.array_join(F.transform("m", lambda v: v["b"]), ""), "qual": F.array_join(F.transform("m", lambda v: S.phred_char(v["q"])), "")}
    done = once(done, {f"m_{c}": e for c, e in mid.items()})
    starts = F.col("ref_start") >= F.col("read_start")
    out = {}
    for c, one, two in (("seq", "seq1", "q"), ("qual", "qual1", "qq")):
        a = F.concat(F.left(F.col(one), F.col("ref_start")), F.col(f"m_{c}"), F.substring(F.col(two), F.col("read_start") + F.col("overlap") + 1, F.length(two)))
        b = F.concat(F.left(F.col(two), F.col("read_start")), F.col(f"m_{c}"), F.substring(F.col(one), F.col("ref_start") + F.col("overlap") + 1, F.length(one)))
        out[c] = F.when(starts, a).otherwise(b)
    return once(done, out).drop("m", "m_seq", "m_qual")


def merge_pairs(pairs: DataFrame, config: PipelineConfig | None = None) -> DataFrame:
    """Pairs (``seq1``, ``qual1``, ``seq2``, ``qual2`` and any other columns) with the merged ``seq`` and ``qual``.
    No shuffle. Pairs with null or empty reads, bad qualities or an undecidable base are dropped."""
    config = config or PipelineConfig()
    cut = trim_adapters(pairs, config.adapter1, config.adapter2)
    found = window(orient(well_formed(cut)))
    if config.local_overlap:
        found = realign(found, config)
    return stitch(found).drop("q", "qq", "ri", "qi", "ref_start", "read_start", "overlap", "wx", "wxq", "wy", "wyq")
