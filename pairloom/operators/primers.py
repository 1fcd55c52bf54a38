"""Finding primers, turning reads, cutting barcodes.

The primer table (``primer_id``, ``primer_name``, ``seq``, ``primer_role`` F/R, ``orient`` fwd/rc, ``barcode_len``) is a
small dimension; its size is checked where it becomes part of a plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.functions import seq as S
from pairloom.functions.kernels import common_subsequence, common_substring
from pairloom.operators.steps import called, once

#: Most primers that a plan takes in as literals.
MAX_PRIMERS = 5_000


@dataclass(frozen=True)
class Primer:
    primer_id: int
    name: str
    seq: str
    role: str
    orient: str
    barcode_len: int


@dataclass(frozen=True)
class Primers:
    """All primers in order of id, with the lengths that the windows of the search follow from."""

    all: tuple[Primer, ...]

    def of(self, role: str, orient: str) -> list[Primer]:
        return [p for p in self.all if p.role == role and p.orient == orient]

    def offset(self, role: str) -> int:
        return max((len(p.seq) + p.barcode_len for p in self.of(role, "fwd")), default=0)

    def min_barcode(self, role: str) -> int:
        return min((p.barcode_len for p in self.of(role, "fwd")), default=0)


def load(table: DataFrame) -> Primers:
    """The primer table as literals: names without trailing blanks, sequences in upper case. Two primers with the same
    sequence are an error."""
    rows = table.orderBy("primer_id").limit(MAX_PRIMERS + 1).collect()
    if len(rows) > MAX_PRIMERS:
        raise ValueError(f"more than {MAX_PRIMERS} primers")
    found = tuple(Primer(r["primer_id"], r["primer_name"].rstrip(), r["seq"].upper(), r["primer_role"], r["orient"], r["barcode_len"]) for r in rows)
    if len({p.seq for p in found}) < len(found):
        raise ValueError("primers conflict: the same sequence occurs twice")
    return Primers(found)


def expand(spark: SparkSession, lines: DataFrame, role: str, first_id: int = 1) -> DataFrame:
    """The primer table of primer lines (``name``, ``seq`` with leading N for the barcode and IUPAC codes): each
    concrete primer forward and turned, with ids in order."""
    parts = lines.withColumn("p", S.split_primer(F.upper("seq"))).withColumn("line", F.monotonically_increasing_id())
    each = parts.select("line", F.rtrim("name").alias("primer_name"), "p.barcode_len", F.posexplode(S.iupac_expand("p.primer")).alias("n", "seq"))
    turned = F.array(F.struct(F.lit("fwd").alias("orient"), F.col("seq").alias("s")), F.struct(F.lit("rc").alias("orient"), S.reverse_complement("seq").alias("s")))
    rows = each.select("line", "n", "primer_name", "barcode_len", F.posexplode(turned).alias("o", "x")).orderBy("line", "n", "o").collect()
    table = [(first_id + i, r["primer_name"], r["x"]["s"], role, r["x"]["orient"], r["barcode_len"]) for i, r in enumerate(rows)]
    return spark.createDataFrame(table, "primer_id int, primer_name string, seq string, primer_role string, orient string, barcode_len int")


def offsets(table: DataFrame) -> DataFrame:
    """``primer_role``, ``max_offset`` and ``min_barcode``."""
    fwd = table.where("orient = 'fwd'")
    return fwd.groupBy("primer_role").agg(F.max(F.length("seq") + F.col("barcode_len")).alias("max_offset"), F.min("barcode_len").alias("min_barcode"))


def exact(window: Column, found: list[Primer]) -> Column:
    """Id of the primer that the window holds whole: the longest, then the one that starts first, then the lowest id."""
    if not found:
        return F.lit(None).cast("int")
    options = F.array(*[F.struct(F.lit(-len(p.seq)).alias("n"), F.instr(window, F.lit(p.seq)).alias("at"), F.lit(p.primer_id).alias("id")) for p in found])
    return F.array_min(F.filter(options, lambda o: o["at"] > 0))["id"]


def _votes(found: list[Primer], k: int) -> dict[str, np.ndarray]:
    """For each k-mer of the primers, how often each primer holds it."""
    grams = [[p.seq[j : j + k] for j in range(len(p.seq) - k + 1)] for p in found]
    return {g: np.array([each.count(g) for each in grams]) for g in {g for each in grams for g in each}}


def approximate(found: list[Primer], config: PipelineConfig):  # noqa: ANN201
    """Function of a window: the primer it holds approximately, by its longest common substring with any primer, a vote
    of that substring's k-mers, and similarity by substring or subsequence. Null windows give null."""

    @F.pandas_udf("primer_id int, lcs int")
    def search(window: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"primer_id": pd.array([None] * len(window), "Int32"), "lcs": pd.array([0] * len(window), "Int32")}, index=window.index)
        known = window[window.notna()]
        if not len(known) or not found:
            return out
        texts = known.tolist()
        best = np.zeros((len(texts), 2), np.int64)  # length and start of the longest, the first primer's among equals
        for p in found:
            got = common_substring([p.seq] * len(texts), texts)
            longer = got[:, 2] > best[:, 0]
            best[longer] = got[longer][:, [2, 1]]
        k, table, none = config.primer_kmer, _votes(found, config.primer_kmer), np.zeros(len(found), np.int64)
        asked, ids = [], []
        for i, (n, at) in enumerate(best.tolist()):
            votes = sum((table.get(texts[i][j : j + k], none) for j in range(at, at + n - k + 1)), none) if n > k else none
            choice = found[int(votes.argmax())] if votes.any() else None  # the lowest id among equals
            ids.append(choice)
            if choice and 100.0 * n / len(choice.seq) <= config.primer_quality:
                asked.append(i)
        share = common_subsequence([ids[i].seq for i in asked], [texts[i] for i in asked])
        for i, n in zip(asked, share.tolist(), strict=True):
            if 100.0 * n / len(ids[i].seq) <= config.subsequence_quality:
                ids[i] = None
        out.loc[known.index, "primer_id"] = pd.array([p.primer_id if p else None for p in ids], "Int32")
        out.loc[known.index, "lcs"] = pd.array(best[:, 0], "Int32")
        return out

    return search


def _seq_of(id_: Column, found: tuple[Primer, ...], what: str) -> Column:
    value = {"seq": lambda p: p.seq, "name": lambda p: p.name, "barcode_len": lambda p: p.barcode_len}[what]
    return F.create_map(*[F.lit(v) for p in found for v in (p.primer_id, value(p))])[id_]


def sequence(primers: Primers, id_: Column) -> Column:
    """The sequence of a primer's id."""
    return _seq_of(id_, primers.all, "seq")


def forward_window(primers: Primers, role: str = "F") -> Column:
    n = primers.min_barcode(role)
    return F.substring(F.col("seq"), F.lit(n + 1), F.lit(primers.offset(role) - n))


def tail_window(primers: Primers, role: str) -> Column:
    n = primers.offset(role)
    return F.when(F.length("seq") >= n, F.substring(F.col("seq"), F.length("seq") - n + 1, F.lit(n - primers.min_barcode(role))))


def annotate(reads: DataFrame, primers: Primers, config: PipelineConfig | None = None) -> DataFrame:
    """Add ``fprimer_id``, ``rprimer_id`` (ids of forward sequences), ``vprimer``, ``cprimer``, ``fbarcode`` and
    ``rbarcode`` to merged reads (``seq``, ``qual``), turned to the forward direction. Reads without either primer
    are dropped. Reads with whole primers never leave the JVM; only the windows of the others go to Python."""
    config = config or PipelineConfig()
    ids = {(p.role, p.orient): primers.of(p.role, p.orient) for p in primers.all}
    fwd, rc, tail = ids.get(("F", "fwd"), []), ids.get(("F", "rc"), []), ids.get(("R", "rc"), [])
    other = {p.primer_id: q.primer_id for p in primers.all for q in primers.all if p.role == q.role and p.name == q.name and p.orient != q.orient and _rc(p.seq) == q.seq}
    flip = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])

    rows = once(reads, {"fw": forward_window(primers), "bw": tail_window(primers, "F")})
    rows = once(rows, {"f_exact": exact(F.col("fw"), fwd), "b_exact": exact(F.col("bw"), rc)})
    lost = F.col("f_exact").isNull() & F.col("b_exact").isNull()
    rows = once(rows, {"fw": F.when(lost, F.col("fw")), "bw": F.when(lost, F.col("bw"))})
    rows = called(rows, {"fa": approximate(fwd, config)("fw"), "ba": approximate(rc, config)("bw")})
    ahead = F.col("fa.primer_id").isNotNull() & ((F.col("fa.lcs") >= F.col("ba.lcs")) | F.col("ba.primer_id").isNull())
    turned = F.when(F.col("f_exact").isNotNull(), F.lit(False)).when(F.col("b_exact").isNotNull(), F.lit(True)).otherwise(~ahead)
    chosen = F.coalesce("f_exact", flip[F.col("b_exact")], F.when(ahead, F.col("fa.primer_id")).otherwise(flip[F.col("ba.primer_id")]))
    rows = once(rows, {"fprimer_id": chosen, "turned": turned}).where("fprimer_id is not null").drop("fw", "bw", "f_exact", "b_exact", "fa", "ba")
    rows = once(rows, {"seq": F.when(F.col("turned"), S.reverse_complement("seq")).otherwise(F.col("seq")), "qual": F.when(F.col("turned"), F.reverse("qual")).otherwise(F.col("qual"))}).drop("turned")

    rows = once(rows, {"rw": tail_window(primers, "R")})
    rows = once(rows, {"r_exact": exact(F.col("rw"), tail)})
    rows = called(rows, {"ra": approximate(tail, config)(F.when(F.col("r_exact").isNull(), F.col("rw")))})
    rows = once(rows, {"rprimer_id": flip[F.coalesce("r_exact", "ra.primer_id")]}).where("rprimer_id is not null").drop("rw", "r_exact", "ra")
    fl, rl = _seq_of(F.col("fprimer_id"), primers.all, "barcode_len"), _seq_of(F.col("rprimer_id"), primers.all, "barcode_len")
    return once(rows, {
        "vprimer": _seq_of(F.col("fprimer_id"), primers.all, "name"), "cprimer": _seq_of(F.col("rprimer_id"), primers.all, "name"),
        "fbarcode": F.left(F.col("seq"), fl), "rbarcode": F.right(F.col("seq"), rl),
        "flen": F.length(_seq_of(F.col("fprimer_id"), primers.all, "seq")), "rlen": F.length(_seq_of(F.col("rprimer_id"), primers.all, "seq")),
    })


def _rc(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def strip(rows: DataFrame, barcodes_only: bool = False, compat: bool = False) -> DataFrame:
    """Cut barcodes and primers from both ends; reads shorter than the front twice and the back once are dropped (the
    count is part of the result). ``barcodes_only`` leaves the primers; ``compat`` then cuts the back alone by length."""
    front, back = F.length("fbarcode"), F.length("rbarcode")
    if not barcodes_only:
        front, back = front + F.col("flen"), back + F.col("rlen")
        rows = rows.where(F.length("seq") >= 2 * front + back)
    size = F.length("seq") - back - (F.lit(0) if barcodes_only and compat else front)
    return once(rows, {c: F.substring(F.col(c), front + 1, size) for c in ("seq", "qual")})


def votes(reads: DataFrame, primers: DataFrame, key: str, window: Column, k: int = 5) -> DataFrame:
    """``key``, ``primer_id``, ``votes``: of each window the primer that shares most k-mers with it, the lowest id among
    equals. A broadcast join on k-mers; windows without any shared k-mer are left out."""
    index = primers.select("primer_id", F.explode(S.kmers("seq", k)).alias("kmer"))
    if primers.limit(MAX_PRIMERS + 1).count() <= MAX_PRIMERS:
        index = F.broadcast(index)
    hits = reads.select(key, F.explode(S.kmers(window, k)).alias("kmer")).join(index, "kmer").groupBy(key, "primer_id").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct(F.col("votes"), (-F.col("primer_id")).alias("id"))).alias("m")
    return hits.groupBy(key).agg(best).select(key, (-F.col("m.id")).alias("primer_id"), F.col("m.votes").alias("votes"))
