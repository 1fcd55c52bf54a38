"""The three pipelines: from read pairs to collapsed reads.

Each job is a run of its own: pairs with a ``job_id`` are collapsed, voted on and corrected within their job, and the
rows returned carry it. Pairs with a null job are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.functions import seq as S
from pairloom.operators import collapse, overlap, primers, reference
from pairloom.operators.steps import JOB, called, once, sealed, unsealed
from pairloom.sources import sinks
from pairloom.staging import stage

KEYS = ["vprimer", "cprimer"]
BARCODE_KEYS = [*KEYS, "fbarcode", "rbarcode"]


def _job(rows: DataFrame) -> list[str]:
    return [JOB] if JOB in rows.columns else []


def prepare(pairs: DataFrame, found: primers.Primers, config: PipelineConfig) -> DataFrame:
    """Pairs (``ordinal``, ``name1``, ``seq1``, ``qual1``, ``seq2``, ``qual2``) merged, turned, annotated and cut. Map
    only: runs on a stream as on a table."""
    rows = _slice(pairs, config).where(F.least(F.length("seq1"), F.length("seq2")) >= max(found.offset("F"), found.offset("R")))
    merged = overlap.merge_pairs(rows, config).select(*[c for c in ("ordinal", "job_id") if c in pairs.columns], S.display_name("name1").alias("name"), "seq", "qual")
    noted = primers.annotate(merged, found, config)
    if config.strip:
        noted = primers.strip(noted)
    elif config.barcoded:
        noted = primers.strip(noted, barcodes_only=True, compat=config.compat)
    return noted.withColumn("title", sinks.title(config.print_barcode))


def _slice(pairs: DataFrame, config: PipelineConfig) -> DataFrame:
    """Pairs between the two positions, if any are named."""
    rows = pairs.where(F.col("ordinal") >= config.min_read) if config.min_read else pairs
    return rows if config.max_read is None else rows.where(F.col("ordinal") < config.max_read)


def _finish(rows: DataFrame, keys: list[str], config: PipelineConfig) -> DataFrame:
    keys = [*_job(rows), *keys]
    if not config.barcoded:
        return collapse.collapse(rows, keys, least=config.min_dupcount)
    made = collapse.consensus(rows, [*keys, "fbarcode", "rbarcode"], least=config.min_conscount, extra=[c for c in ("cigar",) if c in rows.columns])
    if not config.dupcount:
        return made
    again = collapse.recollapse(stage(made, "consensuses"), keys, config.print_barcode)
    return again.where(F.col("dupcount") >= config.min_dupcount)


def referenceless(pairs: DataFrame, found: primers.Primers, config: PipelineConfig | None = None) -> DataFrame:
    """Merge, annotate, strip, filter by mean quality; then collapse, or with ``barcoded`` build consensuses (and with
    ``dupcount`` collapse those). Null or damaged rows are dropped by the filters on the way. Prepared reads are written
    once, as several steps read them."""
    config = config or PipelineConfig()
    rows = collapse.filter_quality(prepare(pairs, found, config), config.mean_quality)
    return _finish(stage(rows.select(*_job(rows), "ordinal", "title", *BARCODE_KEYS, "seq", "qual"), "prepared"), KEYS, config)


def aligned(pairs: DataFrame, found: primers.Primers, refs: DataFrame, config: PipelineConfig) -> DataFrame:
    """Prepared reads with their alignment to the reference that shares most k-mers with them, in the direction that the
    first ``window`` bases behind the forward primer agree with. Without ``strip`` reads are aligned to the
    reference between its primers, and what is beside the reference remains."""
    rows = prepare(pairs, found, config)
    ends = {} if config.strip else {"front": "__front", "back": "__back"}
    if ends:
        rows = once(rows, {"__front": primers.sequence(found, F.col("fprimer_id")), "__back": S.reverse_complement(primers.sequence(found, F.col("rprimer_id")))})
    first = F.length("__front") if ends else F.lit(0)
    rows = reference.turned(reference.placed(rows, refs, F.col("seq"), config.kmer, config.window, first, take=["ref_name", "ref"]))
    rows = reference.banded(rows.drop("strand", "hits"), config, **ends).drop(*ends.values())
    rows = once(rows, {"cigar": S.cigar("ref_aln", "read_aln")})
    if config.barcoded:  # groups are of barcodes alone; the first read's CIGAR stands in the title
        rows = rows.withColumn("title", F.concat("name", F.lit("|CIGAR="), "cigar", sinks.title_tail(config.print_barcode)))
    return rows


def guided(pairs: DataFrame, found: primers.Primers, refs: DataFrame, config: PipelineConfig | None = None) -> DataFrame:
    """Reference-guided: align, then consensus by barcode, correction by base quality, or by z-score; then collapse
    within primers, reference and CIGAR. Alignments are written once, as several steps read them."""
    config = config or PipelineConfig(mode="reference")
    return corrected(stage(aligned(pairs, found, refs, config), "aligned"), config)


def corrected(rows: DataFrame, config: PipelineConfig) -> DataFrame:
    """What :func:`guided` makes of a table of alignments."""
    rows = collapse.filter_quality(rows, config.mean_quality)
    if config.barcoded:
        return _finish(rows, KEYS, config)
    if config.base_quality is not None:
        rows = reference.correct_base(rows, config.base_quality)
    else:
        rows = reference.correct_zscore(rows, [*_job(rows), "ref_id"], least=config.z_threshold)
    return _finish(rows, [*KEYS, "ref_name", "cigar"], config)


def barcode_first(pairs: DataFrame, found: primers.Primers, config: PipelineConfig | None = None) -> DataFrame:
    """Consensus of each side by barcodes first, merged afterwards: ``fbarcode``, ``rbarcode``, ``title``, ``seq``,
    ``qual``, ``conscount`` (of the second reads; with ``compat`` all of them). Both reads need their primer."""
    config = config or PipelineConfig(mode="barcode_first")
    both = overlap.well_formed(overlap.trim_adapters(_slice(pairs, config), config.adapter1, config.adapter2), max(found.offset("F"), found.offset("R")))
    fw, rw = found.of("F", "fwd"), found.of("R", "fwd")
    cut = lambda c, role: F.substring(F.col(c), F.lit(found.min_barcode(role) + 1), F.lit(found.offset(role) - found.min_barcode(role)))
    rows = once(both, {"fx": primers.exact(cut("seq1", "F"), fw), "rx": primers.exact(cut("seq2", "R"), rw), "sf": primers.exact(cut("seq2", "F"), fw), "sr": primers.exact(cut("seq1", "R"), rw)})
    lost = {side: F.col(side).isNull() & F.col("sf").isNull() & F.col("sr").isNull() for side in ("fx", "rx")}
    rows = called(rows, {"fa": primers.approximate(fw, config)(F.when(lost["fx"], cut("seq1", "F"))), "ra": primers.approximate(rw, config)(F.when(lost["rx"], cut("seq2", "R")))})
    straight = F.coalesce("fx", "fa.primer_id").isNotNull() & F.coalesce("rx", "ra.primer_id").isNotNull()
    swapped = ~straight & F.col("sf").isNotNull() & F.col("sr").isNotNull()
    rows = once(rows, {"swapped": swapped, "straight": straight}).where("straight or swapped")
    swapped = F.col("swapped")
    other = {f"{c}{a}": F.when(swapped, F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}")) for c in ("seq", "qual") for a, b in (("1", "2"), ("2", "1"))}
    rows = once(rows, other | {"fid": F.when(swapped, F.col("sf")).otherwise(F.coalesce("fx", "fa.primer_id")), "rid": F.when(swapped, F.col("sr")).otherwise(F.coalesce("rx", "ra.primer_id"))})
    size = lambda c: F.create_map(*[F.lit(v) for p in found.all for v in (p.primer_id, p.barcode_len)])[F.col(c)]
    rows = rows.select(*_job(pairs), "ordinal", S.display_name("name1").alias("title"), F.left(F.col("seq1"), size("fid")).alias("fbarcode"), F.left(F.col("seq2"), size("rid")).alias("rbarcode"), "seq1", "qual1", "seq2", "qual2")
    rows = stage(rows, "barcoded_pairs")
    keys = [*_job(rows), "fbarcode", "rbarcode"]
    one = sealed(collapse.consensus(rows.withColumnsRenamed({"seq1": "seq", "qual1": "qual"}), keys, least=config.min_conscount, shortcut=False))
    two = sealed(collapse.consensus(rows.withColumnsRenamed({"seq2": "seq", "qual2": "qual"}), keys, least=config.min_conscount, shortcut=False))
    second = two.select(*keys, F.col("seq").alias("seq2"), F.col("qual").alias("qual2"), F.col("conscount"))
    sides = one.select(*keys, "title", "first_ordinal", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(second, keys)
    if config.compat:
        sides = sides.drop("conscount").join(sealed(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("conscount")), keys)
    return overlap.merge_pairs(unsealed(sides), config).select(*keys, "title", "first_ordinal", "seq", "qual", "conscount")
