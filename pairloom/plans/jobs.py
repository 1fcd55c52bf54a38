"""Running a job file: each job reads its own files, runs the pipeline of the configured mode and writes its output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pairloom.config import PipelineConfig
from pairloom.operators import primers, reference
from pairloom.plans import pipelines
from pairloom.sources import files, sinks
from pairloom.staging import scratch, stage


@dataclass(frozen=True)
class Output:
    """Folders that a job wrote: its records, and in reference mode the SAM lines."""

    job_id: str
    records: str
    sam: str | None = None


def load_primers(spark: SparkSession, job: files.Job) -> primers.Primers:
    """The primers of a job's two files, expanded; ids of the reverse ones follow on."""
    forward = primers.expand(spark, files.read_primers(spark, job.fprimer_path), "F")
    reverse = primers.expand(spark, files.read_primers(spark, job.rprimer_path), "R", first_id=forward.count() + 1)
    return primers.load(forward.unionByName(reverse))


def records(made: DataFrame, config: PipelineConfig) -> DataFrame:
    """The text records of a pipeline's result, by mode and options."""
    fastq = config.output_format == "fastq"
    if config.mode == "barcode_first":
        return sinks.barcode_first(made)
    if not config.barcoded:
        return sinks.collapsed(made, fastq, config.compat)
    return sinks.recollapsed(made, fastq) if config.dupcount else sinks.consensus(made, fastq, config.compat)


def run_job(spark: SparkSession, job: files.Job, config: PipelineConfig) -> Output:
    """Run one job: ``<out_path>/<job_id>_All.fasta`` (or ``.fastq``; barcode-first always ``.fasta``), in reference mode
    with the references' own records first, and ``<job_id>_All.sam``. Each is a folder of text files in order."""
    found, pairs = load_primers(spark, job), files.read_pairs(spark, job.r1_path, job.r2_path)
    kind = "fasta" if config.mode == "barcode_first" else config.output_format
    out, sam = f"{job.out_path.rstrip('/')}/{job.job_id}_All.{kind}", None
    if config.mode == "reference":
        refs = reference.references(files.read_references(spark, job.ref_path))
        sam = f"{job.out_path.rstrip('/')}/{job.job_id}_All.sam"
        rows = stage(pipelines.aligned(pairs, found, refs, config), "aligned")
        sinks.write_lines(sinks.sam_lines(reference.sam(rows, "name"), refs), sam)
        lines = records(pipelines.corrected(rows, config), config)
        lines = sinks.with_references(lines, reference.reference_records(refs), config.output_format == "fastq", config.compat)
    elif config.mode == "barcode_first":
        lines = records(pipelines.barcode_first(pairs, found, config), config)
    else:
        lines = records(pipelines.referenceless(pairs, found, config), config)
    sinks.write_lines(lines, out)
    return Output(job.job_id, out, sam)


def run_jobs(spark: SparkSession, path: str, config: PipelineConfig | None = None) -> Iterator[Output]:
    """Run the jobs of a job file one after the other; each is a distributed run over its own files. A job's ids in the
    file may repeat; outputs of the same name are replaced."""
    for job in files.read_jobs(path):
        with scratch(spark):
            done = run_job(spark, job, config or PipelineConfig())
        yield done
