"""Reading FASTQ, FASTA and job files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a FASTQ split.
SPLIT = 64 << 20
_BATCH = 10_000


@dataclass
class Split(InputPartition):
    """The records of a file that begin in a byte range."""

    path: str
    number: int
    start: int
    end: int


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _first_record(f: BinaryIO, start: int) -> int:
    """Where the first record at or after ``start`` begins. A line is a record's first if it has ``@`` and the line after
    the next has ``+``: qualities may begin with ``@`` too, but two lines after them stands a sequence."""
    if not start:
        return 0
    f.seek(start - 1)
    f.readline()
    at, lines = f.tell(), []
    while len(lines) < 7 and (line := f.readline()):
        lines.append((at, line))
        at += len(line)
    for (where, line), (_, third) in zip(lines, lines[2:], strict=False):
        if line.startswith(b"@") and third.startswith(b"+"):
            return where
    return at


class FastqReader(DataSourceReader):
    """Splits are byte ranges, found without reading the files; each looks for its own first record. A folder is read
    file by file in order of their names, as Spark writes them."""

    def __init__(self, options: dict) -> None:
        self.path, self.split = _local(options["path"]), int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        files = [self.path]
        if os.path.isdir(self.path):
            files = [os.path.join(self.path, f) for f in sorted(os.listdir(self.path)) if f[0] not in "_."]
        ranges = [(f, at, min(size, at + self.split)) for f in files for size in [os.path.getsize(f)] for at in range(0, max(size, 1), self.split)]
        return [Split(f, n, at, end) for n, (f, at, end) in enumerate(ranges)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        names = ["split", "row", "name", "seq", "qual"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        rows: list[tuple] = []
        with open(split.path, "rb") as f:
            at, n = _first_record(f, split.start), 0
            f.seek(at)
            while at < split.end:
                record = [f.readline() for _ in range(4)]
                at += sum(map(len, record))
                if not record[3]:
                    break  # a cut last record
                name, seq, _, qual = (x.rstrip(b"\r\n").decode("latin-1") for x in record)
                rows.append((split.number, n, name, seq, qual))
                n += 1
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                    rows = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``: split, row in the split, name, seq, qual."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "split int, row long, name string, seq string, qual string"

    def reader(self, schema: object) -> FastqReader:  # noqa: ARG002
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``ordinal`` (from 0, in order of the file), ``name``, ``seq``, ``qual``. Records are counted by split first, so
    ordinals have no gaps; the driver sees one number for each split."""
    spark.dataSource.register(FastqSource)
    rows = spark.read.format("fastq").option("split", split).load(path)
    offsets, total = [], 0
    for number, n in sorted(rows.groupBy("split").count().collect()):
        offsets.append((number, total))
        total += n
    starts = spark.createDataFrame(offsets, "split int, offset long")
    return rows.join(F.broadcast(starts), "split").select((F.col("offset") + F.col("row")).alias("ordinal"), "name", "seq", "qual")


def read_pairs(spark: SparkSession, first: str, second: str, split: int = SPLIT) -> DataFrame:
    """Record i of one file with record i of the other, up to the end of the shorter; names aren't compared."""
    a, b = read_fastq(spark, first, split), read_fastq(spark, second, split)
    one = a.selectExpr("ordinal", "name name1", "upper(seq) seq1", "qual qual1")
    return one.join(b.selectExpr("ordinal", "name name2", "upper(seq) seq2", "qual qual2"), "ordinal")


def _fasta(path: str, upto_space: bool) -> list[tuple[int, str, str]]:
    """Records up to the first blank line. Names without their ``>``."""
    out: list[tuple[int, str, list[str]]] = []
    with open(_local(path), encoding="latin-1") as f:
        for line in f:
            text = line.strip()
            if not text:
                break
            if text[0] == ">":
                out.append((len(out) + 1, text[1:].split(" ")[0] if upto_space else text[1:], []))
            elif out:
                out[-1][2].append(text.upper())
    return [(n, name, "".join(parts)) for n, name, parts in out]


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``ref_id``, ``ref_name``, ``seq`` of a (small) reference FASTA; sequences of several lines are joined."""
    return spark.createDataFrame(_fasta(path, True), "ref_id int, ref_name string, seq string")


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``seq`` of a primer FASTA, in order. A missing file is an error."""
    return spark.createDataFrame([(name, seq) for _, name, seq in _fasta(path, False)], "name string, seq string").coalesce(1)


@dataclass(frozen=True)
class Job:
    job_id: str
    fprimer_path: str
    rprimer_path: str
    ref_path: str
    r1_path: str
    r2_path: str
    out_path: str


def read_jobs(path: str) -> list[Job]:
    """Jobs of a job file: the first line is skipped, lines that begin with # before a job are too; a blank line there
    ends the file; a job is seven lines with something on them."""
    with open(_local(path), encoding="utf-8") as f:
        lines = [x.strip() for x in f][1:]
    jobs, part = [], []
    for line in lines:
        if not part and (line.startswith("#")):
            continue
        if not line:
            if not part:
                break
            continue
        part.append(line)
        if len(part) == 7:
            jobs.append(Job(*part))
            part = []
    if part:
        raise ValueError(f"the last job of {os.path.basename(path)} has {len(part)} of 7 lines")
    return jobs
