"""File sources and sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.sources import files, sinks


def fastq(n, start="@"):
    return "".join(f"@r{i}\n{'ACGT'[i % 4] * (i % 7 + 1)}\n+\n{(start + 'IIIIIII')[: i % 7 + 1]}\n" for i in range(n))


def test_fastq_splits_resync(spark, tmp_path):
    path = tmp_path / "a.fastq"
    path.write_text(fastq(200))  # qualities begin with @, as names do
    whole = [tuple(r) for r in files.read_fastq(spark, str(path)).orderBy("ordinal").collect()]
    parts = [tuple(r) for r in files.read_fastq(spark, str(path), split=97).orderBy("ordinal").collect()]
    assert whole == parts and [r[0] for r in whole] == list(range(200))
    assert whole[8] == (8, "@r8", "AA", "@I")


def test_pairs_stop_at_the_shorter_file(spark, tmp_path):
    (tmp_path / "1").write_text(fastq(9))
    (tmp_path / "2").write_text(fastq(5) + "@cut\nACGT\n")
    got = files.read_pairs(spark, str(tmp_path / "1"), str(tmp_path / "2")).collect()
    assert sorted(r.ordinal for r in got) == list(range(5))


def test_empty_fastq(spark, tmp_path):
    (tmp_path / "e").write_text("")
    assert files.read_fastq(spark, str(tmp_path / "e")).count() == 0


def test_fasta(spark, tmp_path):
    (tmp_path / "r").write_text(">ref1 human\nacgt\nAC\n>ref2\nTTTT\n\n>ignored\nA\n")
    assert [tuple(r) for r in files.read_references(spark, str(tmp_path / "r")).collect()] == [(1, "ref1", "ACGTAC"), (2, "ref2", "TTTT")]
    with pytest.raises(FileNotFoundError):
        files.read_primers(spark, str(tmp_path / "missing"))


def test_jobs(tmp_path):
    (tmp_path / "j").write_text("header\n# note\nA\nf\nr\nref\n1\n2\nout\nB\nf\nr\nref\n1\n2\nout/\n\nC\n")
    assert [j.job_id for j in files.read_jobs(str(tmp_path / "j"))] == ["A", "B"]


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([("t", "AC", "II", 3, 1), ("u", "GG", "JJ", 1, 0)], "title string, seq string, qual string, dupcount long, first_ordinal long")
    assert [r.value for r in sinks.collapsed(rows).collect()] == [">u|DUPCOUNT=1\nGG", ">t|DUPCOUNT=3\nAC"]
    assert sinks.collapsed(rows, fastq=True).head().value == "@u|DUPCOUNT=1\nGG\n+\nJJ"
    assert sinks.collapsed(rows, fastq=True, compat=True).head().value.startswith(">u")
    both = sinks.recollapsed(rows.withColumn("conscount", F.lit(9)))
    assert both.head().value == ">u|DUPCOUNT=1|CONSCOUNT=9\nGG"
    sinks.write_lines(sinks.collapsed(rows), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
