"""Job files end to end: every mode, format and sink."""

from __future__ import annotations

from pathlib import Path

import pytest

from pairloom.config import PipelineConfig
from pairloom.plans import jobs
from pairloom.sources import files

FP, RP = "AACGTTATAAACGATAGTGT", "TCAACCTAAAAGCAACAG"
INSERT = "CTTAACGGACCACTCTTCATATCTAATTGCGACAGTGGCTTCTGACACTGCAAGGCACGTACCGATGTGG"
OTHER = INSERT[:30] + "A" + INSERT[31:]


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def write(tmp_path, job="J", n=4):
    """The files of a job: n pairs of one insert and one of another, all with the same barcodes."""
    t = [("ACGTACGTACGTAC" + FP + i + rc(RP) + rc("TTGGCCAATTGG")) for i in [INSERT] * n + [OTHER]]
    for name, reads in (("1", t), ("2", [rc(x) for x in t])):
        (tmp_path / f"{job}{name}").write_text("".join(f"@M:1:F:1:1101:{i}:7 {name}\n{x[:100]}\n+\n{'I' * 100}\n" for i, x in enumerate(reads)))
    (tmp_path / "f").write_text(f">V1\n{'N' * 14}{FP}\n")
    (tmp_path / "r").write_text(f">C1\n{'N' * 12}{RP}\n")
    (tmp_path / "ref").write_text(f">r1 x\n{INSERT[:40]}\n{INSERT[40:]}\n")
    lines = "".join(f"{x}\n" for x in (job, *(tmp_path / x for x in ("f", "r", "ref", f"{job}1", f"{job}2")), tmp_path / "out"))
    return lines


def run(spark, tmp_path, **options):
    (tmp_path / "jobs").write_text("header\n# note\n" + write(tmp_path))
    [done] = list(jobs.run_jobs(spark, str(tmp_path / "jobs"), PipelineConfig(**options)))
    return done, text(done.records)


def text(folder):
    """Lines of a folder's files in order of their names."""
    return [x for f in sorted(Path(folder).glob("part-*")) for x in f.read_text().splitlines()]


TAIL = "|VPRIMER=V1|CPRIMER=C1"


def test_referenceless(spark, tmp_path):
    done, lines = run(spark, tmp_path)
    assert done.job_id == "J" and done.sam is None and done.records.endswith("/J_All.fasta")
    assert lines == [f">1101_0_7{TAIL}|DUPCOUNT=4", INSERT, f">1101_4_7{TAIL}|DUPCOUNT=1", OTHER]


def test_consensus_as_fastq(spark, tmp_path):
    _, lines = run(spark, tmp_path, barcoded=True, output_format="fastq", print_barcode=True)
    assert lines[:3] == [f"@1101_0_7{TAIL}|BARCODE=ACGTACGTACGTAC/{rc('TTGGCCAATTGG')}|CONSCOUNT=5", INSERT, "+"] and len(lines[3]) == 70


def test_recollapsed(spark, tmp_path):
    _, lines = run(spark, tmp_path, barcoded=True, dupcount=True)
    assert lines == [f">1101_0_7{TAIL}|DUPCOUNT=1|CONSCOUNT=5", INSERT]


def test_barcode_first(spark, tmp_path):
    done, lines = run(spark, tmp_path, mode="barcode_first", output_format="fastq")
    assert done.records.endswith("/J_All.fasta")
    assert lines[0] == ">1101_0_7|BARCODE=ACGTACGTACGTAC_TTGGCCAATTGG|CONSCOUNT=5" and INSERT in lines[1] and lines[2] == "+"


def test_reference(spark, tmp_path):
    done, lines = run(spark, tmp_path, mode="reference", base_quality=20)
    assert lines[:2] == [">CONSENSUS", INSERT]
    assert lines[2:] == [f">1101_0_7{TAIL}|DUPCOUNT=4|CIGAR=70M", INSERT, f">1101_4_7{TAIL}|DUPCOUNT=1|CIGAR=70M", OTHER]
    sam = text(done.sam)
    assert sam[0] == "@SQ\tSN:r1\tLN:70" and len(sam) == 6
    assert sorted(x.split("\t")[0] for x in sam[1:]) == [f"1101_{i}_7" for i in range(5)] and all(x.split("\t")[5] == "70M" for x in sam[1:])


def test_reference_with_barcodes(spark, tmp_path):
    """Groups are of barcodes, whatever the CIGARs of their reads; the first read's stands in the title."""
    _, lines = run(spark, tmp_path, mode="reference", barcoded=True, output_format="fastq")
    assert lines[:4] == ["@CONSENSUS", INSERT, "+", "J" * 70]
    assert lines[4] == f"@1101_0_7|CIGAR=70M{TAIL}|CONSCOUNT=5" and lines[5] == INSERT and len(lines) == 8


def test_reference_between_primers(spark, tmp_path):
    """Unstripped reads are aligned to the reference between its primers; the alignment is of the body alone. Bases of
    the forward primer count among those of which a share must match: 70 of 90 here."""
    assert not run(spark, tmp_path, mode="reference", barcoded=True, strip=False)[1][2:]
    done, lines = run(spark, tmp_path, mode="reference", barcoded=True, strip=False, base_quality=20, global_identity=75.0)
    assert lines[2] == f">1101_0_7|CIGAR=70M{TAIL}|CONSCOUNT=5" and lines[3] == INSERT
    assert [x.split("\t")[9] for x in text(done.sam) if x.startswith("1101_4_7")] == [OTHER]


def test_slice_of_reads(spark, tmp_path):
    _, lines = run(spark, tmp_path, min_read=1, max_read=3)
    assert lines == [f">1101_1_7{TAIL}|DUPCOUNT=2", INSERT]


def test_several_jobs_and_missing_files(spark, tmp_path):
    (tmp_path / "jobs").write_text("header\n" + write(tmp_path, "A") + write(tmp_path, "B", n=1))
    done = list(jobs.run_jobs(spark, str(tmp_path / "jobs")))
    assert [d.job_id for d in done] == ["A", "B"]
    assert text(done[1].records)[0].endswith("DUPCOUNT=1")
    job = files.Job("X", *["/nowhere"] * 5, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        jobs.run_job(spark, job, PipelineConfig())
