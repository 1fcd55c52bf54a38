"""Options of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    """mode: ``referenceless``, ``reference`` or ``barcode_first``. Thresholds in per cent where named so. Of each job only
    pairs from ``min_read`` on and before ``max_read`` (positions from 0; none: all) are read; ``window`` bases decide on a
    read's direction against its reference."""

    mode: str = "referenceless"
    barcoded: bool = False
    local_overlap: bool = False
    overlap_identity: float = 50.0
    exclude_indels: bool = False
    output_format: str = "fasta"
    print_barcode: bool = False
    strip: bool = True
    dupcount: bool = False
    base_quality: int | None = None
    mean_quality: int = 25
    gap: int = 9
    min_dupcount: int = 0
    min_conscount: int = 0
    adapter1: int = 0
    adapter2: int = 0
    kband: int = 10
    primer_quality: float = 90.0
    subsequence_quality: float = 80.0
    global_identity: float = 85.0
    length_ratio: float = 1.15
    z_threshold: float = 1.645
    kmer: int = 8
    primer_kmer: int = 5
    window: int = 40
    compat: bool = False
    min_read: int = 0
    max_read: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("referenceless", "reference", "barcode_first"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.output_format not in ("fasta", "fastq"):
            raise ValueError(f"unknown output format {self.output_format!r}")
