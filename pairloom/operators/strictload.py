"""Problem 5: separate rows that fail to parse, with the reason.

Strict load plus anti-join. A strict pattern, run inside the JVM, loads only lines that certainly conform; their
offsets are subtracted from the raw offsets; what remains is read by a full reader that either names the first
reason for failure or, for unusual lines that conform after all, gives their fields. Both ways together load every
valid line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.steps import once

FIELDS = (
    "job_id", "read_name_first", "forward_primer", "forward_barcode", "readseq_first", "quality_first",
    "read_name_second", "reverse_primer", "reverse_barcode", "readseq_second", "quality_second",
)
REASONS = ("quoting", "field_count", "seq_chars", "qual_chars", "lengths")
#: Longer lines go to the full reader: the JVM's pattern engine recurses on repeated groups.
STRICT_CHARS = 4_000

_QUOTED = r'"[^"]*(?:""[^"]*)*"'
_FIELD = rf'({_QUOTED}|[^",]*)'
_STRICT = "(?s)^" + ",".join([_FIELD] * len(FIELDS)) + r"\z"
_SEQ, _QUAL = r"^[ACGTNacgtn]+\z", r"^[!-J]*\z"


def _unquoted(c: Column) -> Column:
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.when(c.startswith('"'), inner).otherwise(c)


def strict_load(raw: DataFrame, offset: str = "raw_id", line: str = "line") -> DataFrame:
    """Lines that the strict pattern accepts and whose reads and qualities are valid: ``offset`` and the eleven fields."""
    short = raw.where(F.col(offset).isNotNull() & (F.length(line) <= STRICT_CHARS) & F.col(line).rlike(_STRICT))
    # one pass for all fields of a line that conforms; the pattern is not run again for each
    cells = once(short, {"__cells": F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_FIELD + ","), 1)})
    got = once(cells, {c: _unquoted(F.col("__cells")[i]) for i, c in enumerate(FIELDS)}).select(offset, *FIELDS)
    ok = F.lit(True)
    for s, q in (("readseq_first", "quality_first"), ("readseq_second", "quality_second")):
        ok = ok & F.col(s).rlike(_SEQ) & F.col(q).rlike(_QUAL) & (F.length(s) == F.length(q))
    return got.where(ok)


def read_line(text: str | None) -> tuple[list[str], str | None]:
    """Fields and first reason for failure (or None) of one line. A null line is one field too few."""
    if text is None:
        return [], "field_count"
    field = re.compile(r'"([^"]*+(?:""[^"]*+)*+)"|([^",]*+)')
    fields, at = [], 0
    while True:
        m = field.match(text, at)
        quoted = m[1] is not None
        fields.append(m[1].replace('""', '"') if quoted else m[2])
        at = m.end()
        if at == len(text):
            break
        if text[at] != ",":
            return fields, "quoting"
        at += 1
    if len(fields) != len(FIELDS):
        return fields, "field_count"
    pairs = [(fields[4], fields[5]), (fields[9], fields[10])]
    if any(not re.fullmatch("[ACGTNacgtn]+", s) for s, _ in pairs):
        return fields, "seq_chars"
    if any(not re.fullmatch("[!-J]*", q) for _, q in pairs):
        return fields, "qual_chars"
    if any(len(s) != len(q) for s, q in pairs):
        return fields, "lengths"
    return fields, None


def _diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [read_line(x) for x in b.column(1).to_pylist()]
        why = pa.array([r for _, r in got], pa.string())
        cells = [pa.array([f[i] if r is None else None for f, r in got], pa.string()) for i in range(len(FIELDS))]
        yield pa.RecordBatch.from_arrays([b.column(0), why, *cells], ["offset", "reason", *FIELDS])


def diagnosed(raw: DataFrame, offset: str = "raw_id", line: str = "line") -> DataFrame:
    """What strict load leaves over: ``offset``, ``reason`` (null for a line that conforms after all) and the fields."""
    rest = raw.select(offset, line).join(strict_load(raw, offset, line).select(offset), offset, "left_anti")
    schema = f"offset {dict(raw.dtypes)[offset]}, reason string, " + ", ".join(f"{c} string" for c in FIELDS)
    return rest.select(offset, line).mapInArrow(_diagnose, schema).withColumnRenamed("offset", offset)


def rejected(raw: DataFrame, offset: str = "raw_id", line: str = "line") -> DataFrame:
    """``offset``, ``reason``: one row for each line that can't be loaded, with the first reason that applies of
    quoting, field_count, seq_chars, qual_chars, lengths. Null lines fail with field_count, empty lines too (one
    field). ``offset`` must be unique; a line without one is judged by the full reader. Other columns are ignored.
    """
    return diagnosed(raw, offset, line).where("reason is not null").select(offset, "reason")


def loaded(raw: DataFrame, offset: str = "raw_id", line: str = "line") -> DataFrame:
    """All valid lines as ``offset`` and the eleven fields: those of the strict load and the unusual ones."""
    late = diagnosed(raw, offset, line).where("reason is null").select(offset, *FIELDS)
    return strict_load(raw, offset, line).unionByName(late)
