"""Read operators on small tables: known results and invariants."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.operators import collapse as C
from pairloom.operators import overlap as O
from pairloom.operators import primers as P
from pairloom.operators import reference as R
from pairloom.plans import pipelines
from pairloom.streaming import prepare as stream

PAIR = "ordinal long, name1 string, seq1 string, qual1 string, seq2 string, qual2 string"
FP, RP = "AACGTTATAAACGATAGTGT", "TCAACCTAAAAGCAACAG"


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def template(insert, fbc="ACGTACGTACGTAC", rbc="TTGGCCAATTGG"):
    return fbc + FP + insert + rc(RP) + rc(rbc)


INSERT = "CTTAACGGACCACTCTTCATATCTAATTGCGACAGTGGCTTCTGACACTGCAAGGCACGTACCGATGTGG"
INSERT2 = "GTACTCGGTTAGGCGGAGTTTGGTGGTCTTAAAGACTCTTGTTCTATTAGTTCAAAGTTAGTTTCTCGAC"


def pair(n, t, size=100, q="I"):
    return (n, f"@M:1:F:1:1101:{n}:7 1", t[:size], q * size, rc(t)[:size], q * size)


@pytest.fixture(scope="module")
def primer_table(spark):
    rows = [(1, "V1", FP, "F", "fwd", 14), (2, "V1", rc(FP), "F", "rc", 14), (3, "C1 ", RP, "R", "fwd", 12), (4, "C1 ", rc(RP), "R", "rc", 12)]
    return spark.createDataFrame(rows, "primer_id int, primer_name string, seq string, primer_role string, orient string, barcode_len int")


def test_merging_halves_gives_the_template(spark):
    t = template(INSERT)
    rows = [pair(1, t), (2, "@x", None, None, "ACGT", "IIII"), (3, "@y", "ACGT", "III", "ACGT", "IIII"), (4, "@z", "", "", "", "")]
    got = O.merge_pairs(spark.createDataFrame(rows, PAIR)).collect()
    assert [(r.ordinal, r.seq, len(r.qual)) for r in got] == [(1, t, len(t))]


def test_merge_rules(spark):
    rows = [("A", "?", "A", "+"), ("A", "?", "C", "+"), ("A", "?", "C", "?"), ("N", "#", "C", "+"), ("N", "!", "N", "!"), ("-", "!", "G", "5")]
    df = spark.createDataFrame(rows, "wx string, wxq string, wy string, wyq string").select(O.merged_bases().alias("m"))
    got = [None if r.m is None else (r.m[0].b, r.m[0].q) for r in df.collect()]
    assert got == [("A", 33), ("A", 17), ("C", 30), ("C", 10), None, ("G", 20)]


def test_local_realignment_covers_the_window(spark):
    x, y = "ACGTTGCAAGGTCCATT", "TTACGTGCAAGGTACCA"
    df = spark.createDataFrame([(x, "I" * 17, y, "5" * 17)], "wx string, wxq string, wy string, wyq string")
    r = O.realign(df, PipelineConfig(overlap_identity=101.0)).head()
    assert len(r.wx) == len(r.wy) == len(r.wxq) == len(r.wyq)
    assert r.wx.replace("-", "") == x and r.wy.replace("-", "") == y
    assert r.wxq.replace("!", "") == "I" * 17


def test_annotation_turns_reads_and_tolerates_errors(spark, primer_table):
    found = P.load(primer_table)
    t = template(INSERT)
    damaged = t[:20] + ("A" if t[20] != "A" else "C") + t[21:]
    rows = [(1, t, "I" * len(t)), (2, rc(t), "I" * len(t)), (3, damaged, "I" * len(t)), (4, INSERT + INSERT2, "I" * 140), (5, "ACG", "III")]
    got = {r.ordinal: r for r in P.annotate(spark.createDataFrame(rows, "ordinal int, seq string, qual string"), found).collect()}
    assert set(got) == {1, 2, 3}
    assert all((r.vprimer, r.cprimer, r.fbarcode) == ("V1", "C1", t[:14]) for r in got.values())
    assert got[2].seq == t and got[3].seq == damaged
    cut = P.strip(P.annotate(spark.createDataFrame(rows[:1], "ordinal int, seq string, qual string"), found)).head()
    assert cut.seq == INSERT and len(cut.qual) == len(INSERT)


def test_conflicting_primers(spark, primer_table):
    with pytest.raises(ValueError, match="conflict"):
        P.load(primer_table.unionByName(primer_table.where("primer_id = 1").withColumn("primer_id", F.lit(9))))


def test_expand_primer_lines(spark):
    lines = spark.createDataFrame([("V1 ", "NNNNACGR"), ("V2", "TTTT")], "name string, seq string").coalesce(1)
    rows = [tuple(r) for r in P.expand(spark, lines, "F").orderBy("primer_id").collect()]
    assert rows == [
        (1, "V1", "ACGA", "F", "fwd", 4), (2, "V1", "TCGT", "F", "rc", 4), (3, "V1", "ACGG", "F", "fwd", 4), (4, "V1", "CCGT", "F", "rc", 4),
        (5, "V2", "TTTT", "F", "fwd", 0), (6, "V2", "AAAA", "F", "rc", 0),
    ]


def test_collapse_rounds_halves_to_even_and_keeps_counts(spark):
    rows = [(2, "b", "k", "AC", "##"), (1, "a", "k", "AC", "$#"), (3, "c", "k", "AG", "II"), (4, "d", "other", "AC", "II"), (5, "e", None, "", "")]
    got = C.collapse(spark.createDataFrame(rows, "ordinal int, title string, key string, seq string, qual string"), ["key"]).collect()
    by = {(r.key, r.seq): r for r in got}
    assert by["k", "AC"].dupcount == 2 and by["k", "AC"].title == "a" and by["k", "AC"].qual == "##"  # 2.5 -> 2
    assert sum(r.dupcount for r in got) == len(rows)


def test_consensus(spark):
    rows = [(i, f"t{i}", "k", "ACGT", "IIII") for i in range(5)] + [(9, "t9", "k", "ACG", "III")]
    got = C.consensus(spark.createDataFrame(rows, "ordinal int, title string, key string, seq string, qual string"), ["key"]).collect()
    assert [(r.seq, r.conscount, r.title) for r in got] == [("ACGT", 5, "t0")]
    rows = [(1, "x", "k", "A", "+"), (2, "y", "k", "C", "?"), (3, "z", "k", "A", "+")]
    r = C.consensus(spark.createDataFrame(rows, "ordinal int, title string, key string, seq string, qual string"), ["key"]).head()
    lq, le = (lambda q: math.log10(1 - 10 ** (-q / 10))), (lambda q: math.log10(10 ** (-q / 10) / 3))
    like = {b: sum(lq(q) if b == x else le(q) for x, q in (("A", 10), ("C", 30), ("A", 10))) for b in "ACGT"}
    p = max(10 ** like[b] for b in "AC") / sum(10**v for v in like.values())
    assert r.seq == max("AC", key=like.get)
    assert ord(r.qual) - 33 == int(-10 * math.log10(max(0.000079, 1 - p)) + 0.5)


def test_modal_length_ties_go_to_the_longer(spark):
    rows = [("k", "AC"), ("k", "ACG"), ("j", "A")]
    got = {r.key: (r.len, r.n) for r in C.modal_length(spark.createDataFrame(rows, "key string, seq string"), ["key"]).collect()}
    assert got == {"k": (3, 1), "j": (1, 1)}


def test_recollapse_weighs_by_reads(spark):
    rows = [("v", "f1", "r1", "AC", "++", 3, "x", 1), ("v", "f2", "r2", "AC", "??", 1, "y", 2)]
    df = spark.createDataFrame(rows, "vprimer string, fbarcode string, rbarcode string, seq string, qual string, conscount long, title string, first_ordinal long")
    r = C.recollapse(df, ["vprimer"], barcodes=True).head()
    assert (r.dupcount, r.conscount, r.title, r.qual, r.barcodes) == (2, 4, "x", "00", "f1_r1,f2_r2")


def test_corrections(spark):
    ref, n = "ACGTACGT", 40
    reads = [(i, 1, ref, "I" * 8) for i in range(n)] + [(n, 1, "ACGAACGT", "III#IIII"), (n + 1, 1, "ACGNACGT", "III!IIII")]
    df = spark.createDataFrame(reads, "ordinal int, ref_id int, read_aln string, qual string").withColumn("ref_aln", F.lit(ref))
    stats = {r.ref_pos: r for r in R.position_stats(df).collect()}
    assert stats[3].n_t == n and stats[3].n_a == 1 and stats[3].n == n + 2
    by = {r.ordinal: r.seq for r in R.correct_base(df, 30).collect()}
    assert by[n] == ref and by[n + 1] == ref
    z = {r.ordinal: r.seq for r in R.correct_zscore(df).collect()}
    assert z[n + 1] == "ACGNACGT"  # not one of ACGT: never changed
    mu = sum(10 ** (-q / 10) for q in [40] * n + [2, 0])
    sd = math.sqrt(sum(10 ** (-q / 10) * (1 - 10 ** (-q / 10)) for q in [40] * n + [2, 0]))
    assert z[n] == (ref if (1 + 0.5 - mu / 3) / (sd / math.sqrt(3)) < 1.645 else "ACGAACGT")


def test_corrections_with_gaps(spark):
    rows = [(1, 1, "AC-GT", "ATCG-", "I5I5")]
    df = spark.createDataFrame(rows, "ordinal int, ref_id int, ref_aln string, read_aln string, qual string")
    assert R.correct_base(df, 30).head().seq == "ACCG"
    assert {r.ref_pos for r in R.position_stats(df).collect()} == {0, 1, 2}


def test_banded_alignment_and_sam(spark):
    ref = INSERT
    read = ref[:30] + ref[31:] + "A"
    rows = [(1, "t", ref, "I" * 70, "r"), (2, "t", read, "I" * 70, "r"), (3, "t", ref[:20], "I" * 20, "r"), (4, "t", INSERT2, "I" * 70, "r")]
    df = spark.createDataFrame(rows, "ordinal int, title string, seq string, qual string, ref_name string").withColumn("ref", F.lit(ref))
    got = {r.ordinal: r for r in R.banded(df).collect()}
    assert 1 in got and 3 not in got and 4 not in got
    assert got[1].matches == 70 and got[1].gaps == 0
    assert all(r.ref_aln.replace("-", "") == ref and r.read_aln.replace("-", "") == r.seq for r in got.values())
    lines = R.sam(R.banded(df)).collect()
    for r in lines:
        ops = [(int(n), o) for n, o in __import__("re").findall(r"(\d+)([MID])", r.cigar)]
        assert sum(n for n, o in ops if o in "MI") == len(r.seq) and sum(n for n, o in ops if o in "MD") == 70


def test_pipelines(spark, primer_table):
    found = P.load(primer_table)
    rows = [pair(i, template(INSERT)) for i in range(4)] + [pair(10 + i, template(INSERT2, "TTTTCCCCAAAAGG", "AAAACCCCGGGG")) for i in range(3)]
    rows += [(99, None, None, None, None, None)]
    df = spark.createDataFrame(rows, PAIR)
    got = pipelines.referenceless(df, found).collect()
    assert {r.seq: r.dupcount for r in got} == {INSERT: 4, INSERT2: 3}
    assert {r.title for r in got} == {"1101_0_7|VPRIMER=V1|CPRIMER=C1", "1101_10_7|VPRIMER=V1|CPRIMER=C1"}
    cons = pipelines.referenceless(df, found, PipelineConfig(barcoded=True, dupcount=True)).collect()
    assert {r.seq: (r.dupcount, r.conscount) for r in cons} == {INSERT: (1, 4), INSERT2: (1, 3)}
    first = pipelines.barcode_first(df, found).collect()
    assert {r.fbarcode: r.conscount for r in first} == {"ACGTACGTACGTAC": 4, "TTTTCCCCAAAAGG": 3}
    assert all(r.seq in (template(INSERT), template(INSERT2, "TTTTCCCCAAAAGG", "AAAACCCCGGGG")) for r in first)
    refs = spark.createDataFrame([(1, "r1", INSERT), (2, "r2", INSERT2)], "ref_id int, ref_name string, ref string")
    guided = pipelines.guided(df, found, refs).collect()
    assert Counter({r.ref_name: r.dupcount for r in guided}) == Counter({"r1": 4, "r2": 3})
    assert {r.cigar for r in guided} == {"70M"}
    assert pipelines.referenceless(df.limit(0), found).count() == 0


def test_preparation_on_a_stream(spark, primer_table, tmp_path):
    found = P.load(primer_table)
    df = spark.createDataFrame([pair(i, template(INSERT)) for i in range(6)], PAIR)
    df.write.parquet(str(tmp_path / "in"))
    out = stream.prepared(stream.read_stream(spark, str(tmp_path / "in"), df.schema), found)
    q = out.writeStream.format("memory").queryName("prepared").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.seq for r in spark.sql("select seq from prepared").collect()] == [INSERT] * 6


def test_streamed_first_deliveries(spark, tmp_path):
    rows = [(1, "j", "@a 1", "2024-01-01 00:00:00"), (2, "j", "@a 2", "2024-01-01 00:05:00"), (3, "k", "@a 1", "2024-01-01 00:06:00"), (4, None, "@a", "2024-01-01 00:07:00")]
    df = spark.createDataFrame(rows, "ordinal long, job_id string, read_name_first string, t string").withColumn("received_at", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = stream.first_deliveries(stream.read_stream(spark, str(tmp_path / "in"), df.schema))
    q = out.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.job_id, r.cluster) for r in spark.sql("select * from firsts").collect()) == [("j", "@a"), ("k", "@a")]


def test_streamed_window_counts(spark, tmp_path):
    """Rows count in the hour they belong to; what arrives later than the watermark allows is left out."""
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00"), (None, "2024-01-01 00:20:00")]
    late = [("a", "2024-01-03 12:00:00"), ("a", "2024-01-01 00:05:00")]
    schema = "forward_barcode string, t string"
    for n, part in enumerate((rows, late[:1], late[1:], [("z", "2024-01-05 00:00:00")])):
        df = spark.createDataFrame(part, schema).select("forward_barcode", F.to_timestamp("t").alias("received_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not n:
            out = stream.window_counts(stream.read_stream(spark, str(tmp_path / "in"), df.schema), ["forward_barcode"])
            q = out.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    got = {(r.forward_barcode, str(r.window.start)): r.n_rows for r in spark.sql("select * from counts").collect()}
    assert got == {("a", "2024-01-01 00:00:00"): 2, (None, "2024-01-01 00:00:00"): 1, ("b", "2024-01-01 01:00:00"): 1, ("a", "2024-01-03 12:00:00"): 1}


def test_fastq_folder(spark, tmp_path):
    from pairloom.sources import files

    for n in range(3):
        (tmp_path / f"part-{n}").write_text("".join(f"@{n}.{i}\nACGT\n+\n@II+\n" for i in range(5)))
    (tmp_path / "_SUCCESS").write_text("")
    got = files.read_fastq(spark, str(tmp_path), split=40).orderBy("ordinal").collect()
    assert [r.name for r in got] == [f"@{n}.{i}" for n in range(3) for i in range(5)] and [r.ordinal for r in got] == list(range(15))


def test_scratch_tables_are_deleted(spark):
    import os

    from pairloom import staging

    kept = staging.stage(spark.range(3), "kept")
    with staging.scratch(spark):
        gone = staging.stage(spark.range(3), "gone")
        assert gone.count() == 3
    assert kept.count() == 3 and not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
