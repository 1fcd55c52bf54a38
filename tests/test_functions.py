"""Scalar functions: goldens, and the merge rule's known values."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import seq as S


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).head()["x"]


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement("s"), s="ACGTN") == "NACGT"
    assert one(spark, S.reverse_complement("s"), s="") == ""
    assert one(spark, S.reverse_complement(S.reverse_complement("s")), s="ACCGTTNAG") == "ACCGTTNAG"


def test_display_name(spark):
    for name, want in (("@M1:2:FC:1:1101:15589:1332 1:N:0", "1101_15589_1332"), ("@read7 x", "read7"), ("@a:b:c:d:1x2", "1_2")):
        assert one(spark, S.display_name("s"), s=name) == want


def test_split_and_expand_primer(spark):
    got = one(spark, S.split_primer("s"), s="NNNNACGR")
    assert (got["barcode_len"], got["primer"]) == (4, "ACGR")
    assert one(spark, S.iupac_expand("s"), s="ACGR") == ["ACGA", "ACGG"]
    assert one(spark, S.iupac_expand("s"), s="ASW") == ["ACA", "ACT", "AGA", "AGT"]
    assert one(spark, S.iupac_expand("s"), s="AX") == []
    plain = one(spark, S.split_primer("s"), s="ACGT")
    assert (plain["barcode_len"], plain["primer"]) == (0, "ACGT")


def test_mean_quality(spark):
    assert one(spark, S.mean_quality("s"), s="!5J") == 20
    assert one(spark, S.mean_quality("s"), s="") is None


def test_merge_rule():
    same = {(10, 10): 15, (30, 10): 33, (25, 3): 20, (0, 7): 7, (9, 0): 9, (41, 41): 41}
    other = {(30, 10): 17, (25, 3): 18, (40, 2): 32, (8, 8): 3, (41, 41): 3, (0, 9): 9}
    assert {k: S.merge_rule(*k, True) for k in same} == same
    assert {k: S.merge_rule(*k, False) for k in other} == other
    assert all(S.merge_rule(x, y, s) == S.merge_rule(y, x, s) for x in range(42) for y in range(42) for s in (True, False))


def test_cigar(spark):
    df = spark.createDataFrame([("AC-GT", "ATCG-"), ("", ""), ("ACG", "ACG")], "r string, q string")
    assert [x.c for x in df.select(S.cigar("r", "q").alias("c")).collect()] == ["2M1I1M1D", "", "3M"]
    ops = df.select(S.cigar_ops(S.cigar("r", "q")).alias("o")).head()["o"]
    assert [(o.n, o.op) for o in ops] == [(2, "M"), (1, "I"), (1, "M"), (1, "D")]


def test_kmers(spark):
    df = spark.createDataFrame([("ACGTA",), ("AC",), (None,)], "s string")
    assert [x.k for x in df.select(S.kmers("s", 3).alias("k")).collect()] == [["ACG", "CGT", "GTA"], [], None]


def test_codes_and_registration(spark):
    df = spark.createDataFrame([("A",), ("T",), ("N",)], "s string")
    assert [x.c for x in df.select(S.base_code("s").alias("c")).collect()] == [0, 3, -1]
    S.register(spark)
    row = spark.sql("select reverse_complement('ACGTN') r, phred('!5J') p, mean_quality('!5J') m").head()
    assert (row.r, row.p, row.m) == ("NACGT", [0, 20, 41], 20)


def test_log_columns(spark):
    df = spark.createDataFrame([(0,), (10,)], "q int")
    rows = df.select(F.round(S.log_quality(F.col("q")), 6).alias("a"), F.round(S.log_error(F.col("q")), 6).alias("b")).collect()
    assert (rows[0].a, rows[0].b) == (0.0, 0.0)
    assert (rows[1].a, rows[1].b) == (-0.045757, -1.477121)
