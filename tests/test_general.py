"""Problems 1 and 5 on small tables: skew, nulls, ties, empty tables, extra columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import skew, strictload

READS = "ordinal long, forward_barcode string, reverse_barcode string, readseq_first string"


def reads(spark, rows):
    return spark.createDataFrame(rows, READS)


def test_plan_is_balanced():
    loads = {"hot": 50_000, "warm": 20_000, **{f"k{i}": 300 for i in range(20)}}
    plan = skew.pack(loads, 100_000, 16)
    assert len(plan.heavy["hot"]) > len(plan.heavy["warm"]) > 1
    spread = plan.loads(loads | {f"z{i}": 1 for i in range(24_000)})
    assert max(spread) < 1.5 * 100_000 / 16
    assert skew.pack({}, 0, 1).heavy == {}


def test_barcode_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["AAA", "AAA", "AAA", None, "", "aaa", f"x{i}"]), rng.choice(["CC", "CC", None, f"y{i}"]), None if i % 9 == 0 else "ACGT") for i in range(3000)]
    df = reads(spark, rows).withColumn("n_rows", F.lit("clash"))
    want = {}
    for o, f, r, s in rows:
        for k, ok in ((("forward", f, ""), f is not None), (("reverse", "", r), r is not None), (("pair", f, r), f is not None and r is not None)):
            if ok:
                n, b, lo, hi = want.get(k, (0, 0, o, o))
                want[k] = (n + 1, b + len(s or ""), min(lo, o), max(hi, o))
    got = {(r.key_kind, r.forward_barcode, r.reverse_barcode): (r.n_rows, r.n_bases, r.first_ordinal, r.last_ordinal) for r in skew.barcode_keys(df).collect()}
    assert got == want
    found = {tuple(r) for r in skew.heavy_barcodes(df, 0.2).collect()}
    assert found == {k for k, v in want.items() if v[0] >= 600}


def test_many_tasks_and_replicated_join(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", None if i % 100 == 0 else "r", "A") for i in range(6000)]
    df = reads(spark, rows)
    plan = skew.plan_shards(df, ["forward_barcode"], bins=8)
    assert len(plan.heavy["3:hot"]) > 1
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "forward_barcode string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.fragment_replicate_join(df, right, ["forward_barcode"], "ordinal", how, plan)
        want = df.join(right, "forward_barcode", how).select(*got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    got = skew.per_key(df, ["forward_barcode"], {"n": ("sum", "ordinal")}, "ordinal", plan)
    want = df.groupBy("forward_barcode").agg(F.sum("ordinal").alias("n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(df, right, ["forward_barcode"], "ordinal", "full")


def test_replicated_join_of_nulls_and_clashing_names(spark):
    """Rows without a key are spread over the tasks; names on both sides are told apart."""
    df = reads(spark, [(i, None if i % 3 else "k", None, "A") for i in range(3000)]).withColumn("v", F.lit("left")).withColumn("v_right", F.lit("l"))
    right = spark.createDataFrame([("k", 1, "s")], "forward_barcode string, v int, Readseq_First string")
    plan = skew.plan_shards(df, ["forward_barcode"], bins=8)
    got = skew.fragment_replicate_join(df, right, ["forward_barcode"], "ordinal", "left", plan)
    assert got.columns == [*df.columns, "v_right_right", "Readseq_First_right"]
    assert got.where("v_right_right = 1").count() == 1000 and got.count() == 3000
    bins = skew._place(df, ["forward_barcode"], plan, F.col("ordinal")).where("forward_barcode is null").groupBy(skew.BIN).count().collect()
    assert len(bins) == 8 and max(r["count"] for r in bins) < 600
    both = skew.plan_shards(df, ["forward_barcode", "reverse_barcode"], bins=4)
    assert both.heavy == {} and both.total == 0


def test_empty_keys(spark):
    empty = reads(spark, [])
    assert skew.barcode_keys(empty).count() == 0 and skew.heavy_barcodes(empty).count() == 0
    assert skew.barcode_keys(reads(spark, [(1, None, None, None)])).count() == 0


GOOD = ["j", "@n", "FP", "FB", "ACGTN", "IIIII", "@m", "RP", "RB", "acgtn", "!!!JJ"]


def line(**changes):
    fields = dict(zip(strictload.FIELDS, GOOD, strict=True)) | changes
    return ",".join(fields.values())


CASES = [
    (line(), None), (line(job_id='"j"'), None), (line(quality_first='"I,""II"'), None), (line(forward_primer="", forward_barcode='""'), None),
    (line(read_name_first='"a\nb"'), None), (line(job_id='"open'), "quoting"), (line(job_id='"a"b'), "quoting"), (line(job_id='a"b'), "quoting"),
    (line(job_id=' "a"'), "quoting"), (line() + ",x", "field_count"), ("", "field_count"), (None, "field_count"), ('"', "quoting"),
    (line(readseq_first="", quality_first=""), "seq_chars"), (line(readseq_second="ACGTU"), "seq_chars"), (line(readseq_second="ACGİN"), "seq_chars"),
    (line(quality_first="IIIIK"), "qual_chars"), (line(quality_second="!!!J "), "qual_chars"), (line() + "\r", "qual_chars"),
    (line(quality_second='"!!!JJ"') + "\r", "quoting"), (line(quality_first="IIII"), "lengths"), (line(quality_first=""), "lengths"),
    (line(readseq_first="ACGTX", quality_second="z"), "seq_chars"), (line(readseq_first="A" * 9000, quality_first="I" * 9000), None),
    (line(readseq_first="A" * 30_000, quality_first='"' + '""' * 30_000 + '"'), None),
]


def test_rejected_and_loaded(spark):
    rows = [(i, x, "extra") for i, (x, _) in enumerate(CASES)]
    raw = spark.createDataFrame(rows, "raw_id long, line string, reason string")
    got = {r.raw_id: r.reason for r in strictload.rejected(raw).collect()}
    assert got == {i: why for i, (_, why) in enumerate(CASES) if why}
    kept = {r.raw_id: r for r in strictload.loaded(raw).collect()}
    assert set(kept) == {i for i, (_, why) in enumerate(CASES) if not why}
    assert kept[2].quality_first == 'I,"II' and kept[4].read_name_first == "a\nb" and kept[3].forward_barcode == ""
    assert kept[len(CASES) - 1].quality_first == '"' * 30_000


def test_rejected_of_nothing(spark):
    raw = spark.createDataFrame([], "raw_id long, line string")
    assert strictload.rejected(raw).count() == 0 and strictload.loaded(raw).count() == 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p5_found", "pipeline_referenceless"} <= set(entry.queries())
