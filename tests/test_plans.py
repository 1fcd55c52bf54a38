"""Plans: expensive steps once, reads placed without shuffles, large groups split."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.config import PipelineConfig
from pairloom.operators import collapse as C
from pairloom.operators import overlap as O
from pairloom.operators import positions
from pairloom.operators import primers as P
from pairloom.operators import reference as R
from pairloom.operators import skew
from pairloom.plans import pipelines

PAIR = "ordinal long, name1 string, seq1 string, qual1 string, seq2 string, qual2 string"
PRIMER = "primer_id int, primer_name string, seq string, primer_role string, orient string, barcode_len int"
PRIMERS = [(1, "V", "ACGTACGTAC", "F", "fwd", 2), (2, "V", "GTACGTACGT", "F", "rc", 2), (3, "C", "TTTTTGGGGG", "R", "fwd", 2), (4, "C", "CCCCCAAAAA", "R", "rc", 2)]
INSERT = "CTTAACGGACCACTCTTCATATCTAATTGCGACAGTGGCTTCTGACACTGCAAGGCACGTACCGATGTGG"


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def nodes(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(rf"{name}.*", plan)


def test_functions_in_python_run_once(spark):
    pairs = spark.createDataFrame([], PAIR)
    merged = O.merge_pairs(pairs, PipelineConfig(local_overlap=True))
    evals = nodes(merged, "ArrowEvalPython")
    assert sum(e.count("longest_common_substring(") for e in evals) == 2 and sum(e.count("realign(") for e in evals) == 1
    found = P.load(spark.createDataFrame(PRIMERS, PRIMER))
    refs = spark.createDataFrame([(1, "r", INSERT)], "ref_id int, ref_name string, ref string")
    made = pipelines.aligned(pairs, found, refs, PipelineConfig(mode="reference"))
    evals = nodes(made, "ArrowEvalPython")
    assert sum(e.count("longest_common_substring(") for e in evals) == 2
    assert len(evals) == 5  # overlap, forward and reverse primers, placement, alignment
    assert not nodes(made.where("ref_id > 0"), "Exchange hash")


def test_pipelines_scan_their_input_once(spark, tmp_path):
    spark.createDataFrame([], PAIR).write.parquet(str(tmp_path / "p"))
    found = P.load(spark.createDataFrame(PRIMERS, PRIMER))
    made = pipelines.referenceless(spark.read.parquet(str(tmp_path / "p")), found, PipelineConfig(barcoded=True, dupcount=True))
    assert not nodes(made, "ArrowEvalPython") and not [x for x in nodes(made, "FileScan") if str(tmp_path) in x]
    assert made.count() == 0


def test_placement_by_table_equals_the_join(spark, monkeypatch):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    refs = [(i, f"r{i}", genome[40 * i : 40 * i + 90]) for i in range(5)] + [(9, "short", "ACG"), (10, "n", "N" * 30)]
    parts = [genome[i : i + 50] for i in range(0, 240, 7)]
    reads = [(n, rc(p) if n % 3 == 0 else p) for n, p in enumerate(parts)] + [(90, "ACG"), (91, ""), (92, None), (93, "N" * 20), (94, "ACGTé" * 9)]
    df = spark.createDataFrame(reads, "ordinal int, seq string")
    table = spark.createDataFrame(refs, "ref_id int, ref_name string, ref string")
    by_table = R.placed(df, table, F.col("seq")).select("ordinal", "ref_id", "strand", "hits")
    rows = sorted(map(tuple, by_table.collect()))
    assert len(rows) == len(parts) and rows == sorted(map(tuple, R.place(df, table, "ordinal", F.col("seq")).collect()))
    monkeypatch.setattr(R, "MAX_REFERENCE", 10)
    assert rows == sorted(map(tuple, R.placed(df, table, F.col("seq")).select("ordinal", "ref_id", "strand", "hits").collect()))
    assert R.placed(df, table.limit(0), F.col("seq")).count() == 0


def test_strand_by_the_window(spark):
    """The first bases decide on the direction, though the whole read shares more with the other."""
    ref = INSERT
    read = "AC" + ref[:36] + rc(ref[:60]) + rc(ref[:60])
    df = spark.createDataFrame([(1, read)], "ordinal int, seq string")
    refs = spark.createDataFrame([(1, "r", ref)], "ref_id int, ref_name string, ref string")
    assert R.placed(df, refs, F.col("seq")).head().strand == "-"
    assert R.placed(df, refs, F.col("seq"), window=40).head().strand == "+"
    assert R.placed(df, refs, F.col("seq"), window=40, first=F.lit(60)).head().strand == "-"


def test_groups_split_over_tasks(spark, monkeypatch):
    """A group of most rows is folded in shards and merged: results are those of one task."""
    rng = random.Random(3)
    rows = [(i, f"t{i}", "hot" if i % 4 else f"k{i % 9}", "".join(rng.choice("ACGT" if rng.random() < 0.1 else "A") for _ in range(6 if i % 5 else 7)), "".join(rng.choice("!+5?I") for _ in range(6 if i % 5 else 7))) for i in range(3000)]
    df = spark.createDataFrame(rows, "ordinal int, title string, key string, seq string, qual string").repartition(5)
    got = {n: sorted(map(tuple, f(df).collect())) for n, f in (("c", lambda d: C.collapse(d, ["key"])), ("s", lambda d: C.consensus(d, ["key"])))}
    assert sum(r[2] for r in got["c"]) == 3000 and Counter(r[0] for r in got["s"])["hot"] == 1
    plans = []
    monkeypatch.setattr(positions, "CELLS", 64)
    monkeypatch.setattr(positions.skew, "plan_shards", lambda *a, f=skew.plan_shards: plans.append(f(*a)) or plans[-1])
    assert got["c"] == sorted(map(tuple, C.collapse(df, ["key"]).collect()))
    assert got["s"] == sorted(map(tuple, C.consensus(df, ["key"]).collect()))
    assert plans[-1].splits
    monkeypatch.setattr(positions, "tasks", lambda _: 1)
    assert got["s"] == sorted(map(tuple, C.consensus(df, ["key"]).collect())) and not plans[-1].splits


def test_collapse_of_odd_reads(spark):
    rows = [(1, "a", None, "ACGT", None), (2, "b", None, "ACGT", "II"), (3, "c", "", "", ""), (4, "d", "", None, "II"), (None, "e", "é", "éN" * 5000, "é" * 10_000)]
    df = spark.createDataFrame(rows, "ordinal int, title string, key string, seq string, qual string")
    got = {(r.key, r.seq): (r.dupcount, r.title, r.qual) for r in C.collapse(df, ["key"]).collect()}
    assert got == {(None, "ACGT"): (2, "a", "55!!"), ("", ""): (1, "c", ""), ("é", "éN" * 5000): (1, "e", "~" * 10_000)}
    assert C.collapse(df.limit(0), ["key"]).count() == 0 and C.consensus(df.limit(0), ["key"]).count() == 0
    assert {r.seq for r in C.consensus(df, ["key"]).collect()} == {"N" * 10_000}


def test_as_many_heavy_keys_as_tasks_can_have(spark):
    bins = 2000
    df = spark.range(300_000).select((F.col("id") % 3000).alias("key"))
    plan = skew.plan_shards(df, ["key"], bins)
    assert len(plan.heavy) == 3000
    loads = plan.loads({k: 100 for k in plan.heavy})
    assert max(loads) <= 2 * 300_000 / bins
    assert skew.plan_counts(df.groupBy("key").count(), ["key"], "count", 300_000, bins).heavy.keys() == plan.heavy.keys()


@pytest.mark.parametrize("name", ["ordinal", "gid"])
def test_clashing_names(spark, name):
    df = spark.createDataFrame([(1, "a", "k", "AC", "II"), (2, "b", "k", "AC", "II")], f"{name if name != 'ordinal' else 'ordinal'} int, title string, key string, seq string, qual string")
    got = C.collapse(df.withColumn("weight", F.lit("x")).withColumn("len", F.lit("y")), ["key"], order=name).head()
    assert (got.dupcount, got.title) == (2, "a")
