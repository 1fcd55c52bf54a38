"""Problems 2, 3, 4 and 6 on small tables: brute force, nulls, ties, empty tables, clashing columns."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import distinct, formatting, frequent, survivor

VALUES = "readseq_first string, n_rows int"


def test_frequent_values(spark):
    rng = random.Random(1)
    rows = [(f"v{int(rng.paretovariate(0.7)) % 4000}", 1) for _ in range(30_000)] + [(None, 1)] * 9000 + [("", 2)] * 400
    df = spark.createDataFrame(rows, VALUES)
    want = sorted(Counter(v for v, _ in rows if v is not None).items(), key=lambda x: (-x[1], x[0]))[:20]
    got = frequent.most_frequent(df, "readseq_first").collect()
    assert [(r.readseq_first, r.n_rows) for r in got] == want
    assert all(abs(r.estimate - r.n_rows) < 0.01 * len(rows) for r in got)


def test_frequent_of_few_ties_and_flat(spark):
    few = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("c", 1)], VALUES)
    assert [(r.readseq_first, r.n_rows) for r in frequent.most_frequent(few, "readseq_first").collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert frequent.most_frequent(few.limit(0), "readseq_first").count() == 0
    assert frequent.most_frequent(spark.createDataFrame([(None, 1)], VALUES), "readseq_first").count() == 0
    flat = spark.createDataFrame([(f"{i:05d}", 1) for i in range(20_000)] + [("00007", 1)], VALUES)  # nothing stands out: exact way
    got = frequent.most_frequent(flat, "readseq_first", k=3, width=64).collect()
    assert [(r.readseq_first, r.n_rows) for r in got] == [("00007", 2), ("00000", 1), ("00001", 1)]


def test_hot_value_hides_no_others(spark):
    """One value holds most rows; beside it the others stand out only once it is out of the sketch."""
    df = spark.range(150_000).select(F.when(F.col("id") < 100_000, "hot").when(F.col("id") < 112_000, F.concat(F.lit("w"), (F.col("id") % 8).cast("string"))).otherwise(F.col("id").cast("string")).alias("readseq_first"))
    got = {r.readseq_first: (r.n_rows, r.estimate) for r in frequent.most_frequent(df, "readseq_first", k=9, width=256).collect()}
    assert {v: n for v, (n, _) in got.items()} == {"hot": 100_000} | {f"w{i}": 1500 for i in range(8)}


def test_sketches_add_up(spark):
    df = spark.range(5000).select((F.xxhash64(F.col("id") % 70)).alias("h"))
    a, b = df.limit(2000), df
    both = frequent.sketch(a.unionByName(b), 256)
    assert (both == frequent.sketch(a, 256) + frequent.sketch(b, 256)).all()
    prefix = np.array([df.head().h], np.int64).view(np.uint64)
    assert frequent.estimates(frequent.sketch(df, 4096), prefix, frequent.LEVELS - 1)[0] == pytest.approx(72, abs=40)


PAIRS = "ordinal long, readseq_first string, readseq_second string, root string"


def test_copies(spark):
    rng = random.Random(2)
    base = ["ACGT", "ACGTN", "", "TTGA", None, "ggc"]
    style = lambda s: s if s is None else "".join(rng.choice([c, c.lower(), f" {c}", f"{c}-", c + "é"]) for c in s)
    rows = [(i, style(rng.choice(base)), style(rng.choice(base)), "x") for i in range(400)]
    norm = lambda s: re.sub("[^A-Z]", "", re.sub("[^A-Za-z]", "", s).upper())
    groups = defaultdict(list)
    for o, x, y, _ in rows:
        if x is not None and y is not None:
            groups[tuple(sorted((norm(x), norm(y))))].append(o)
    df = spark.createDataFrame(rows, PAIRS)
    got = {(r.first_ordinal, r.ordinal) for r in formatting.copies(df).collect()}
    assert got == {(min(g), o) for g in groups.values() for o in g if o != min(g)}
    assert {r.first_ordinal: r.n_copies for r in formatting.groups(df).collect()} == {min(g): len(g) for g in groups.values()}
    assert formatting.copies(df.limit(0)).count() == 0


READS = "ordinal long, job_id string, read_name_first string, feed string, received_at timestamp, forward_barcode string, reverse_barcode string, quality_first string, readseq_first string, trust int"


def _reads(spark, rows):
    return spark.createDataFrame(rows, READS)


def _survivors(rows, trust):
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups[r[1], r[2].split(" ")[0]].append(r)
    out = {}
    for g in groups.values():
        if len(g) < 2:
            continue
        best = []
        for field, n in ((5, 14), (6, 12), (7, None)):
            options = []
            for r in g:
                v = r[field]
                if v is None:
                    continue
                if n:
                    v = v.strip().upper()
                    score = n - v.count("N") if re.fullmatch("[ACGTN]{%d}" % n, v) and v != "N" * n else None
                else:
                    score = len(v) if r[8] is not None and re.fullmatch("[!-J]*", v) and len(v) == len(re.findall("[A-Za-z]", r[8])) else None
                if score is not None:
                    options.append((score, trust.get(r[3], -1), r[4] or dt.datetime.min, r[0]))
            best.append(max(options)[3] if options else -1)
        out[min(r[0] for r in g)] = tuple(best)
    return out


def test_survivors(spark):
    rng = random.Random(3)
    trust = {"a": 3, "b": 2, "c": 2, "d": 1}
    day = dt.datetime(2024, 1, 1)
    f = [None, "", "ACGTACGTACGTAC", " acgtacgtacgtac ", "ACGTACGTACGTAN", "N" * 14, "ACGT", "ACGTACGTACGTAX", "TTTTACGTACGTAC"]
    s = [None, "ACGTACGTACGT", "NCGTACGTACGT", "acgtacgtacgt\t", "N" * 12, "A"]
    q = [None, "", "IIII", "IIII K", "III", "IIIII"]
    x = [None, "ACGT", "AC-GT", "ACGTA", ""]
    rows = [
        (i, rng.choice(["j", "k", None]), rng.choice([None, *[f"@{n} {i}" for n in range(60)]]), rng.choice(["a", "b", "c", "d", "zz", None]),
         rng.choice([None, day, day + dt.timedelta(hours=rng.randint(0, 3))]), rng.choice(f), rng.choice(s), rng.choice(q), rng.choice(x), 99)
        for i in range(500)
    ]
    feeds = spark.createDataFrame(list(trust.items()), "feed string, trust int")
    got = {r.first_ordinal: (r.fbc_ordinal, r.rbc_ordinal, r.qual_ordinal) for r in survivor.resolve(_reads(spark, rows), feeds).collect()}
    assert got == _survivors(rows, trust)


def test_survivors_of_nothing(spark):
    feeds = spark.createDataFrame([], "feed string, trust int")
    assert survivor.resolve(_reads(spark, []), feeds).count() == 0
    assert survivor.sources(_reads(spark, [])).count() == 0 and survivor.truths(_reads(spark, [])).count() == 0


def test_sources_are_told_apart(spark):
    """Feeds of known reliability: the model ranks them so, and keeps every value that good feeds state."""
    rng = random.Random(4)
    rows, n, good, bad = [], 0, "A" * 14, "C" * 14
    for cluster in range(300):
        for feed, right in (("a", 0.97), ("b", 0.95), ("c", 0.92), ("d", 0.4)):
            wrong = "".join(rng.choice("CGT") for _ in range(14))
            rows.append((n, "j", f"@{cluster}", feed, None, good if rng.random() < right else wrong, "ACGTACGTACGT", "I", "A", 0))
            n += 1
    rates = {r.feed: (r.sensitivity, r.specificity) for r in survivor.sources(_reads(spark, rows)).where("field = 'forward_barcode'").collect()}
    assert min(rates[x][0] for x in "abc") > rates["d"][0] + 0.3
    assert min(rates[x][1] for x in "abc") > rates["d"][1]
    kept = survivor.truths(_reads(spark, rows)).where("field = 'forward_barcode'")
    assert kept.where(F.col("value") == good).count() > 290 and kept.where(F.col("value") != good).count() < 30
    both = [(n + i, "j", "@two", f, None, v, "ACGTACGTACGT", "I", "A", 0) for i, (f, v) in enumerate((("a", good), ("b", good), ("c", good), ("a", bad), ("b", bad), ("c", bad)))]
    two = survivor.truths(_reads(spark, rows + both)).where(f"field = 'forward_barcode' and first_ordinal = {n}")
    assert {r.value for r in two.collect()} == {good, bad}


def test_likeliest_values_survive(spark):
    """The most trusted feed is often wrong: by the rules its values survive, by the posterior those of the others."""
    rng = random.Random(6)
    rows, good = [], "A" * 14
    for cluster in range(200):
        for feed, right in (("a", 0.97), ("b", 0.95), ("c", 0.93), ("d", 0.4)):
            wrong = "".join(rng.choice("CGT") for _ in range(14))
            rows.append((len(rows), "j", f"@{cluster}", feed, None, good if rng.random() < right else wrong, "ACGTACGTACGT", "I", "A", 0))
    feeds = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 9)], "feed string, trust int")
    value = {r[0]: r[5] for r in rows}
    by_rules = [r.fbc_ordinal for r in survivor.resolve(_reads(spark, rows), feeds).collect()]
    assert all(rows[o][3] == "d" for o in by_rules)
    likely = [r.fbc_ordinal for r in survivor.resolve(_reads(spark, rows), feeds, "posterior").collect()]
    assert len(likely) == 200 and sum(value[o] == good for o in likely) >= 195
    with pytest.raises(ValueError):
        survivor.resolve(_reads(spark, rows), feeds, "chance")


def test_distinct_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "", "hot", "hot", *map(str, range(90))]), rng.choice([None, "d1", "d2"]), rng.choice([None, "j", "k"]), 1) for _ in range(2000)]
    df = spark.createDataFrame(rows, "forward_barcode string, day string, job_id string, n int")
    sets = [["day", "job_id"], ["day"], ["job_id"], []]
    want = defaultdict(set)
    for b, d, j, _ in rows:
        if b is not None:
            for level, key in (("day+job_id", (d, j)), ("day", (d, None)), ("job_id", (None, j)), ("all", (None, None))):
                want[level, *key].add(b)
    got = {(r.level, r.day, r.job_id): r.n_distinct for r in distinct.distinct_counts(df, "forward_barcode", ["day", "job_id"], sets, 16).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    halves = [distinct.pairs(df.where(c), "forward_barcode", ["day", "job_id"], 16) for c in ("day = 'd1'", "day <> 'd1' or day is null")]
    merged = distinct.bucket_counts(distinct.merge(*halves), ["day", "job_id"], sets).groupBy("level", "day", "job_id").agg(F.sum("n").alias("n"))
    assert {(r.level, r.day, r.job_id): r.n for r in merged.collect()} == got
    assert distinct.distinct_counts(df.limit(0), "forward_barcode", ["day", "job_id"], sets).count() == 0
    parts = {(r.level, r.combination): r.n_distinct for r in distinct.distinct_counts(df, "forward_barcode", ["day", "job_id"], [], 16, ["day", "job_id"]).collect()}
    want = Counter()
    for at, level in ((1, "combination of day"), (2, "combination of job_id")):
        of = defaultdict(set)
        for r in rows:
            if r[0] is not None and r[at] is not None:
                of[r[0]].add(r[at])
        want.update((level, ",".join(sorted(v))) for v in of.values())
    assert parts == want


def test_copies_of_a_hot_group(spark, monkeypatch):
    """A group of a third of all rows, a root shared by different structures, and both at once."""
    monkeypatch.setattr(formatting, "leaf", lambda c: F.md5(F.left(c, F.lit(1))))  # digests that collide
    rows = [(i, "ACGT", "gg tt" if i % 2 else "GGTT", "x") for i in range(900)] + [(i, "AAAA" + "CGT"[i % 3], f"G{'ACGT'[i % 4]}{i // 7}", "x") for i in range(900, 2700)]
    groups = defaultdict(list)
    for o, x, y, _ in rows:
        groups[tuple(sorted(re.sub("[^A-Z]", "", v.upper()) for v in (x, y)))].append(o)
    got = {(r.first_ordinal, r.ordinal) for r in formatting.copies(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {(min(g), o) for g in groups.values() for o in g if o != min(g)}
