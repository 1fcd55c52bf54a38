"""Registered queries do the whole job: small tables against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from pairloom.config import PipelineConfig
from pairloom.operators import primers as P
from pairloom.functions.seq import merge_rule
from pairloom.plans import pipelines
from pairloom.plans.catalogue import QUERIES

READ_PAIR = (
    "ordinal long, job_id string, read_name_first string, readseq_first string, quality_first string, readseq_second string, quality_second string, "
    "forward_primer string, reverse_primer string, forward_barcode string, reverse_barcode string"
)


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def row(n, seq1, qual1, seq2, qual2, job="j", primers=("V1", "C1"), barcodes=("AA", "CC")):
    return (n, job, f"@M:1:F:1:1101:{n}:7 1", seq1, qual1, seq2, qual2, *primers, *barcodes)


def folder(spark, tmp_path, rows, **tables):
    spark.createDataFrame(rows, READ_PAIR).write.parquet(str(tmp_path / "read_pair.parquet"))
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def lcs(x, y):
    """Length and all starts of the longest common substring."""
    n, places = 0, []
    for i in range(len(x)):
        for j in range(len(y)):
            k = 0
            while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                k += 1
            if k > n:
                n, places = k, []
            if k == n:
                places.append((i, j))
    return n, places


def overlapping(rng):
    """Pairs with clean overlaps, with a wrong base or N among the first bases of the turned second read, unturned."""
    made = []
    for n in range(12):
        t = bases(rng, 70)
        one, two = t[:50], t[25:]
        q1, q2 = ("".join(chr(33 + rng.randrange(2, 41)) for _ in range(k)) for k in (50, 45))
        if n % 3 == 1:
            two = two[:5] + ("N" if n % 2 else "ACGT"["CGTA".index(two[5])]) + two[6:]
        made.append((n, one, q1, two, q2) if n % 3 == 2 else (n, one, q1, rc(two), q2[::-1]))
    return made


def test_overlap_of_all_pairs(spark, tmp_path):
    made = overlapping(random.Random(3))
    at = folder(spark, tmp_path, [row(*p) for p in made] + [row(90, None, None, "AC", "II"), row(91, "ACG", "II", "ACG", "III")])
    windows, same, merged, whole, seen = {}, {}, {}, {}, Counter()
    for n, one, q1, second, q2 in made:
        turned = lcs(one, rc(second)) if lcs(one, rc(second))[0] >= lcs(one, second)[0] else None
        two, qq = (rc(second), q2[::-1]) if turned else (second, q2)
        [(i, j)] = lcs(one, two)[1]
        sub, add = min(i, j), min(len(one) - i, len(two) - j)
        a, b, k = i - sub, j - sub, sub + add
        windows[n] = (a, b, k)
        x, y = one[a : a + k], two[b : b + k]
        seen.update((ord(u) - 33, ord(v) - 33) for u, v in zip(q1[a : a + k], qq[b : b + k]))
        same[n] = round(100 * sum(p == q for p, q in zip(x, y)) / k, 6)
        out = []
        for p, q, u, v in zip(x, y, q1[a : a + k], qq[b : b + k]):
            u, v = ord(u) - 33, ord(v) - 33
            if "N" in (p, q):
                out.append((q, v) if p == "N" else (p, u))
            elif p != q and u == v:
                out.append((max(p, q), u))
            else:
                out.append((p if u >= v else q, merge_rule(u, v, p == q)))
        merged[n] = ("".join(p for p, _ in out), "".join(chr(33 + q) for _, q in out))
        head, tail = ((one, q1), (two, qq)) if a >= b else ((two, qq), (one, q1))
        lead, rest = max(a, b), (b if a >= b else a) + k
        whole[n] = tuple(h[:lead] + m + s[rest:] for h, m, s in zip(head, merged[n], tail))
    assert len(windows) == len(made) and sum(v < 100 for v in same.values()) >= 4
    got = lambda name: {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, at).collect()}
    assert got("overlap_window") == windows
    assert got("overlap_identity") == {n: (v,) for n, v in same.items()}
    assert got("merge_bases") == merged
    assert got("stitch") == whole
    table = QUERIES["quality_merge_lut"](spark, at).collect()
    assert {(r.x, r.y): (r.n, r.same, r.other) for r in table} == {v: (n, merge_rule(*v, True), merge_rule(*v, False)) for v, n in seen.items()}
    assert len(table) == len(seen) > 100


INSERT = "CTTAACGGACCACTCTTCATATCTAATTGCGACAGTGGCTTCTGACACTGCAAGGCACGTACCGATGTGG"
FP, RP = "AACGTTATAAACGATAGTGT", "TCAACCTAAAAGCAACAG"
PRIMERS = (
    [(1, "V1", FP, "F", "fwd", 14), (2, "V1", rc(FP), "F", "rc", 14), (3, "C1", RP, "R", "fwd", 12), (4, "C1", rc(RP), "R", "rc", 12)],
    "primer_id int, primer_name string, seq string, primer_role string, orient string, barcode_len int",
)


def of_jobs(rng):
    """Reads of the same primers and barcodes in three jobs (one of them null), with errors."""
    insert, made = bases(rng, 70), []
    t = "ACGTACGTACGTAC" + FP + insert + rc(RP) + rc("TTGGCCAATTGG")
    for n in range(18):
        x = list(t)
        if n % 4 == 0:
            x[60] = "ACGT"["CGTA".index(x[60])]
        x, q = "".join(x), "".join(rng.choice("5?I") for _ in range(90))
        made.append(row(n, x[:90], q, rc(x)[:90], q, (None, "a", "b")[n % 3], barcodes=("ACGTACGTACGTAC", "TTGGCCAATTGG")))
    return made, insert


def plain(rows, drop=("job_id",)):
    return sorted(tuple(sorted((k, str(v)) for k, v in r.asDict().items() if k not in drop)) for r in rows)


@pytest.mark.parametrize("name", ["collapse", "modal_length", "consensus", "recollapse", "totals"])
def test_groups_stay_within_jobs(spark, tmp_path, name):
    """As if each job had been run alone."""
    made, _ = of_jobs(random.Random(4))
    got = QUERIES[f"{name}_by_job"](spark, folder(spark, tmp_path / "all", made, primers=PRIMERS)).collect()
    for job in (None, "a", "b"):
        alone = QUERIES[name](spark, folder(spark, tmp_path / str(job), [r for r in made if r[1] == job], primers=PRIMERS)).collect()
        assert alone and plain([r for r in got if r.job_id == job]) == plain(alone)
    assert {r.job_id for r in got} == {None, "a", "b"}


def test_pipelines_stay_within_jobs(spark):
    made, insert = of_jobs(random.Random(4))
    df = spark.createDataFrame(made, READ_PAIR).selectExpr("ordinal", "job_id", "read_name_first name1", "readseq_first seq1", "quality_first qual1", "readseq_second seq2", "quality_second qual2")
    found = P.load(spark.createDataFrame(*PRIMERS))
    refs = spark.createDataFrame([(1, "r1", insert)], "ref_id int, ref_name string, ref string")
    runs = {
        "referenceless": lambda x: pipelines.referenceless(x, found), "consensus": lambda x: pipelines.referenceless(x, found, PipelineConfig(barcoded=True, dupcount=True)),
        "reference": lambda x: pipelines.guided(x, found, refs), "barcode_first": lambda x: pipelines.barcode_first(x, found, PipelineConfig(mode="barcode_first", compat=True)),
    }
    for name, run in runs.items():
        got = run(df).collect()
        assert {r.job_id for r in got} == {None, "a", "b"}, name
        for job in (None, "a", "b"):
            alone = run(df.where(f"job_id <=> {repr(job) if job else 'null'}").drop("job_id")).collect()
            assert plain([r for r in got if r.job_id == job]) == plain(alone), name


def test_approximate_primers_in_the_whole_window(spark, tmp_path):
    """Up to three substitutions of 20 bases leave more than 80 per cent; whole primers are the exact search's."""
    made = []
    for n, places in enumerate([(), (0,), (3, 14), (2, 9, 18), (2, 7, 12, 17)]):
        p = "".join("ACGT"["TGCA".index(b)] if i in places else b for i, b in enumerate(FP))
        seq = "ACGTACGTACGTAC" + p + INSERT
        made.append(row(n, seq, "I" * len(seq), "ACGT", "IIII"))
    got = {r.ordinal: r.primer_id for r in QUERIES["primer_approx"](spark, folder(spark, tmp_path, made, primers=PRIMERS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


REF = INSERT + "GTACTCGGTTAGGCGGAGTTTGGTGGTCTT"
REFS = ([(1, "r1 ", REF)], "ref_id int, ref_name string, seq string")
AHEAD = "ACGTACGTACGTAC" + FP


def test_reads_of_both_strands_are_aligned(spark, tmp_path):
    """Turned reads of the end, the middle and the beginning of the reference, one with a base of its own."""
    wrong = REF[20:50] + "ACGT"["CGTA".index(REF[50])] + REF[51:90]
    parts = [(REF[:70], False, 0), (REF[30:], True, 30), (REF[20:90], True, 20), ("TTTT" + REF[:66], True, 0), (wrong, True, 20)]
    made = [row(n, AHEAD + (rc(x) if turned else x), "I" * 34 + "5" * 70, "ACGT", "IIII") for n, (x, turned, _) in enumerate(parts)]
    made.append(row(9, AHEAD + rc("ACCA" * 15 + REF[:10]), "I" * 104, "ACGT", "IIII"))
    at = folder(spark, tmp_path, made, refs=REFS)
    got = {r.ordinal: (r.ref_aln, r.read_aln, r.matches) for r in QUERIES["banded_nw"](spark, at).collect()}
    want = {n: x[4:] if x.startswith("TTTT") else x for n, (x, _, _) in enumerate(parts)}
    assert got == {n: (REF[s : s + len(x)], x, len(x) - (n == 4)) for (n, x), (_, _, s) in zip(want.items(), parts)}
    assert {r.ordinal: r.cigar for r in QUERIES["cigar"](spark, at).collect()} == {n: f"{len(x)}M" for n, x in want.items()}
    lines = [r.value.split("\t") for r in QUERIES["sam"](spark, at).where("part = 1").collect()]
    assert sorted((int(v[3]), v[9], v[10]) for v in lines) == sorted((s + 1, x, "5" * len(x)) for x, (_, _, s) in zip(want.values(), parts))


def test_corrections_start_from_the_alignment(spark, tmp_path):
    """A deletion shifts nothing behind it, reads of both strands count, and each job has its own statistics."""
    full, wrong = REF[:70], "ACGT"["CGTA".index(REF[60])]
    lost, other = full[:30] + full[31:], full[:60] + wrong + full[61:]
    made = [row(n, AHEAD + full, "I" * 104, "ACGT", "IIII", "a") for n in range(9)]
    made += [row(20, AHEAD + lost, "I" * 103, "ACGT", "IIII", "a"), row(21, AHEAD + other, "I" * 94 + "#" + "I" * 9, "ACGT", "IIII", "a")]
    made += [row(22, AHEAD + rc(REF[30:]), "I" * 104, "ACGT", "IIII", "a"), row(23, AHEAD + INSERT[::-1], "I" * 104, "ACGT", "IIII", "a")]
    made += [row(30 + n, AHEAD + other, "I" * 104, "ACGT", "IIII", None) for n in range(5)]
    at = folder(spark, tmp_path, made, refs=REFS)
    stats = {(r.job_id, r.ref_pos): r for r in QUERIES["position_stats"](spark, at).collect()}
    for p in range(100):
        r = stats["a", p]
        assert r.n == 11 * (p < 69) + 10 * (p == 69) - (p == 30) + (p >= 30) or p == 69, p
        assert r[f"n_{REF[p].lower()}"] == r.n - (p == 60)
    assert {p for j, p in stats if j is None} == set(range(70)) and stats[None, 60][f"n_{wrong.lower()}"] == 5
    fixed = {r.ordinal: r.seq for r in QUERIES["correct_base"](spark, at).collect()}
    assert fixed[20][:68] == lost[:68] and fixed[21] == full and fixed[22] == REF[30:] and fixed[30] == other and 23 not in fixed
    fixed = {r.ordinal: r.seq for r in QUERIES["correct_zscore"](spark, at).collect()}
    chances = [10 ** (-q / 10) for q in [40] * 11 + [2]]
    z = (1 + 0.5 - sum(chances) / 3) / (sum(p * (1 - p) for p in chances) / 3) ** 0.5
    assert fixed[20][:68] == lost[:68] and fixed[22] == REF[30:] and fixed[21] == (full if z < 1.645 else other) and fixed[30] == other
