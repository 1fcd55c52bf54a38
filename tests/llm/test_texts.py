"""Problems 7, 8 and 9 on small tables: round trips, brute force, odd texts."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from pairloom.llm import components, leakage, spans, tokens

ODD = ["", None, "Hello  world\n\t!", "naïve – “日本語” 🙂👩‍👩‍👧", "<|endoftext|> is text", " " * 500, "a" * 40_000, "\x00\x7f​﻿", "don't  STOP 12345"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r for r in tokens.encode(docs(spark, ODD), offsets=True).collect()}
    for i, x in enumerate(ODD):
        want = t.encode(x or "", add_special_tokens=False)
        assert got[i].ids == want.ids and list(zip(got[i].starts, got[i].ends, strict=True)) == want.offsets
    assert {r.doc_id: r.ids for r in tokens.encode(docs(spark, ODD)).collect()} == {i: r.ids for i, r in got.items()}
    assert got[0].ids == got[1].ids == [] and 50256 not in got[4].ids
    assert all(r.same for r in tokens.round_trip(docs(spark, ODD)).collect())
    assert tokens.encode(docs(spark, []).limit(0)).count() == 0


def test_decoding_split_characters(spark):
    ids = tokens.encode(docs(spark, ["🙂"])).head().ids
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, ids), (2, ids[:-1]), (3, []), (4, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in tokens.decode(cut).collect()}
    assert got[1] == "🙂" and "�" in got[2] and got[3] == "" and got[4] is None


def leaks_of(texts, items):
    out = set()
    for i, p in items:
        w = leakage.words(p)
        grams = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for d, t in enumerate(texts):
            v = leakage.words(t)
            if any(tuple(v[k : k + 13]) in grams for k in range(len(v) - 12)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("rank", [1024, 6])
def test_leaks_are_complete(spark, rank):
    """Against brute force; with a small rank the allowance for what the space leaves out keeps the search complete."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([5, 13, 25, 100])))) for i in range(30)] + [(90, ""), (91, None)]
    texts = ["", None, "Ünïcode only", " ".join(say(5000))]
    for _ in range(80):
        w = say(rng.randint(0, 120))
        p = leakage.words(rng.choice(items)[1])
        n = rng.choice([11, 12, 13, 14, len(p)])
        at = rng.randint(0, max(0, len(p) - n))
        k = rng.randint(0, len(w))
        texts.append(rng.choice([" ", ", ", "\n- "]).join(w[:k] + [x.upper() for x in p[at : at + n]] + w[k:]))
    table = spark.createDataFrame([(i, p, "w1", "s") for i, p in items], "item_id long, passage string, answer string, text string")
    found = leakage.leaks(docs(spark, texts), table, rank)
    got = [(r.doc_id, r.item_id) for r in found.where("kind = 'verbatim'").collect()]
    assert set(got) == leaks_of(texts, items) and len(set(got)) == len(got) > 20


def test_paraphrase_and_answer(spark):
    p = "the quick brown fox jumps over a lazy dog while seven green birds watch from tall old trees near water"
    w = p.split()
    twisted = " ".join(x for i, x in enumerate(w) if i % 7 != 6) + " so the answer is blue"
    items = spark.createDataFrame([(1, p, "Blue"), (2, "short", "x")], "item_id long, passage string, answer string")
    rows = leakage.leaks(docs(spark, [twisted, "nothing at all of it"]), items).collect()
    assert [(r.doc_id, r.item_id, r.kind, r.answer) for r in rows] == [(0, 1, "paraphrase", True)]
    assert rows[0].lcs >= 0.6 * len(w) and rows[0].run < 13


def test_leaks_of_long_and_repeated(spark, monkeypatch):
    """Passages of more pieces than one space holds; ids that several rows share; ids and answers that are null."""
    monkeypatch.setattr(leakage, "PIECES", 3)
    say = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    long = say("a", 400)
    rows = [(1, long, None), (2, say("b", 20), "x"), (2, say("c", 20), "y"), (None, say("d", 20), "z"), (4, None, "n")]
    items = spark.createDataFrame(rows, "item_id long, passage string, answer string")
    texts = [" ".join(long.split()[40 * k : 40 * k + 13]) for k in range(9)] + [say("b", 14), "x " + say("c", 13), say("d", 15), say("e", 50), long + " " + say("b", 20)]
    many = docs(spark, texts).unionByName(docs(spark, texts).where("doc_id = 9"))
    got = sorted((r.doc_id, r.item_id or -1) for r in leakage.leaks(many, items).where("kind = 'verbatim'").collect())
    assert got == sorted([(k, 1) for k in range(9)] + [(9, 2), (10, 2), (11, -1), (13, 1), (13, 2)])


def test_leaks_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, passage string, answer string")
    assert leakage.leaks(docs(spark, ["x"]), items).count() == 0


def test_latent_space_keeps_products(spark):
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 50, 20).tolist() for _ in range(30)]
    idf = rng.random(50) + 0.1
    basis = leakage.randomised_svd(spark, pieces, idf, 100)
    a = np.array([np.bincount(p, minlength=50) * idf for p in pieces])
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert np.allclose((a @ basis) @ basis.T, a, atol=1e-6)
    lead = leakage.randomised_svd(spark, pieces, idf, 5)
    exact = np.linalg.svd(a)[1]
    assert np.linalg.norm(a @ lead) ** 2 > 0.8 * (exact[:5] ** 2).sum()


def shared_of(texts):
    grams = [{t[i : i + 300] for i in range(len(t or "") - 299)} for t in texts if True]
    return {(a, b) for a, b in combinations(range(len(texts)), 2) if grams[a] & grams[b]}


def make_texts(rng):
    say = lambda n: "".join(rng.choice("abcdé 日\n") for _ in range(n))
    texts = ["", None, "x" * 299, "x" * 300, "x" * 2000, "x" * 900 + "y", "ab" * 400, say(3000)]
    shared, note = [say(n) for n in (299, 300, 301, 450, 1000)], say(230)
    for _ in range(60):
        part = rng.choice(shared)
        n = rng.choice([len(part), 300, 299, 250])
        at = rng.randint(0, max(0, len(part) - n))
        texts.append(say(rng.randint(0, 400)) + part[at : at + n] + say(rng.randint(0, 400)))
    texts += [say(80) + note + say(120) for _ in range(60)]  # a common shingle without a common span
    texts += [texts[10], texts[10], texts[4]]
    return texts


def test_shared_spans(spark):
    texts = make_texts(random.Random(7))
    want = shared_of(texts)
    got = [(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(docs(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    cover = {r.doc_id: r for r in spans.coverage(docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        if t is None or len(t) < 300:
            assert d not in cover
            continue
        mine = np.zeros(len(t), bool)
        for a, b in want:
            if d in (a, b):
                other = texts[b if d == a else a]
                for i in range(len(t) - 299):
                    if t[i : i + 300] in other:
                        mine[i : i + 300] = True
        assert (cover[d].n_chars, cover[d].n_shared) == (len(t), int(mine.sum()))
    parts = {r.doc_id: r for r in spans.clusters(docs(spark, texts)).collect()}
    assert all(parts[a].cluster_id == parts[b].cluster_id for a, b in want)
    linked = {x for pair in want for x in pair}
    assert all(parts[d].cluster_id == parts[d].class_id == d and parts[d].n_links == 0 for d in parts if d not in linked)


def test_shared_spans_of_many(spark, monkeypatch):
    """The way for shingles that occur at many different places, forced."""
    monkeypatch.setattr(spans, "FEW", 1)
    texts = make_texts(random.Random(8))
    assert {(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(docs(spark, texts)).collect()} == shared_of(texts)


def test_spans_of_nothing(spark):
    for texts in ([], [None, ""], ["a" * 400]):
        df = docs(spark, texts or ["x"]).limit(len(texts))
        assert spans.shared_pairs(df).count() == 0


def test_spans_of_repeated_rows_and_null_ids(spark):
    a, b = "".join(map(str, range(300))), "".join(map(str, range(1000, 1200)))
    rows = [(1, a + b, 5), (1, a + b, 5), (2, a, 5), (None, a, 5), (None, None, None), (3, b, 5), (3, b, 5), (4, a, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    assert sorted(tuple(r) for r in spans.shared_pairs(df).collect()) == [(1, 2), (1, 3), (1, 4), (2, 4)]
    assert sorted(tuple(r) for r in spans.coverage(df).collect()) == [(1, 1590, 1590), (2, 790, 790), (3, 800, 800), (4, 790, 790)]
    assert sorted((r.doc_id, r.class_id, r.cluster_id, r.n_links) for r in spans.clusters(df).collect()) == [(1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 1), (4, 2, 1, 1)]


def test_positions_of_minima():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 9, 500).astype(np.uint64)
    for width in (1, 2, 7, 101):
        assert spans.least_positions(h, width).tolist() == [i + int(h[i : i + width].argmin()) for i in range(500 - width + 1)]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_answer_after_any_piece_of_a_leaked_passage(spark):
    """The longest run is in the first piece, the answer follows the last one, or far behind the only leaked one."""
    w = [f"a{i}" for i in range(240)]
    items = spark.createDataFrame([(1, " ".join(w), "blue")], "item_id long, passage string, answer string")
    broken = w[:60] + [x for i, x in enumerate(w[60:]) for x in ([x] if i % 16 else ["x", x])] + ["blue"]
    texts = [broken, w[:60] + ["y"] * 150 + ["blue"], w[:60] + ["y"] * 400 + ["blue"]]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.answer for r in leakage.leaks(docs, items).collect()} == {0: True, 1: True, 2: False}


def test_recall_of_paraphrases(spark):
    """Passages with a fifth of their words replaced, left out or inserted, inside other text: at least 0.9 are found,
    and nothing in texts of the same words in another order."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passages = [rng.choices(vocabulary, k=rng.randrange(24, 37)) for _ in range(120)]
    texts = []
    for p in passages:
        out = []
        for w in p:
            r = rng.random()
            out += [rng.choice(vocabulary)] if r < 0.1 else [] if r < 0.15 else [w, rng.choice(vocabulary)] if r < 0.2 else [w]
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(300)) + out + rng.choices(vocabulary, k=rng.randrange(300))))
    other = [" ".join(rng.sample(p, len(p))) for p in passages]
    docs = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(p), "") for i, p in enumerate(passages)], "item_id long, passage string, answer string")
    found = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()}
    assert sum((i, i) in found for i in range(120)) >= 0.9 * 120
    assert found <= {(i, i) for i in range(120)}
