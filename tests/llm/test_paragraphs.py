"""Near-duplicate paragraphs on small tables: brute force, full buckets, odd texts."""

from __future__ import annotations

import random

import pytest

from pairloom.llm import paragraphs


def plain(text):
    out = "".join(c if c.isalnum() else " " for c in text.lower())
    return out.split()


def brute(rows):
    """(doc_id, place) -> first of its class, links, kept."""
    where = {}
    for d, text in rows:
        for k, part in enumerate((text or "").replace("\r", "\n").replace("\n\n", "\n").split("\n")):
            w = tuple(plain(part))
            if len(w) >= 5:
                where.setdefault(w, set()).add((d, k))
    kinds = sorted(where)
    grams = {w: {w[i : i + 5] for i in range(len(w) - 4)} for w in kinds}
    near = {w: [v for v in kinds if v != w and len(grams[w] & grams[v]) >= 0.8 * len(grams[w] | grams[v])] for w in kinds}
    root = {w: w for w in kinds}
    for _ in kinds:
        root = {w: min([root[w], *(root[v] for v in near[w])]) for w in kinds}
    first = {}
    for w in kinds:
        first[root[w]] = min(first.get(root[w], min(where[w])), min(where[w]))
    return {at: (*first[root[w]], len(near[w]), at == first[root[w]]) for w in kinds for at in where[w]}


def sample(rng, n=120):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randrange(5, 60)) for _ in range(25)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 0, 1, 1, 6))):
                p[rng.randrange(len(p))] = rng.choice(words)
            parts.append(rng.choice((" ", "  ", ", ")).join(rng.choice((w, w.upper())) for w in p))
        rows.append((d, rng.choice(("\n", "\r\n", "\n\n")).join(parts)))
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, words string")
    return {(r.doc_id, r.place): (r.class_doc, r.class_place, r.n_links, r.kept) for r in paragraphs.duplicates(df).collect()}


def test_bands_reach_the_recall():
    rows, n, recall = paragraphs.bands(0.8, 128, 0.99)
    assert rows * n <= 128 and recall == 1 - (1 - 0.8**rows) ** n >= 0.99
    assert paragraphs.bands(0.8, 128, 0.9)[0] > rows
    with pytest.raises(ValueError):
        paragraphs.bands(0.1, 4, 0.999)


def test_duplicates(spark):
    rows = sample(random.Random(1)) + [(900, None), (901, ""), (902, "too few words here"), (None, "one two three four five six")]
    want = brute([r for r in rows if r[0] is not None])
    assert sum(v[2] > 0 for v in want.values()) > 50 and not all(v[3] for v in want.values())
    assert got(spark, rows) == want


def test_full_buckets_and_hot_paragraphs(spark, monkeypatch):
    """Families of similar paragraphs that fill every bucket, and one paragraph in a third of all documents."""
    rng = random.Random(2)
    monkeypatch.setattr(paragraphs, "FEW", 3)
    monkeypatch.setattr(paragraphs, "BLOCK", 16)
    family = [f"f{i}" for i in range(60)]
    rows = [(d, "the same consent notice on every page") for d in range(60)]
    for d in range(60, 130):
        p = list(family)
        p[rng.randrange(55)] = f"x{d % 40}"
        rows.append((d, " ".join(p)))
    assert got(spark, rows) == brute(rows)


def test_nothing(spark):
    assert got(spark, []) == {} and got(spark, [(1, None), (2, "a b")]) == {}
    assert got(spark, [(1, "a b c d e"), (1, "a b c d e")]) == {(1, 0): (1, 0, 0, True)}
