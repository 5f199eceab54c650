"""Near copies at five-word similarity against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest

from lexweave.llm import shingles, simhash
from lexweave.llm.graph import connected_components
from tests.llm.helpers import documents

LEAST, WIDTH = 0.8, 5


def word_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set()


def similar(a, b):
    a, b = word_shingles(a), word_shingles(b)
    return a == b or (bool(a and b) and len(a & b) / len(a | b) >= LEAST)


def plain_heads(texts):
    """Index of the first text of each component."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def corpus(seed=5):
    """Texts with copies of 1 to 9 changed words (similarity on both sides of 0.8), a chain of
    copies, a large group of copies of one text, and texts that share a passage."""
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    out, common = [], fresh(60)
    for k in range(40):
        base = fresh(r.choice((60, 120, 200)))
        out.append(base)
        for _ in range(2):
            copy = list(base)
            for i in r.sample(range(len(copy)), 1 + k % 9):
                copy[i] = f"x{r.randrange(10**6)}"
            out.append(copy)
        out.append(fresh(60) + common)
    base = fresh(120)
    for _ in range(150):
        copy = list(base)
        copy[r.randrange(120)] = f"y{r.randrange(10**6)}"
        out.append(copy)
    for _ in range(6):
        base = list(base)
        base[r.randrange(120)] = f"z{r.randrange(10**6)}"
        out.append(base)
    out += [[], ["one"], ["One"], ["two", "words"]]
    r.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("limits", [{}, {"bucket_nodes": 4, "clump_bytes": 3000}])
def test_keep_one_against_all_pairs(spark, limits):
    """With the usual limits, and with ones that spread most buckets and clumps over all tasks."""
    texts = corpus()
    want = plain_heads(texts)
    assert 100 < len(want) < len(texts) - 150
    docs = documents(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in simhash.keep_one(docs, **limits).collect()) == want


def test_spread_links_against_all_pairs(spark):
    """All texts as one clump and blocks of seven: no link between components is lost."""
    texts = list(dict.fromkeys(t for t in corpus(7) if t))[:140]
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    rows = spark.createDataFrame([(0, i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "root bigint, node bigint, shingles binary").repartition(5)
    found = connected_components(shingles.spread_links(rows, LEAST, block_nodes=7)).collect()
    root = {i: i for i in range(len(texts))} | {r.node: r.root for r in found}
    want = plain_heads(texts)
    assert sorted({root[i] for i in root}) == want


def test_repeated_doc_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a + " more", "en", "s", 0), (None, b, "en", "s", 0), (None, "lone text", "en", "s", 0), (None, "lone text", "en", "s", 0)]
    got = simhash.keep_one(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a), (1, b), (None, "lone text")], key=repr)


def test_fingerprints_give_candidates(spark, monkeypatch):
    """Without any band, texts within four bits are found by their fingerprints alone and then
    compared exactly: equal fingerprints and linked ones, but none below the similarity."""
    monkeypatch.setattr(shingles, "_candidates", lambda nodes, bucket_nodes: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).limit(0))
    r = random.Random(11)
    texts, bases = [], [[f"w{k}.{r.randrange(10**6)}" for _ in range(2000)] for k in range(4)]
    for base in bases:
        texts.append(" ".join(base))
        for i in (5, 700):
            texts.append(" ".join([*base[:i], "changed", *base[i + 1 :]]))
    texts += ["a lone text", "", None]
    prints = [shingles.simhash(shingles.shingle_set((t or "").encode())) for t in texts]
    bits = [((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() for i in range(0, 12, 3) for j in (i + 1, i + 2)]
    assert max(bits) <= 4 and len(set(prints[:12])) > 4
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == [0, 3, 6, 9, 12, 13] == plain_heads(texts)
    # nothing links texts that fingerprints of any distance join but similarity does not
    near = lambda fps: fps.selectExpr("fp AS a").crossJoin(fps.selectExpr("fp AS b")).where("a > b").select("a", "b")
    found = shingles.components(docs.select("doc_id", "text"), near=near)
    assert found.select("root").distinct().count() == 6
