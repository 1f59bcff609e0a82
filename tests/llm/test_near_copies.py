"""The pipeline's near-duplicate stage against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from plaitwork.llm import near_copies

from .test_dedup import brute_components, brute_fingerprint


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_all_pairs(rows):
    above = {d: d for d, _ in rows}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    sets = [(d, shingle_set(t)) for d, t in rows]
    for a, s in sets:
        for b, t in sets:
            if b < a and len(s & t) * 5 >= 4 * len(s | t):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {d for d in above if top(d) == d}


def test_stage_drops_edited_copies(spark):
    """Copies of which a few words are changed, chains of them, a group of one base, and halves that stay."""
    rng = np.random.default_rng(11)
    texts, rows = [[f"w{k}" for k in rng.integers(0, 900, 300)] for _ in range(15)], []
    for base in texts:
        rows.append(list(base))
        for edits in (1, 4, 6, 9, 14):
            words = list(base)
            for at in rng.integers(0, 300, edits):
                words[at] = f"new{rng.integers(0, 10**9)}"
            rows.append(words)
        rows.append(base[:150] + [f"other{k}" for k in range(len(rows) * 200, len(rows) * 200 + 150)])
    chain = list(texts[0])
    for _ in range(8):
        chain = list(chain)
        chain[int(rng.integers(0, 300))] = f"step{rng.integers(0, 10**9)}"
        rows.append(chain)
    order = rng.permutation(len(rows)).tolist()
    made = [(order[k], " ".join(w)) for k, w in enumerate(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = kept_by_all_pairs(made)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
    assert 15 <= len(want) < len(made) / 2 + 20


def test_near_copies_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == kept_by_all_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert 177 not in left and 145 not in left


@pytest.mark.parametrize(("group", "cells"), [(6, 10**9), (10**9, 900), (20, 4000)])
def test_large_components_by_blocks(spark, group, cells):
    """Copies of one text and of texts that were made of it step by step, in components far above the bound."""
    rng, rows = np.random.default_rng(3), []
    for _ in range(2):
        base = [f"w{k}" for k in rng.integers(0, 900, 200)]
        for _ in range(14):
            for _ in range(3):
                words = list(base)
                for at in rng.integers(0, 200, int(rng.integers(0, 5))):
                    words[at] = f"new{rng.integers(0, 10**9)}"
                rows.append(words)
            for at in rng.integers(0, 200, 4):
                base[at] = f"step{rng.integers(0, 10**9)}"
    made = [(k, " ".join(w)) for k, w in zip(rng.permutation(len(rows)).tolist(), rows, strict=True)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id for r in near_copies.near_duplicates(docs, group=group, cells=cells).where("doc_id = component_id").collect()}
    assert got == kept_by_all_pairs(made) and len(got) < len(made) / 2


def test_linked_with_known_numbers():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    plain = near_copies.linked(sets)
    known = np.arange(30) // 2
    above = {}
    for k in range(30):
        above.setdefault(("k", known[k]), set()).add(plain[k])
    got = near_copies.linked(sets, known)
    for a in range(30):
        for b in range(30):
            if plain[a] == plain[b] or known[a] == known[b]:
                assert got[a] == got[b]


def test_near_copies_of_odd_documents(edge_docs, no_docs):
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(edge_docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[5] == 4 and got[8] == 8
    assert near_copies.near_duplicates(no_docs).count() == 0


def test_stage_links_fingerprints_and_shingle_sets(spark):
    """Copies that SimHash links though their sets share less than 0.8, such that it doesn't, and chains of both kinds."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    pairs = [3, 212, 385, 4738, 589, 6676, 2528, 5966]
    rows = [(r.doc_id, r.text) for r in docs.where(docs.doc_id.isin(pairs) | (docs.doc_id < 60)).collect()]
    rng, texts = np.random.default_rng(5), dict(rows)
    for k, doc in enumerate((212, 4738, 3, 10)):  # copies of a copy, by their sets
        words = texts[doc].split()
        for at in rng.integers(0, len(words), 1 + len(words) // 60):
            words[at] = f"new{rng.integers(0, 10**9)}"
        rows.append((20_000 + k, " ".join(words)))
    rows += [(30_000, None), (30_001, ""), (30_002, texts[3])]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    prints = brute_components([d for d, _ in rows], [brute_fingerprint(t or "") for _, t in rows])
    sets, above = [(d, shingle_set(t)) for d, t in rows], dict(prints)

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if b < a and len(s & t) * 5 >= 4 * len(s | t):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    want = {d for d in above if top(d) == d}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, made, "").collect()} == want
    by_sets, by_prints = kept_by_all_pairs(rows), {d for d in prints if prints[d] == d}
    assert want < by_sets and want < by_prints
