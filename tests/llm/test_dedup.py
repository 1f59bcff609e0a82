"""Exact, SimHash and substring deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plaitwork.llm import exact_dedup, simhash, substring_dedup
from plaitwork.llm.common import spread_join
from plaitwork.llm.components import components


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(7)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 400, 120)) for _ in range(12)]
    shared = " ".join(f"p{k}" for k in range(40))
    rows = []
    for i in range(90):
        words = base[i % 12].split()
        if i % 3 == 1:
            words[int(rng.integers(0, len(words)))] = "changed"
        if i % 5 == 2:
            at = int(rng.integers(0, len(words)))
            words[at:at] = shared.split()
        rows.append((1000 - i, " ".join(words)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def brute_exact(rows):
    groups: dict = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(d, keep, len(own), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_groups(edge_docs, made, digest):
    """Also with a digest of one digit, with which texts collide all the time."""
    for rows, df in (([(r.doc_id, r.text) for r in edge_docs.collect()], edge_docs), made):
        got = sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(df, digest=digest).collect()), key=str)
        assert got == sorted((r[:4] for r in brute_exact(rows)), key=str)
    whole = sorted((tuple(r) for r in exact_dedup.exact_groups(edge_docs).collect()), key=str)
    assert whole == brute_exact([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_exact_survivors(edge_docs, no_docs):
    stay = exact_dedup.deduplicated(edge_docs)
    assert stay.columns == edge_docs.columns
    ids = [r.doc_id for r in stay.collect()]
    assert ids.count(5) == 1 and 4 not in ids and 2 in ids and 1 not in ids  # more characters stay
    assert exact_dedup.exact_groups(no_docs).count() == 0 and exact_dedup.deduplicated(no_docs).count() == 0


def test_exact_groups_of_extreme_ids(spark):
    ids = [-(2**63), 2**63 - 1, 0, -1, None]
    rows = [(d, f"text {k}") for k in range(5) for d in ids[k:]] + [(ids[0], " longer  text 3 "), (None, "longer text 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == brute_exact(rows)
    left = [(r.doc_id, r.text) for r in exact_dedup.deduplicated(df).collect()]
    assert sorted(left, key=str) == sorted([(min((d for d in ids[k:] if d is not None), default=None), f"text {k}") for k in range(5)] + [(ids[0], " longer  text 3 ")], key=str)


def test_exact_dedup_runs_no_python(edge_docs):
    plan = exact_dedup.exact_groups(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, budget=2):
    above = {i: i for i in ids}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = top(ids[a]), top(ids[b])
                above[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_fingerprints(edge_docs):
    for r in edge_docs.collect():
        assert simhash.fingerprint(r.text or "") == brute_fingerprint(r.text)


@pytest.mark.parametrize("bucket", [256, 2])
def test_links_lose_nothing(spark, bucket):
    """Chains of fingerprints one or two bits apart, and random ones; small and crowded buckets."""
    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(12):
        x = int(rng.integers(0, 2**63))
        fps.add(x)
        for _ in range(14):
            for _ in range(int(rng.integers(1, 4))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, bucket=bucket)).collect()}
    want = brute_components(signed, fps)
    assert {s: found.get(s, s) for s in signed} == want


def test_pigeonring_budgets():
    assert simhash.chain_budgets(8, 2) == [0, 0, 0, 1, 1, 1, 1, 2] and simhash.equal_prefix(8, 2) == 3


def test_near_duplicates_of_odd_documents(edge_docs, no_docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge_docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[5] == 4
    assert simhash.near_duplicates(no_docs).count() == 0


def brute_windows(rows, m=13):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least: dict = {}
    for d, w in words:
        for k in range(len(w) - m + 1):
            if d is not None:
                t = tuple(w[k : k + m])
                least[t] = min(least.get(t, d), d)
    out = []
    for d, w in words:
        stay = [True] * len(w)
        for k in range(len(w) - m + 1):
            if d is not None and least[tuple(w[k : k + m])] < d:
                stay[k : k + m] = [False] * m
        kept = b" ".join(x for x, s in zip(w, stay, strict=True) if s)
        out.append((d, len(w), stay.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [4096, 3])
def test_substrings(edge_docs, made, group):
    for rows, df in ((([(r.doc_id, r.text) for r in edge_docs.collect()]), edge_docs), made):
        got = sorted((tuple(r)[:4] for r in substring_dedup.remove_repeats(df, group=group).collect()), key=str)
        assert got == brute_windows(rows)


def test_one_line_very_often_in_two_documents(spark):
    """Over 100,000 pieces of few anchors: split by pieces, though only two documents hold them."""
    line = "all work and no play makes a dull page "
    rows = [(7, "an opening of its own " + line * 100_000), (3, line * 100_000 + "the end"), (5, "nothing " * 5 + "shared here"), (None, "\t a\x0b\x0cnull id \r\n " + line * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r)[:4] for r in substring_dedup.remove_repeats(df).collect()), key=str) == brute_windows(rows)


@pytest.mark.parametrize("least", [1, 3, 4096])
def test_spread_joins_lose_nothing(spark, least):
    many = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(200)], "k int, v int")
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.max("v").alias("top"))
    got = sorted(map(tuple, spread_join(many, one, "k", least).select("k", "v", "top").collect()))
    assert got == sorted(map(tuple, many.join(one, "k").select("k", "v", "top").collect())) and len(got) == 200


def test_substrings_of_nothing(no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_internal_nodes_have_their_depth():
    suffixes = sorted([tuple("abcd"), tuple("abce"), tuple("abx"), tuple("bcd"), tuple("bcd")])
    assert list(substring_dedup.internal_nodes(suffixes, 2)) == [(2, 0, 3), (3, 3, 5)]
    assert list(substring_dedup.internal_nodes(suffixes, 3)) == [(3, 0, 2), (3, 3, 5)]


def test_long_chain_of_components(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
