"""Near copies: texts that share at least four fifths of their shingles of five words (Jaccard similarity of the sets).

Words are those of op7's fingerprints: A-Z in lower case, split at U+0020 and U+0009 to U+000D; a text of fewer than
five words is one shingle, one without words the empty shingle.  Shingles stand as XXH64 with seed 42.

Candidates: BANDS keys of ROWS least hashes each.  Texts with a key in common are tied to the least of them, and the
components of these ties are brought together, each distinct set once.  Inside one, sets are compared exactly:
every set that is reached is held against all that are not reached yet, so a link inside a component is never lost.
Two sets of similarity s have no key in common with a chance of (1 - s**ROWS)**BANDS: 3 in a million at 0.8.

A component of over GROUP sets, or of over CELLS shingles, never comes to one task.  Each of its sets is first held against
the one that most of its keys tie it to, which settles a group of copies of one text in one pass.  If that leaves several
clusters, their sets are dealt into blocks of that size, and pairs of blocks are compared, each in a task of its own, but for
blocks of one and the same cluster; so no link is lost there either.

With `fingerprints`, links of op7's SimHash fingerprints (at most 2 bits apart, found by the pigeonring filter of simhash.py) count
as well: they hold repeated shingles as often as they stand, so copies that lost lines of a text full of repeats are near there
and not by their sets.  Both kinds of links make one graph, whose components are the groups.

Defined results: equal sets are one vertex, so groups of copies and repeated rows cost one row; a null id counts in
no minimum (a component has a null id if all its ids are null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm import simhash
from plaitwork.llm.common import dropped, spread_join, whole_text, written
from plaitwork.llm.components import components

SHINGLE = 5
#: Least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 32, 5
SEED = 42
#: Sets and shingles of a component, or of two blocks of a large one, that are compared in one task.
GROUP, CELLS = 2048, 4_000_000
_BLOCK = 1 << 12
_RNG = np.random.Generator(np.random.PCG64(SEED))
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """The distinct shingles' hashes, ascending; never empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands, as signed numbers; the band's place is part of its key."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[at : at + _BLOCK, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    raw = least.tobytes()
    width = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[width * k : width * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def _key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def _signatures(it: Iterator[pa.RecordBatch], fingerprints: bool) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = batch.column(1).to_pylist()
        sets = [shingles(t) for t in texts]
        fps = np.array([simhash.fingerprint(t) for t in texts] if fingerprints else [0] * len(texts), np.uint64).view(np.int64)
        columns = [batch.column(0), pa.array(map(_key, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(bands, sets), pa.list_(pa.int64())), pa.array(fps)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "size", "bands", "fp"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        sets = [shingles(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "hashes"])


def linked(sets: list[np.ndarray], known: np.ndarray | None = None) -> list[int]:
    """For each set, the number of its component under links of the least similarity; exact.  Sets of one known number are linked already."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    table = np.zeros(int(flat.max()) + 1, bool)
    known = np.arange(len(sets)) if known is None else known
    group, rest = np.full(len(sets), -1), np.arange(len(sets))
    items, starts = flat, np.concatenate(([0], np.cumsum(sizes)[:-1]))
    count, queue = 0, []
    while len(rest):
        if not queue:
            count += 1
            reached = np.arange(len(rest)) == 0
        else:
            x = queue.pop()
            table[own[x]] = True
            both = np.add.reduceat(table[items], starts, dtype=np.int64)
            table[own[x]] = False
            reached = both * DENOMINATOR >= NUMERATOR * (sizes[rest] + sizes[x] - both)
        if reached.any():
            reached = np.isin(known[rest], known[rest[reached]])
            group[rest[reached]] = count - 1
            queue += rest[reached].tolist()
            items, rest = items[np.repeat(~reached, sizes[rest])], rest[~reached]
            starts = np.concatenate(([0], np.cumsum(sizes[rest])[:-1])).astype(np.int64)
    return group.tolist()


def _connect(near: pd.DataFrame) -> pd.DataFrame:
    near = near.sort_values("key", ignore_index=True)
    group = linked([np.frombuffer(h, np.uint64) for h in near["hashes"]])
    return pd.DataFrame({"key": near["key"], "top": near["key"].groupby(group).transform("min")})


def _holds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, hashes, other), the (a, b) whose sets are similar enough."""
    for batch in it:
        keep = []
        for mine, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(mine, np.uint64), np.frombuffer(other, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both * DENOMINATOR >= NUMERATOR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(near: pd.DataFrame) -> pd.DataFrame:
    """Links between clusters that the sets of two blocks show: each cluster with the least of those it is linked to."""
    near = near.sort_values("key", ignore_index=True)
    known = np.unique(near["cluster"], return_inverse=True)[1]
    group = linked([np.frombuffer(h, np.uint64) for h in near["hashes"]], known)
    out = pd.DataFrame({"a": near["cluster"], "b": near["cluster"].groupby(group).transform("min")})
    return out[out["a"] != out["b"]].drop_duplicates()


def _large(sets: DataFrame, ties: DataFrame, group: int, cells: int) -> DataFrame:
    """(key, top) of the sets (key, hashes, size, root) of large components."""
    best = ties.groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b")).join(sets.select(F.col("key").alias("a")), "a", "left_semi")
    best = written(best, "best")
    counted = best.groupBy(F.col("b").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    asked = best.join(sets.select(F.col("key").alias("a"), "hashes"), "a").select("a", F.col("b").alias("key"), "hashes")
    hubs = written(counted.join(sets.select("key", F.col("hashes").alias("other")), "key"), "hubs")
    held = spread_join(asked, hubs, "key", group).select("a", F.col("key").alias("b"), "hashes", "other")
    held = written(held.mapInArrow(_holds, "a long, b long"), "held")
    dropped(best, hubs)
    stars = components(held).select(F.col("node").alias("key"), F.col("root").alias("star"))
    named = written(sets.select("key", "root", "size").join(stars, "key", "left").select("key", "root", "size", F.coalesce("star", "key").alias("cluster")), "clusters")
    # blocks: a large cluster has its own, small ones share those of the component's pool
    clusters = named.groupBy("root", "cluster").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("cells"))
    blocks = lambda n, c: F.ceil(F.greatest(F.col(n) / (group // 2), F.col(c) / (cells // 2)))
    clusters = written(clusters.withColumn("own", blocks("copies", "cells").cast("int")), "sizes")
    roots = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("own") == 1, F.col("copies"))).alias("pool"), F.sum(F.when(F.col("own") == 1, F.col("cells"))).alias("pool_cells"))
    roots = roots.where("n > 1").select(F.col("root").alias("of"), F.coalesce(blocks("pool", "pool_cells"), F.lit(0)).cast("int").alias("shared"))
    clusters = written(clusters.join(roots, F.col("root") == F.col("of")).select("cluster", "copies", "own", "shared", "root"), "open")
    # a block is (cluster, number), that of a pool (null, number)
    met = spread_join(named.select("key", "cluster"), clusters, "cluster")
    mine = F.when(F.col("own") > 1, F.col("cluster"))
    placed = written(met.select("key", "cluster", "root", mine.alias("whose"), F.pmod(F.xxhash64(F.when(F.col("own") > 1, F.col("key")).otherwise(F.col("cluster"))), F.greatest("own", F.when(F.col("own") == 1, F.col("shared")).otherwise(1))).cast("int").alias("block")), "placed")
    units = written(placed.select("root", "whose", "block").distinct(), "units")
    one, two = (units.select("root", F.col("whose").alias(f"w{k}"), F.col("block").alias(f"b{k}")) for k in (1, 2))
    order = "struct(w1, b1) < struct(w2, b2) and not w1 <=> w2 or w1 is null and w2 is null and b1 <= b2"
    pairs = one.join(two, "root").where(order).withColumn("pair", F.xxhash64("root", "w1", "b1", "w2", "b2"))
    sides = pairs.select("root", "pair", F.col("w1").alias("w"), F.col("b1").alias("b")).unionByName(pairs.select("root", "pair", F.col("w2").alias("w"), F.col("b2").alias("b"))).distinct()
    sides = sides.withColumnRenamed("root", "r")
    dealt = placed.join(sides, (F.col("root") == F.col("r")) & F.col("whose").eqNullSafe(F.col("w")) & (F.col("block") == F.col("b"))).select("key", "cluster", "pair")
    across = dealt.join(sets.select("key", "hashes"), "key").groupBy("pair").applyInPandas(_across, "a long, b long")
    return components(written(held.unionByName(across), "all-links")).select(F.col("node").alias("key"), F.col("root").alias("top"))


def _united(signed: DataFrame, found: DataFrame, group: int) -> DataFrame:
    """(key, top) of the links in found, (key, top), and of near fingerprints together."""
    prints = written(signed.select("fp", "key").distinct(), "prints")
    least = written(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")), "least")
    same = spread_join(prints, least.where("copies > 1"), "fp", group).select(F.col("key").alias("a"), F.col("least").alias("b"))
    one, two = (least.select(F.col("fp").alias(side), F.col("least").alias(f"key_{side}")) for side in "ab")
    near = simhash.links(least.select("fp")).join(one, "a").join(two, "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    united = components(same.unionByName(near).unionByName(found.select(F.col("key").alias("a"), F.col("top").alias("b"))))
    dropped(prints, least)
    return united.select(F.col("node").alias("key"), F.col("root").alias("top"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, cells: int = CELLS, fingerprints: bool = False) -> DataFrame:
    """(doc_id, key, component_id) of every row; component_id is the smallest id that links reach."""
    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    signed = written(plain.mapInArrow(lambda it: _signatures(it, fingerprints), "doc_id long, key long, size int, bands array<long>, fp long"), "signatures")
    distinct = signed.groupBy("key").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    banded = distinct.select("key", F.explode("bands").alias("band"))
    lowest = banded.groupBy("band").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least")
    ties = banded.join(lowest, "band").where("key <> least").groupBy(F.col("key").alias("a"), F.col("least").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ties = written(ties, "ties")
    tied = components(ties.select("a", "b")).select(F.col("node").alias("key"), "root")
    tied = written(tied.join(distinct.select("key", "size"), "key"), "tied")
    sizes_table = written(tied.groupBy("root").agg(F.count(F.lit(1)).alias("copies"), (F.sum("size") > cells).alias("wide")), "components")
    sizes = sizes_table.withColumn("large", F.col("wide") | (F.col("copies") > group)).drop("wide")
    near = spread_join(tied, sizes, "root", group)
    wanted = signed.select("doc_id", "key").join(tied.select("key"), "key", "left_semi").select(F.col("doc_id").alias("wanted")).distinct()
    sets = plain.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text").mapInArrow(_sets, "key long, hashes binary")
    sets = written(sets.groupBy("key").agg(F.first("hashes").alias("hashes")).join(near, "key"), "sets")
    found = sets.where("not large").select("key", "hashes", "root").groupBy("root").applyInPandas(_connect, "key long, top long")
    if not sizes.where("large").isEmpty():
        found = found.unionByName(_large(sets.where("large"), ties, group, cells))
    found = written(found, "linked")
    dropped(sets, ties, tied, sizes_table)
    if fingerprints:
        found = _united(signed, found, group)
    rooted = written(signed.groupBy("key").agg(F.min("doc_id").alias("low")).join(found, "key", "left").select("key", "low", F.coalesce("top", "key").alias("top")), "roots")
    lows = rooted.groupBy("top").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("copies"))
    named = spread_join(rooted.select("key", "top"), written(lows, "lows"), "top").select("key", "component_id")
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", "key", "component_id")
