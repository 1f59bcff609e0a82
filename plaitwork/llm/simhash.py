"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: lower-case A-Z, split words at U+0020 and U+0009 to U+000D, hash every shingle of three words
(repeats included) by XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes.

Links: the 64 bits are a ring of SEGMENTS segments.  If two fingerprints differ in at most `budget` bits, some
segment starts a chain such that each first l segments of it differ in at most l * budget / SEGMENTS bits
(rounded down).  As long as that is zero, the chain's segments are equal: they make the bucket key.  Inside a
bucket, pairs must keep all the proportional budgets of the chain before the full Hamming distance is taken.
A bucket of over BUCKET distinct fingerprints is not paired.  Its members meet at the fingerprints that are at
most budget / 2 bits from them: two of them have such a neighbour in common exactly if they differ in at most
`budget` bits, so no link is lost and no group is squared.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal fingerprints
are one vertex, so repeated rows and large groups of copies cost one row; a null id counts in no minimum (its
component has a null id if all its ids are null); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm.common import whole_text, written
from plaitwork.llm.components import components

SEGMENTS = 8
BUDGET = 2
BUCKET = 256
SEED = 42
_BLOCK = 1 << 16
#: For each byte, its bits as eight one-byte counters of a 64-bit number.
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8)).astype(np.uint64)


def fingerprint(text: str, shingle: int = 3) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        counters = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(counters, np.arange(0, len(hashes), 255), axis=0)  # 255 ones fit a counter
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(batches, "doc_id long, fp long")


def chain_budgets(segments: int, budget: int) -> list[int]:
    """The most bits that the first 1, 2, ... segments of a chain may differ in."""
    return [length * budget // segments for length in range(1, segments + 1)]


def equal_prefix(segments: int, budget: int) -> int:
    """Segments at the start of a chain that must be equal."""
    return sum(b == 0 for b in chain_budgets(segments, budget))


def linked_pairs(fps: np.ndarray, start: int, segments: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs that keep the chain budgets from segment `start` on and differ in at most `budget` bits."""
    width = 64 // segments
    i, j = np.triu_indices(len(fps), 1)
    apart = fps[i] ^ fps[j]
    total = np.zeros(len(apart), np.uint8)
    mask = np.uint64((1 << width) - 1)
    for length, most in enumerate(chain_budgets(segments, budget)):
        total = total + np.bitwise_count((apart >> np.uint64(width * ((start + length) % segments))) & mask)
        keep = total <= most
        if not keep.all():
            i, j, apart, total = i[keep], j[keep], apart[keep], total[keep]
    near = np.bitwise_count(apart) <= budget
    return i[near], j[near]


def _forest(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """As few links as keep together what the pairs link."""
    above = list(range(len(fps)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def links(distinct: DataFrame, segments: int = SEGMENTS, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp that connect all that lie within `budget` bits."""
    width = 64 // segments
    mask = (1 << (width * equal_prefix(segments, budget))) - 1
    turned = [F.col("fp") if not s else F.shiftrightunsigned("fp", width * s).bitwiseOR(F.shiftleft("fp", 64 - width * s)) for s in range(segments)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[t.bitwiseAND(F.lit(mask)) for t in turned])).alias("start", "key"))
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keyed.join(sizes, ["start", "key"]).select("start", "key", "fp", "n"), "buckets")
    small = met.where(F.col("n") <= bucket).groupBy("start", "key").agg(F.collect_list("fp").alias("fps")).select("start", "fps")

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = [], []
            for start, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fps = np.array(members, np.int64).view(np.uint64)
                for x, y in _forest(fps, *linked_pairs(fps, start, segments, budget)):
                    a.append(members[x])
                    b.append(members[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = small.mapInArrow(pairs, "a long, b long")
    crowded = met.where(F.col("n") > bucket).select("fp").distinct()
    return out.unionByName(common_neighbours(crowded, budget))


def common_neighbours(crowd: DataFrame, budget: int) -> DataFrame:
    """(a, b): links through the fingerprints at most budget // 2 bits away (for an even budget)."""
    if budget != 2:
        raise ValueError("crowded buckets are linked through neighbours of one bit, for a budget of 2")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    beside = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("via"))
    lowest = beside.groupBy("via").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return beside.join(lowest, "via").where("fp <> low").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= budget).select(F.col("fp").alias("a"), F.col("low").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id that links reach."""
    fps = written(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(links(distinct.select("fp"), **options)).select(F.col("node").alias("fp"), "root")
    rooted = written(distinct.join(found, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
