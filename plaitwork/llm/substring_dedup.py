"""Substring deduplication by prefix-partitioned suffix trees.

Words are the letters of a suffix.  A repeat counts if it is at least MIN_WORDS words long, so only suffixes whose first
MIN_WORDS words also stand in another document matter.

1. Home.  Every window of MIN_WORDS words names its least run of PREFIX words (by hash, leftmost) as its anchor.  Equal
   windows have equal anchors, and neighbouring windows mostly share one: such a stretch of windows is a piece.  Texts, with
   the anchors of their pieces, are dealt by document id once and written as a bucketed table, so that no later step moves them.
2. Prefixes.  Documents and pieces of each anchor are counted (with map-side combining).  Anchors of one document alone lead to no
   repeat and are left out.
3. Groups.  All pieces of an anchor go to one group.  An anchor that has over GROUP pieces, in however few documents, is split
   by longer prefixes: equal pieces fold where they are, and the windows of those that differ are keyed by their own MIN_WORDS words.
4. Subtrees.  A group of one anchor is small enough for memory.  Its suffixes are sorted whole; the lengths of common prefixes of
   neighbours give the internal nodes of its suffix tree.  A node at a depth of MIN_WORDS or more is a repeat, maximal to the
   right by its depth; its least document keeps it and it is removed from the others.  A window with the longer key is a node
   already: the least document of each is one aggregate with map-side combining, which no number of copies outgrows.  Rows of
   one hot piece or window meet that least document in as many salted shares as their number asks for.
5. What is removed from a document meets its text at home.

Texts are compared by their words, hashes only say what to compare.

Defined results: words are separated by U+0020 and U+0009 to U+000D; a null or empty text has no word; the digest of no words is
that of an empty string; repeated rows (same id and text) keep what they share with each other; ids are taken to name one
text (if they don't, a removal is applied to each text of the id that is long enough for it); a
document with a null id is never removed from and removes from none; repeats inside one document alone stay; an empty
table gives an empty result; columns other than id and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm.bpe import Memo
from plaitwork.llm.common import SEPARATORS, bucketed, dropped, shuffle_width, spread_join, whole_text, written

MIN_WORDS = 13
PREFIX = 5
GROUP = 4096
_ROWS = 20_000
#: Bytes of text that leave a task together.
_BYTES = 8_000_000
_HOME = "doc_id long, line binary, anchors binary, firsts binary"
_SPOTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int32())]))
_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


class WordHashes:
    """64-bit hashes of words, with a bounded memo."""

    def __init__(self):
        self.memo = Memo(xxhash.xxh64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()
_BASE = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each run of k words."""
    n = len(words) - k + 1
    code = np.zeros(n, np.uint64)
    for j in range(k):
        code = code * _BASE + words[j : j + n]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xD6E8FEB86659FD93)
    return code ^ (code >> np.uint64(32))


def anchors(words: np.ndarray, min_words: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: first window, last window and hash of the anchor of each."""
    if len(words) < min_words:
        return _NOTHING
    runs = run_hashes(words, prefix)
    views = np.lib.stride_tricks.sliding_window_view(runs, min_words - prefix + 1)
    at = views.argmin(axis=1) + np.arange(len(views))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return first, last, runs[at[first]]


def internal_nodes(suffixes: list[tuple], depth: int) -> Iterator[tuple[int, int, int]]:
    """Nodes of the suffix tree of sorted suffixes that are the first on their paths at `depth` words or deeper.

    Yields (depth of the node, first, after last) as indices of the sorted suffixes."""
    start, least = 0, None
    for k in range(1, len(suffixes) + 1):
        common = 0
        if k < len(suffixes):
            a, b = suffixes[k - 1], suffixes[k]
            if a[:depth] == b[:depth]:
                common, most = depth, min(len(a), len(b))
                while common < most and a[common] == b[common]:
                    common += 1
        if common >= depth:
            least = common if least is None else min(least, common)
        else:
            if k - start > 1:
                yield least, start, k
            start, least = k, None


def keepers(texts: dict[bytes, int], min_words: int) -> dict[bytes, list[int]]:
    """For each text, the least document of each of its windows, from the least document of each text."""
    if len(texts) == 1:
        ((text, low),) = texts.items()
        return {text: [low] * (text.count(b" ") + 2 - min_words)}
    entries = []
    for text, low in texts.items():
        words = text.split(b" ")
        entries += [(tuple(words[k:]), low, text, k) for k in range(len(words) - min_words + 1)]
    entries.sort()
    out = {text: [low] * (text.count(b" ") + 2 - min_words) for text, low in texts.items()}
    for _, lo, hi in internal_nodes([e[0] for e in entries], min_words):
        least = min(e[1] for e in entries[lo:hi])
        for _, _, text, k in entries[lo:hi]:
            out[text][k] = least
    return out


def spans_below(doc: int, first: int, least: list[int]) -> list[tuple[int, int, int]]:
    """(doc, first, last): stretches of windows whose least document is a smaller one."""
    if least[0] < doc and least.count(least[0]) == len(least):
        return [(doc, first, first + len(least) - 1)]
    out: list[tuple[int, int, int]] = []
    for k, keeper in enumerate(least):
        if keeper < doc:
            if out and out[-1][2] == first + k - 1:
                out[-1] = (doc, out[-1][1], first + k)
            else:
                out.append((doc, first + k, first + k))
    return out


def repeats(pieces: list[tuple[int, int, bytes]], min_words: int) -> list[tuple[int, int, int]]:
    """(doc, first, last) windows to be removed, from pieces (doc, first window, text) with one anchor."""
    texts: dict[bytes, int] = {}
    for doc, _, text in pieces:
        if doc < texts.get(text, doc + 1):
            texts[text] = doc
    least = keepers(texts, min_words)
    out: list[tuple[int, int, int]] = []
    for doc, first, text in pieces:
        out += spans_below(doc, first, least[text])
    return out


def _flat(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept_sha256, kept (the text that is left, words joined by a space)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def prepare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("line", pa.binary()), ("anchors", pa.binary()), ("firsts", pa.binary())]
        for batch in it:
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode().split()
                first, _, anchor = anchors(_HASHES.of(words), min_words, prefix) if doc is not None else _NOTHING
                rows.append((doc, b" ".join(words), anchor.tobytes(), first.astype(np.int32).tobytes()))
                size += len(text)
                if size >= _BYTES:
                    yield _flat(rows, kinds)
                    rows, size = [], 0
            yield _flat(rows, kinds)

    home = bucketed(docs.where("doc_id is not null").mapInArrow(prepare, _HOME), "doc_id", "home")

    def census(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, found, pieces = [], [], []
            for doc, anchor in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, n = np.unique(np.frombuffer(anchor, np.int64), return_counts=True)
                ids.append(np.full(len(own), doc, np.int64))
                found.append(own)
                pieces.append(n.astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found)), pa.array(np.concatenate(pieces))], ["doc_id", "anchor", "pieces"])

    named = home.select("doc_id", "anchors").mapInArrow(census, "doc_id long, anchor long, pieces int")
    often = named.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("pieces").alias("pieces")).where("n > 1")
    met = named.select("doc_id", "anchor").join(often.select("anchor", (F.col("pieces") > group).alias("crowd")), "anchor")
    wanted = written(met.groupBy("doc_id", "crowd").agg(F.collect_list("anchor").alias("wanted")), "wanted")

    def found_in(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
        """(anchor, document, first window, text) of the wanted pieces of a batch of documents."""
        for doc, line, anchor, first, wanted in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            words, anchor, first = line.split(b" "), np.frombuffer(anchor, np.int64), np.frombuffer(first, np.int32)
            last = np.concatenate((first[1:], [len(words) - min_words + 1])) - 1
            mine = np.isin(anchor, np.array(wanted, np.int64))
            for h, a, b in zip(anchor[mine].tolist(), first[mine].tolist(), last[mine].tolist(), strict=True):
                yield h, doc, a, b" ".join(words[a : b + min_words])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("anchor", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("piece", pa.binary())]
        rows: list[tuple] = []
        for row in chain.from_iterable(map(found_in, it)):
            rows.append(row)
            if len(rows) >= _ROWS:
                yield _flat(rows, kinds)
                rows = []
        yield _flat(rows, kinds)

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal pieces of a task leave it as one row with the places where they stand."""
        kinds = [("piece", pa.binary()), ("low", pa.int64()), ("spots", _SPOTS)]
        spots: dict[bytes, list[tuple[int, int]]] = {}
        held = 0
        for batch in it:
            for _, doc, first, text in found_in(batch):
                spots.setdefault(text, []).append((doc, first))
                held += 1
                if held >= _ROWS:
                    yield _flat([(t, min(own)[0], [{"doc_id": d, "first": f} for d, f in own]) for t, own in spots.items()], kinds)
                    spots, held = {}, 0
        yield _flat([(t, min(own)[0], [{"doc_id": d, "first": f} for d, f in own]) for t, own in spots.items()], kinds)

    def grow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor: one subtree after the other."""
        kinds = [("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
        now, held, out = None, [], []
        for batch in it:
            for h, *piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if h != now:
                    if len(held) > 1:
                        out += repeats(held, min_words)
                    now, held = h, []
                    if len(out) >= _ROWS:
                        yield _flat(out, kinds)
                        out = []
                held.append(tuple(piece))
        if len(held) > 1:
            out += repeats(held, min_words)
        yield _flat(out, kinds)

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("window", pa.binary()), ("at", pa.int32()), ("piece", pa.binary()), ("low", pa.int64())]
        for batch in it:
            rows = []
            for piece, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = piece.split(b" ")
                rows += [(b" ".join(words[k : k + min_words]), k, piece, low) for k in range(len(words) - min_words + 1)]
            yield _flat(rows, kinds)

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
        for batch in it:
            rows: list[tuple] = []
            for spots, least in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                keepers = [x["keeper"] for x in least]
                for spot in spots:
                    for doc, first, last in spans_below(spot["doc_id"], spot["first"], keepers):
                        if rows and rows[-1][0] == doc and rows[-1][1] <= first <= rows[-1][2] + min_words:
                            rows[-1] = (doc, rows[-1][1], last)  # the words of both are one stretch
                        else:
                            rows.append((doc, first, last))
                if len(rows) >= _ROWS:
                    yield _flat(rows, kinds)
                    rows = []
            yield _flat(rows, kinds)

    def asked(crowd: bool) -> DataFrame:
        mine = wanted.where(F.col("crowd") == crowd).select("doc_id", "wanted")
        return home.join(mine, "doc_id").select("doc_id", "line", "anchors", "firsts", "wanted")

    span_schema = "doc_id long, first int, last int"
    ordinary = asked(False).mapInArrow(cut, "anchor long, doc_id long, first int, piece binary")
    marks = ordinary.repartition(shuffle_width(df.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(grow, span_schema)
    if not wanted.where("crowd").isEmpty():
        crowd = written(asked(True).mapInArrow(fold, "piece binary, low long, spots array<struct<doc_id:long,first:int>>").hint("rebalance"), "crowd")
        texts = written(crowd.groupBy("piece").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("copies")), "texts")
        each = texts.select("piece", "low").mapInArrow(windows, "window binary, at int, piece binary, low long")
        least = written(each.groupBy("window").agg(F.min("low").alias("keeper"), F.count(F.lit(1)).alias("copies")), "least")
        # a text has as many windows as its anchor can be in, whatever the number of its copies
        by_text = spread_join(each.select("window", "at", "piece"), least, "window").groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("at", "keeper"))).alias("least"))
        by_text = written(by_text.join(texts.select("piece", "copies"), "piece"), "keepers")
        dropped(texts, least)
        marks = marks.unionByName(spread_join(crowd.select("piece", "spots"), by_text, "piece").select("spots", "least").mapInArrow(apply, span_schema))
    found = marks.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
        for batch in it:
            rows, size = [], 0
            for doc, line, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = line.split(b" ") if line else []
                kept, removed = line, 0
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        if s["last"] + min_words <= len(words):
                            edge[s["first"]] += 1
                            edge[s["last"] + min_words] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    kept, removed = b" ".join(compress(words, stay.tolist())), int(len(words) - stay.sum())
                rows.append((doc, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode()))
                size += len(kept)
                if size >= _BYTES:
                    yield _flat(rows, kinds)
                    rows, size = [], 0
            yield _flat(rows, kinds)

    all_rows = home.select("doc_id", "line").join(found, "doc_id", "left").select("doc_id", "line", "spans")
    line = F.trim(F.translate("text", SEPARATORS, " " * len(SEPARATORS)))
    line = F.regexp_replace(line, " +", " ").cast("binary").alias("line")
    nameless = docs.where("doc_id is null").select("doc_id", line, F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans"))
    return all_rows.unionByName(nameless).mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
