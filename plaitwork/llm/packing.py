"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each document's ids (with an end id) are cut at every LENGTH ids; whole pieces fill a sequence, the rest of a
document is one shorter piece.  Documents are dealt to groups of about GROUP documents by a hash of the id, and
each group packs its pieces by itself: longest first, each into the first bin that has room.  The leaves of a
tournament tree hold the room in each bin and its inner nodes the larger of two, so the first bin that fits is
found by one walk from the root.

Defined results: a null text counts as empty, so it is one piece with the end id alone; a null id is hashed like any
other; repeated rows are packed once for each row, and ties in length go by id, then start; an empty table gives
no piece.  A text is tokenised whole.  A group holds piece lengths only, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm import library_tokens
from plaitwork.llm.common import whole_text

LENGTH = 2048
GROUP = 1024
END_ID = 1
#: Sequence ids of a group start at its number times this.
SPAN = 1 << 32


class BinTree:
    """Room in bins, as a tournament tree that grows by doubling."""

    def __init__(self, capacity: int, bins: int = 64):
        self.capacity, self.used, self.width = capacity, 0, bins
        self.room = [0] * bins + [capacity] * bins
        for node in range(bins - 1, 0, -1):
            self.room[node] = capacity

    def _grow(self) -> None:
        leaves = self.room[self.width :] + [self.capacity] * self.width
        self.width *= 2
        self.room = [0] * self.width + leaves
        for node in range(self.width - 1, 0, -1):
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])

    def place(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room for it; the bin and the item's offset there."""
        while self.room[1] < size:
            self._grow()
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < size:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= size
        where = node - self.width
        self.used = max(self.used, where + 1)
        while node > 1:
            node //= 2
            top = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == top:
                break
            room[node] = top
        return where, offset


def first_fit_decreasing(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order."""
    tree = BinTree(capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[k], offsets[k] = tree.place(size)
    return bins, offsets


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document's ids, with their checksums."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens.loaded(vocabulary)
        end = np.array([end_id], "<u4")
        for batch in it:
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), tokens.ids_of(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate((own, end))
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(batches, PIECE)


def packed(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece with the sequence it lies in and its offset there."""
    groups = max(1, -(-df.count() // group))
    cut = pieces(df, vocabulary, id_col, text_col, length, end_id)
    # pieces are dealt, not documents: neither a very long document nor an id that many rows share fills a group
    dealt = cut.withColumn("bunch", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit("packing")), F.lit(groups)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="last")
        lengths = part["length"].to_numpy()
        bins, offsets = first_fit_decreasing(lengths, np.arange(len(lengths)), length)
        return part.assign(sequence_id=part["bunch"] * SPAN + bins, offset=offsets).drop(columns="bunch")

    return dealt.groupBy("bunch").applyInPandas(pack, PIECE + ", sequence_id long, offset long")
