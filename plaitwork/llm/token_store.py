"""Token ids on disk: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block holds up to BLOCK ids and is coded from an empty state, so any block can be read alone and a damaged one costs
nothing but itself.  For every id three predictors speak: the id that last followed the two ids before (order 2), the id that
last followed the one before (order 1), and the ids seen lately, by a hashed slot (order 0).  An event says which of them was
right, or that none was.  The event's probabilities are a mix of two adaptive distributions, one under the confidences
and agreement of the predictors, one under the last two events; the weight of each follows which of them did better.
Where all were wrong, the upper eight bits of the id follow, as two halves of four bits under adaptive order-0 frequencies, the
second under those of the first.  A 32-bit range coder writes events and halves.  The id's lower bits, and the slot of an
order-0 hit, are close to evenly spread inside a block; they are written as plain bits.

All is in whole numbers, so every machine decodes the same.  The queries code blocks in the JVM (BlockCoder.java), one after the
other; encode_blocks() and decode_blocks() give and take the same bytes with numpy, many blocks in step, one id of each at a time.

Files: a table of block rows in ascending order of (part, block): ids in order of doc_id, each document followed by the end
id.  A row has the coded bytes, their number of ids, the CRC-32 of the ids, and which documents lie in it from where.

Defined results: null text counts as empty; an empty document is the end id alone; documents with equal ids stand in the order of
their texts; a null id sorts first; an empty table gives no row and no block; a block that doesn't match its checksum
raises TokenFileError, in a query Spark's own error; columns other than id and text are left out.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaitwork.llm import jvm, library_tokens
from plaitwork.llm.common import shuffle_width, whole_text, written

BLOCK = 4096
#: Blocks that are coded in step.
LANES = 1024
_SLOT_BITS = 10
_TABLE_BITS = 10
_TOP, _BOTTOM = np.uint32(1 << 24), np.uint32(1 << 16)
_ONE = 4096
_MAGIC = b"TKB2"
#: Upper bits of an id that are coded by frequencies, in two halves; what a half's frequency gains; the most that they add up to.
_UPPER, _HALF = 8, 4
_GAIN, _MOST = 24, 1 << 12
_HEAD = struct.Struct("<4sIBIII")  # magic, ids, bits of a plain id, CRC-32 of the ids, coded bytes, plain bytes


class TokenFileError(ValueError):
    pass


class _Model:
    """The predictors and mixing state of many blocks; all arrays are flat, a lane after the other."""

    def __init__(self, lanes: int, width: int):
        kind = np.int32 if width < 29 else np.int64  # small tables stay in the processor's cache
        self.t2 = np.zeros(lanes << _TABLE_BITS, kind)
        self.t1 = np.zeros(lanes << _TABLE_BITS, kind)
        self.recent = np.zeros(lanes << _SLOT_BITS, kind)
        # a distribution of the four events is four 16-bit numbers, side by side
        self.by_state = np.full((lanes * 50, 4), _ONE // 4, np.int16)
        self.by_past = np.full((lanes * 16, 4), _ONE // 4, np.int16)
        self.weight = np.full(lanes, 16, np.int32)
        # frequencies of the first half of an id's upper bits, then of the second half under each first one
        self.halves = np.full((lanes * (1 + (1 << _HALF)), 1 << _HALF), 4, np.int16)
        self.before, self.before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.past = np.zeros(lanes, np.int64)
        lane = np.arange(lanes)
        self.lane, self.table_at, self.slot_at = lane, lane << _TABLE_BITS, lane << _SLOT_BITS
        self.state_at, self.past_at = lane * 50, lane * 16

    @staticmethod
    def slot(ids: np.ndarray) -> np.ndarray:
        return (ids * 0x9E3779B1 >> 11) & ((1 << _SLOT_BITS) - 1)

    def predict(self, n: int) -> np.ndarray:
        """Frequencies of the four events in the first n lanes."""
        mask = (1 << _TABLE_BITS) - 1
        one, two = self.before[:n], self.before2[:n]
        self.at1 = self.table_at[:n] + ((one * 0x85EBCA6B >> 13) & mask)
        self.at2 = self.table_at[:n] + (((one * 0x2C1B3C6D ^ two * 0x297A2D39) >> 12) & mask)
        self.v1, self.v2 = self.t1[self.at1], self.t2[self.at2]
        self.p1, self.p2 = self.v1 >> 2, self.v2 >> 2
        level1 = (self.v1 & 3) + (self.p1 > 0)
        level2 = (self.v2 & 3) + (self.p2 > 0)
        self.state = self.state_at[:n] + (level2 * 5 + level1) * 2 + (self.p1 == self.p2)
        self.history = self.past_at[:n] + self.past[:n]
        self.a = self.by_state.view(np.int64)[self.state, 0].view(np.int16).reshape(-1, 4).T.astype(np.int32)
        self.b = self.by_past.view(np.int64)[self.history, 0].view(np.int16).reshape(-1, 4).T.astype(np.int32)
        w = self.weight[:n]
        return ((self.a * w + self.b * (32 - w)) >> 6) + 2

    def upto(self, rows: np.ndarray) -> np.ndarray:
        """Running sums of the frequencies in some rows of the halves."""
        return self.halves[rows].cumsum(axis=1, dtype=np.int32)

    def learn(self, rows: np.ndarray, half: np.ndarray, total: np.ndarray) -> None:
        self.halves[rows, half] += _GAIN
        full = rows[total > _MOST]
        if len(full):
            self.halves[full] = (self.halves[full] >> 1) + 1

    def event(self, ids: np.ndarray) -> np.ndarray:
        """Which predictor is right: 0 order 2, 1 order 1, 2 order 0, 3 none."""
        own = ids + 1
        self.slots = self.slot(ids)
        seen = self.recent[self.slot_at[: len(ids)] + self.slots] == own
        return np.where(self.p2 == own, 0, np.where(self.p1 == own, 1, np.where(seen, 2, 3)))

    def update(self, ids: np.ndarray, events: np.ndarray) -> None:
        n, own = len(ids), ids + 1
        for table, at, v, p in ((self.t2, self.at2, self.v2, self.p2), (self.t1, self.at1, self.v1, self.p1)):
            sure = v & 3
            table[at] = np.where(p == own, v + (sure < 3), np.where(sure > 0, v - 1, own << 2))
        self.recent[self.slot_at[:n] + self.slot(ids)] = own
        lane = self.lane[:n]
        better = self.a[events, lane] - self.b[events, lane]
        self.weight[:n] = np.clip(self.weight[:n] + np.sign(better), 2, 30)
        for rows, at, old in ((self.by_state, self.state, self.a), (self.by_past, self.history, self.b)):
            new = old - (old >> 4)
            new[events, lane] += _ONE >> 4
            rows.view(np.int64)[at, 0] = np.ascontiguousarray(new.T, np.int16).view(np.int64)[:, 0]
        self.before2[:n] = self.before[:n]
        self.before[:n] = own
        self.past[:n] = ((self.past[:n] << 2) | events) & 15


def _bits_of(values: np.ndarray, widths: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    bits = np.zeros(total, np.uint8)
    for j in range(int(widths.max()) if len(widths) else 0):
        has = widths > j
        bits[(starts + widths - 1 - j)[has]] = (values[has] >> j) & 1
    return np.packbits(bits)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded form of each block of ids."""
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        out += _encode(blocks[at : at + LANES])
    return out


class _Writer:
    """Range coders of many blocks."""

    def __init__(self, lanes: int, longest: int):
        self.low, self.span = np.zeros(lanes, np.uint32), np.full(lanes, 0xFFFFFFFF, np.uint32)
        self.coded, self.end = np.zeros((lanes, 3 * longest + 64), np.uint8), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray | slice, before: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
        """Code an event of each of the lanes, with frequencies `before` below it, `own` of it and `total` of all."""
        unit = self.span[lanes] // total.astype(np.uint32)
        lo, sp = self.low[lanes] + unit * before.astype(np.uint32), unit * own.astype(np.uint32)
        while True:
            same = (lo ^ (lo + sp)) < _TOP
            short = ~same & (sp < _BOTTOM)
            go = np.flatnonzero(same | short)
            if not len(go):
                break
            if short.any():
                sp[short] = (np.uint32(0) - lo[short]) & (_BOTTOM - np.uint32(1))
            at = go if isinstance(lanes, slice) else lanes[go]
            self.coded[at, self.end[at]] = lo[go] >> np.uint32(24)
            self.end[at] += 1
            lo[go] <<= np.uint32(8)
            sp[go] <<= np.uint32(8)
        self.low[lanes], self.span[lanes] = lo, sp

    def done(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        for _ in range(4):
            self.coded[lane, self.end] = self.low >> np.uint32(24)
            self.end += 1
            self.low <<= np.uint32(8)
        return [row[:n].tobytes() for row, n in zip(self.coded, self.end.tolist(), strict=True)]


class _Reader:
    """What _Writer wrote, from bytes of a buffer."""

    def __init__(self, buffer: np.ndarray, byte: np.ndarray):
        self.buffer, self.byte, self.last = buffer, byte, len(buffer) - 9
        self.low, self.span, self.code = (np.full(len(byte), x, np.uint32) for x in (0, 0xFFFFFFFF, 0))
        for _ in range(4):
            self.code = (self.code << np.uint32(8)) | buffer[self.byte]
            self.byte += 1

    def seen(self, lanes: np.ndarray | slice, total: np.ndarray) -> np.ndarray:
        """The place among the frequencies that each lane's code points to."""
        self.unit = self.span[lanes] // total.astype(np.uint32)
        return ((self.code[lanes] - self.low[lanes]) // self.unit).astype(np.int64)

    def take(self, lanes: np.ndarray | slice, before: np.ndarray, own: np.ndarray) -> None:
        lo, sp, co = self.low[lanes] + self.unit * before.astype(np.uint32), self.unit * own.astype(np.uint32), self.code[lanes]
        while True:
            same = (lo ^ (lo + sp)) < _TOP
            short = ~same & (sp < _BOTTOM)
            go = np.flatnonzero(same | short)
            if not len(go):
                break
            if short.any():
                sp[short] = (np.uint32(0) - lo[short]) & (_BOTTOM - np.uint32(1))
            at = go if isinstance(lanes, slice) else lanes[go]
            co[go] = (co[go] << np.uint32(8)) | self.buffer[np.minimum(self.byte[at], self.last)]
            self.byte[at] += 1
            lo[go] <<= np.uint32(8)
            sp[go] <<= np.uint32(8)
        self.low[lanes], self.span[lanes], self.code[lanes] = lo, sp, co


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks])
    turn = np.argsort(-sizes, kind="stable")
    sizes = sizes[turn]
    lanes, longest = len(blocks), int(sizes[0]) if len(blocks) else 0
    ids = np.zeros((longest, lanes), np.int64)
    for i, k in enumerate(turn.tolist()):
        ids[: sizes[i], i] = blocks[k]
    events = np.zeros((longest, lanes), np.int8)
    width = np.maximum(_UPPER, [int(b.max()).bit_length() if len(b) else 1 for b in blocks])[turn]
    model, writer = _Model(lanes, int(width.max()) if lanes else 1), _Writer(lanes, longest)
    lane_no = np.arange(lanes)
    counts = lanes - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    for step, n in enumerate(counts.tolist()):
        now, lane = ids[step, :n], lane_no[:n]
        f = model.predict(n)
        e = model.event(now)
        events[step, :n] = e
        upto = f.cumsum(axis=0)
        mine = f[e, lane]
        writer.put(slice(n), upto[e, lane] - mine, mine, upto[3])
        new = np.flatnonzero(e == 3)
        if len(new):
            upper = now[new] >> (width[new] - _UPPER)
            rows = new * (1 + (1 << _HALF))
            for half in (upper >> _HALF, upper & ((1 << _HALF) - 1)):
                sums = model.upto(rows)
                at = np.arange(len(new))
                own = model.halves[rows, half]
                writer.put(new, sums[at, half] - own, own, sums[:, -1])
                model.learn(rows, half, sums[:, -1])
                rows = rows + 1 + half
        model.update(now, e)
    out: list[bytes] = [b""] * lanes
    for i, (k, code) in enumerate(zip(turn.tolist(), writer.done(), strict=True)):
        own = blocks[k].astype(np.int64)
        e = events[: sizes[i], i]
        lower = int(width[i]) - _UPPER
        plain = e >= 2
        widths = np.where(e[plain] == 2, _SLOT_BITS, lower)
        values = np.where(e[plain] == 2, model.slot(own[plain]), own[plain] & ((1 << lower) - 1))
        stops = np.cumsum(widths)
        bits = _bits_of(values, widths, stops - widths, int(stops[-1]) if len(stops) else 0).tobytes()
        out[k] = _HEAD.pack(_MAGIC, len(own), int(width[i]), zlib.crc32(own.astype("<u4").tobytes()), len(code), len(bits)) + code + bits
    return out


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded block."""
    out: list[np.ndarray] = []
    for at in range(0, len(coded), LANES):
        out += _decode(coded[at : at + LANES])
    return out


def _decode(rows: list[bytes]) -> list[np.ndarray]:
    heads = []
    for row in rows:
        if row[:4] != _MAGIC or len(row) < _HEAD.size:
            raise TokenFileError("no block of token ids")
        heads.append(_HEAD.unpack_from(row))
    sizes = np.array([h[1] for h in heads])
    turn = np.argsort(-sizes, kind="stable")
    sizes = sizes[turn]
    lanes, longest = len(rows), int(sizes[0]) if rows else 0
    buffer = np.frombuffer(b"".join(rows) + b"\0" * 16, np.uint8)
    window = np.ndarray((len(buffer) - 8,), ">u8", buffer, strides=(1,))
    lengths = np.array([len(r) for r in rows])
    base = (np.cumsum(lengths) - lengths)[turn] + _HEAD.size
    bit = (base + np.array([h[4] for h in heads])[turn]) * 8
    width = np.array([h[2] for h in heads], np.int64)[turn]
    ids = np.zeros((longest, lanes), np.int64)
    model, reader = _Model(lanes, int(width.max()) if lanes else 1), _Reader(buffer, base.copy())
    lane_no = np.arange(lanes)
    counts = lanes - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    last = len(buffer) - 9
    for step, n in enumerate(counts.tolist()):
        lane = lane_no[:n]
        f = model.predict(n)
        upto = f.cumsum(axis=0)
        value = reader.seen(slice(n), upto[3])
        e = (value >= upto[0]).astype(np.int64) + (value >= upto[1]) + (value >= upto[2])
        mine = f[e, lane]
        reader.take(slice(n), upto[e, lane] - mine, mine)
        now = np.where(e == 0, model.p2, model.p1).astype(np.int64) - 1
        new = np.flatnonzero(e == 3)
        upper = np.zeros(n, np.int64)
        if len(new):
            rows = new * (1 + (1 << _HALF))
            for _ in range(2):
                sums = model.upto(rows)
                value = reader.seen(new, sums[:, -1])
                half = np.minimum((value[:, None] >= sums).sum(axis=1), (1 << _HALF) - 1)
                at = np.arange(len(new))
                own = model.halves[rows, half]
                reader.take(new, sums[at, half] - own, own)
                model.learn(rows, half, sums[:, -1])
                rows = rows + 1 + half
                upper[new] = upper[new] << _HALF | half
        at = np.flatnonzero(e >= 2)
        if len(at):
            short_code = e[at] == 2
            w = np.where(short_code, _SLOT_BITS, width[at] - _UPPER)
            b = bit[at]
            raw = window[np.minimum(b >> 3, last)].astype(np.uint64) << (b & 7).astype(np.uint64)
            plain = np.where(w > 0, (raw >> np.minimum(64 - w, 63).astype(np.uint64)).astype(np.int64), 0)
            bit[at] = b + w
            whole = upper[at] << np.maximum(width[at] - _UPPER, 0) | plain
            now[at] = np.where(short_code, model.recent[model.slot_at[at] + (plain & ((1 << _SLOT_BITS) - 1))] - 1, whole)
        ids[step, :n] = now
        model.update(now, e)
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * lanes
    for i, k in enumerate(turn.tolist()):
        own = ids[: sizes[i], i].astype("<u4")
        if zlib.crc32(own.tobytes()) != heads[k][3]:
            raise TokenFileError("a block of token ids doesn't match its checksum")
        out[k] = own
    return out


ROW = "part int, block int, n_ids int, ids binary, docs array<struct<doc_id:long,start:long,total:long,at:int>>"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("total", pa.int64()), ("at", pa.int32())]))


def write_ids(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Encode all texts of df and write their ids in order of id_col; returns the block table, read from the files."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens.loaded(vocabulary)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        waiting: list[np.ndarray] = []  # ids that fill no block yet
        count, start, number = 0, 0, 0
        docs: list[tuple[int | None, int, int]] = []  # of the blocks that aren't written yet
        written_ids = 0

        def blocks(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, count, number, docs, written_ids
            ids = np.concatenate(waiting) if waiting else np.zeros(0, "<u4")
            whole = len(ids) if final else len(ids) // block * block
            cuts = [ids[a : min(whole, a + block)] for a in range(0, whole, block)]
            lists, d = [], 0
            for k, c in enumerate(cuts):
                first = written_ids + k * block
                own = []
                while d < len(docs) and docs[d][1] < first + len(c):
                    own.append({"doc_id": docs[d][0], "start": docs[d][1], "total": docs[d][2], "at": max(0, docs[d][1] - first)})
                    if docs[d][1] + docs[d][2] > first + len(c):
                        break
                    d += 1
                lists.append(own)
            docs = docs[d:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(cuts), pa.int32()), pa.array(range(number, number + len(cuts)), pa.int32()), pa.array([len(c) for c in cuts], pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array(lists, _DOCS)],
                ["part", "block", "n_ids", "ids", "docs"],
            )
            waiting, count = [ids[whole:]], len(ids) - whole
            number += len(cuts)
            written_ids += whole

        for batch in it:
            for doc, own in zip(batch.column(0).to_pylist(), tokens.ids_of(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate((own, end))
                docs.append((doc, start, len(ids)))
                start += len(ids)
                waiting.append(ids)
                count += len(ids)
                if count >= LANES * block:
                    yield from blocks(False)
        if count:
            yield from blocks(True)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    # the beginning of the text, which agrees with the order of texts, splits rows of one id; whole texts would go to the driver as samples
    in_order = rows.repartitionByRange(shuffle_width(df.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    encode = jvm.function(df.sparkSession, "BlockCoder", False, "binary")
    coded = in_order.mapInArrow(batches, ROW).withColumn("coded", encode(F.col("ids")))
    return written(coded.select("part", "block", "n_ids", F.crc32("coded").alias("crc"), "coded", "docs"), "token-ids")


@functools.cache
def _zero_bytes(power: int) -> list[list[int]]:
    """What 2**power zero bytes make of a CRC-32: a table for each of its four bytes."""
    if power:
        half = _zero_bytes(power - 1)
        step = lambda crc: _through(half, _through(half, crc))
    else:
        step = lambda crc: zlib.crc32(b"\0", crc ^ 0xFFFFFFFF) ^ 0xFFFFFFFF  # noqa: E731  no inversion before and after
    bits = [step(1 << k) for k in range(32)]
    tables = []
    for byte in range(4):
        table = [0]
        for bit in bits[8 * byte : 8 * byte + 8]:
            table += [bit ^ x for x in table]
        tables.append(table)
    return tables


def _through(tables: list[list[int]], crc: int) -> int:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def crc32_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings put together, from the CRC-32 of each and the second's length."""
    for power in range(size.bit_length()):
        if size >> power & 1:
            first = _through(_zero_bytes(power), first)
    return first ^ second


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the coded blocks alone."""

    decode = jvm.function(blocks.sparkSession, "BlockCoder", True, "binary")
    sound = F.when(F.crc32("coded") == F.col("crc"), decode(F.col("coded")))
    ids = F.coalesce(sound, F.raise_error(F.lit("TokenFileError: a coded block doesn't match its checksum")).cast("binary"))
    # a document's ids in a block end where the next document's begin
    upto = F.transform("docs", lambda d, i: F.struct(d["doc_id"].alias("doc_id"), d["start"].alias("start"), d["total"].alias("total"), d["at"].alias("at"), F.coalesce(F.get("docs", i + 1)["at"], F.col("n_ids")).alias("upto")))
    each = blocks.select("part", "block", ids.alias("ids"), upto.alias("ds")).select("part", "block", "ids", F.explode("ds").alias("d"))
    length = (F.col("d.upto") - F.col("d.at")).cast("long")
    crc = F.crc32(F.substring("ids", F.col("d.at") * 4 + 1, length.cast("int") * 4))
    found = each.select("part", "block", "d.doc_id", "d.start", "d.total", length.alias("length"), crc.alias("crc"))

    @F.pandas_udf("long")
    def joined(parts):
        def one(rows) -> int:
            ordered = sorted((r["block"], r["crc"], r["length"]) for r in rows)
            crc = ordered[0][1]
            for _, c, n in ordered[1:]:
                crc = crc32_joined(crc, c, 4 * n)
            return crc

        return parts.map(one)

    # a document is in as many rows as it has blocks
    rows = found.groupBy("part", "start", "doc_id", "total").agg(F.collect_list(F.struct("block", "crc", "length")).alias("rows"), F.sum("length").alias("n_tokens"))
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each file
    first = sizes.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    single = F.when(F.size("rows") == 1, F.col("rows")[0]["crc"]).otherwise(joined("rows"))
    return rows.join(first, "part").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", single.alias("ids_crc32"))
