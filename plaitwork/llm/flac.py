"""FLAC as a media column: lossless encoding, and decoding of Rice residuals and linear predictors.

Frames of many streams are handled together: each numpy step takes one sample (or two bytes of a checksum) of every
frame, so the work is in proportion to the samples whatever the streams' number and lengths.

Encoder: mono, 8 bits, blocks of BLOCK samples, a fixed predictor of order 0 to 2 or a linear one of order 2 (the one with
the least sum of absolute residuals, with a handicap for the linear one), one Rice parameter per frame, STREAMINFO with the MD5 of the samples, and a SEEKTABLE with a
point for each frame, if there are several (as many as a metadata block holds).  Decoder: mono, 8 to 24 bits, constant, verbatim, fixed and LPC
subframes, wasted bits, Rice partitions of either parameter size, escaped partitions; streams with a dense, a sparse or no seek
table; it verifies CRC-8 of frame headers, CRC-16 of frames and the MD5 of the whole, and gives the samples as PCM blocks
with their offsets.  Texts are coded and decoded by slices of frames, so memory holds a text, its stream and one slice.

Defined results: null text counts as empty; an empty text's payload is 64 zero bytes; a payload is the text in UTF-8 with zero
bytes up to a positive multiple of 64, so equal texts give equal streams; a stream that fails a check raises FlacError with
the place; repeated rows give equal results; columns other than id and text are left out.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm.common import whole_text

BLOCK = 4096
RATE = 8000
UNIT = 64
#: Samples that are encoded together; as a step of the decoder costs about the same for few frames as for many, it takes more.
TOGETHER, DECODED_TOGETHER = 1_500_000, 4_000_000
#: Bits of a linear coefficient, and of the fraction in it.
_PRECISION, _SHIFT = 12, 10
#: What a linear predictor's residual counts against a fixed one's: it takes more work, and a store compresses plain codes of text better.
_WORTH = 1.25
#: Seek points that fit a metadata block.
_POINTS = ((1 << 24) - 1) // 18


class FlacError(ValueError):
    pass


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """Remainders of all `bits`-bit words for a polynomial of `width` bits, most significant bit first."""
    value = np.arange(1 << bits, dtype=np.uint32) << np.uint32(width - bits)
    for _ in range(bits):
        high = (value >> np.uint32(width - 1)) & np.uint32(1)
        value = ((value << np.uint32(1)) ^ (high * np.uint32(poly))) & np.uint32((1 << width) - 1)
    return value


# Fixed values of the format: x^8+x^2+x+1 and x^16+x^15+x^2+1.
_CRC8 = _crc_table(0x07, 8, 8).tolist()
_CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16_many(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges of a buffer, two bytes of each at a time (leading zero bytes don't count)."""
    out = np.zeros(len(starts), np.uint16)
    order = np.argsort(-lengths, kind="stable")
    padded = np.concatenate((np.zeros(2, np.uint8), buffer))
    ends = (starts + lengths + 2)[order]
    words = (lengths[order] + 1) // 2
    odd = (lengths[order] % 2).astype(bool)
    crc = np.zeros(len(order), np.uint16)
    counts = len(order) - np.searchsorted(words[::-1], np.arange(1, (words[0] if len(words) else 0) + 1), side="left")
    for left in range(len(counts), 0, -1):
        live = counts[left - 1]
        at = ends[:live] - 2 * left
        high = padded[at].astype(np.uint16)
        fresh = (words[:live] == left) & odd[:live]
        high[fresh] = 0
        crc[:live] = _CRC16[crc[:live] ^ ((high << np.uint16(8)) | padded[at + 1])]
    out[order] = crc
    return out


def _coded_number(value: int) -> bytes:
    """A frame number in the extended UTF-8 of the format."""
    if value < 0x80:
        return bytes([value])
    size = next(n for n in range(2, 8) if value < 1 << (5 * n + 1))
    tail = [0x80 | (value >> (6 * k)) & 0x3F for k in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size)) & 0xFF | value >> (6 * (size - 1)), *tail])


def _header(number: int, samples: int) -> bytes:
    head = b"\xff\xf8" + bytes([0b0111 << 4, 0b001 << 1]) + _coded_number(number) + struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


def runs(sizes: list[int], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of items whose sizes add up to at most `most`, or of one item."""
    at = 0
    while at < len(sizes):
        upto, total = at + 1, sizes[at]
        while upto < len(sizes) and total + sizes[upto] <= most:
            total += sizes[upto]
            upto += 1
        yield at, upto
        at = upto


def encode_many(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """One FLAC stream for each payload of unsigned 8-bit samples; long ones are coded by slices of frames."""
    step = max(1, TOGETHER // block) * block
    slices = [(k, at) for k, p in enumerate(payloads) for at in range(0, len(p), step)]
    frames: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[int]] = [[] for _ in payloads]
    for a, b in runs([min(step, len(payloads[k]) - at) for k, at in slices]):
        some = slices[a:b]
        for (k, _), (coded, lengths) in zip(some, _frames_of([payloads[k][at : at + step] for k, at in some], [at // block for _, at in some], block), strict=True):
            frames[k].append(coded)
            sizes[k] += lengths
    return [_stream(p, f, n, block) for p, f, n in zip(payloads, frames, sizes, strict=True)]


def _stream(payload: bytes, frames: list[bytes], sizes: list[int], block: int) -> bytes:
    pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()  # as signed samples
    info = struct.pack(">HH", block, block) + b"\0" * 6 + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    at, points = 0, []
    for i, size in enumerate(sizes):
        points.append(struct.pack(">QQH", i * block, at, min(block, len(payload) - i * block)))
        at += size
    table = [b"".join(points[k : k + _POINTS]) for k in range(0, len(points), _POINTS)]
    blocks = [(0, info), *((3, t) for t in table[: len(points) > 1])]  # a table holds what a metadata block can; later frames are walked to
    out = [b"fLaC"]
    for n, (kind, body) in enumerate(blocks):
        out += [bytes([kind | (0x80 if n == len(blocks) - 1 else 0)]), len(body).to_bytes(3, "big"), body]
    return b"".join([*out, *frames])


def _linear(samples: np.ndarray, within: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each sample's prediction from the two before it, and each frame's coefficients: least squares by autocorrelation, in whole numbers."""
    x = samples.astype(np.int32)
    back, back2 = np.concatenate(([0], x[:-1])), np.concatenate(([0, 0], x[:-2]))
    back, back2 = np.where(within >= 1, back, 0), np.where(within >= 2, back2, 0)
    r0, r1, r2 = (np.add.reduceat(x * y, start).astype(np.float64) for y in (x, back, back2))  # a frame's sums fit 31 bits
    whole = np.maximum(r0 * r0 - r1 * r1, 1.0)
    most = (1 << (_PRECISION - 1)) - 1
    quantised = lambda v: np.clip(np.rint(v / whole * (1 << _SHIFT)), -most, most).astype(np.int32)
    one, two = quantised(r1 * (r0 - r2)), quantised(r0 * r2 - r1 * r1)
    return (np.repeat(one, length) * back + np.repeat(two, length) * back2) >> _SHIFT, one, two


def _frames_of(payloads: list[bytes], numbers: list[int], block: int) -> list[tuple[bytes, list[int]]]:
    """The frames of each slice of samples, and their lengths in bytes; numbers: of each slice's first frame."""
    sizes = np.array([len(p) for p in payloads])
    frames = -(-sizes // block)
    place = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
    number = place + np.repeat(np.array(numbers), frames)
    length = np.minimum(block, np.repeat(sizes, frames) - place * block)
    start = np.cumsum(length) - length
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int16)
    within = np.arange(len(samples)) - np.repeat(start, length)
    first = np.diff(samples, prepend=samples[:1]).astype(np.int16)
    second = np.diff(first, prepend=first[:1]).astype(np.int16)
    total = lambda r, o: np.add.reduceat(np.where(within >= o, np.abs(r), 0).astype(np.int64), start) + 8 * o
    guess, one, two = _linear(samples, within, start, length)
    # kinds 0 to 2 are the fixed predictors; 3 is the linear one of order 2, taken where it saves a fifth of the residual
    kind = np.argmin([total(samples, 0), total(first, 1), total(second, 2), total(samples - guess, 2) * _WORTH], axis=0)
    order = np.minimum(kind, 2)
    mine = np.repeat(kind, length)
    residual = np.choose(mine, [samples, first, second, samples - guess]).astype(np.int32)
    coded = within >= np.minimum(mine, 2)
    residual, owner = residual[coded], np.repeat(np.arange(len(length)), length)[coded]
    zigzag = ((residual << 1) ^ (residual >> 31)).astype(np.int64)
    count = length - order
    ends = np.cumsum(count)
    sums = np.add.reduceat(zigzag, ends - count)
    rice = np.clip(np.floor(np.log2(np.maximum(sums / np.maximum(count, 1) * 0.7, 1))), 0, 14).astype(np.int64)
    k = rice[owner]
    quotient = zigzag >> k
    bits = quotient + 1 + k
    heads = [_header(n, s) for n, s in zip(number.tolist(), length.tolist(), strict=True)]
    head_bytes = np.array([len(h) for h in heads])
    fixed_bits = 8 + 8 * order + np.where(kind == 3, 9 + 2 * _PRECISION, 0) + 10
    code_bits = np.add.reduceat(bits, ends - count)
    frame_bytes = head_bytes + (fixed_bits + code_bits + 7) // 8 + 2
    frame_at = np.cumsum(frame_bytes) - frame_bytes
    stream = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    before = np.cumsum(bits) - bits
    place = (frame_at * 8 + head_bytes * 8 + fixed_bits)[owner] + before - np.repeat(before[ends - count], count)
    stop = place + quotient
    stream[stop] = 1
    for j in range(int(rice.max()) if len(rice) else 0):  # bit j of the remainder, from the low end
        has = k > j
        stream[(stop + k - j)[has]] = ((zigzag >> j) & 1)[has]
    packed = np.packbits(stream)
    # header, subframe header, warm-up samples, coefficients and Rice header, whose last byte may hold the first code's bits
    raw = samples.astype(np.uint8).tobytes()
    columns = (heads, kind.tolist(), order.tolist(), frame_at.tolist(), start.tolist(), rice.tolist(), fixed_bits.tolist(), one.tolist(), two.tolist())
    for h, t, o, a, s, r, n, c, d in zip(*columns, strict=True):
        value = (0b001000 | t if t < 3 else 0b100001) << 1
        value = value << 8 * o | int.from_bytes(raw[s : s + o], "big")
        if t == 3:
            low = (1 << _PRECISION) - 1
            value = ((value << 4 | _PRECISION - 1) << 5 | _SHIFT) << 2 * _PRECISION | (c & low) << _PRECISION | d & low
        value = value << 10 | r  # method 0 (2 bits), partition order 0 (4 bits), the parameter (4 bits)
        spare = -n % 8
        body = (value << spare).to_bytes((n + spare) // 8, "big")
        upto = a + len(h) + len(body)
        packed[a : upto - 1] = np.frombuffer(h + body[:-1], np.uint8)
        packed[upto - 1] |= body[-1]
    crc = crc16_many(packed, frame_at, frame_bytes - 2)
    packed[frame_at + frame_bytes - 2] = crc >> 8
    packed[frame_at + frame_bytes - 1] = crc & 0xFF
    out, f, whole = [], 0, packed.tobytes()
    for n in frames.tolist():
        own = frame_bytes[f : f + n].tolist()
        out.append((whole[int(frame_at[f]) : int(frame_at[f]) + sum(own)], own))
        f += n
    return out


@dataclass
class Stream:
    """What the metadata of a FLAC stream says."""

    bits: int
    samples: int
    md5: bytes
    frames_at: int
    points: list[tuple[int, int, int]]  # first sample, offset from the first frame, samples


def metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body, last = data[at + 4 : at + 4 + size], bool(kind & 0x80)
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7:
        raise FlacError("only mono streams are read")
    return Stream((packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], at, points)


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value


# Fixed values of the format: coefficients of the fixed predictors, latest sample first.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{8 + k: 256 << k for k in range(8)}}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


@dataclass
class _Frame:
    at: int
    samples: int
    coefficients: list[int]
    shift: int
    warm: list[int]
    bit: int  # where the residual begins, from the start of the stream
    kind: str
    constant: int = 0
    width: int = 8
    wasted: int = 0


def _head(data: bytes, at: int) -> tuple[int, int, int, bool] | None:
    """(samples, number, end, whether the number counts samples) of the frame header at a byte, None if there is none."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    a = at + 4
    lead = data[a]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead if not more else lead & ((1 << (6 - more)) - 1)
    for b in data[a + 1 : a + 1 + more]:
        number = number << 6 | b & 0x3F
    a += 1 + more
    samples = _SIZES.get(size_code, 0)
    if size_code in (6, 7):
        samples, a = int.from_bytes(data[a : a + size_code - 5], "big") + 1, a + size_code - 5
    a += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if a >= len(data) or not samples or crc8(data[at:a]) != data[a]:
        return None
    return samples, number, a + 1, bool(data[at + 1] & 1)


def _crc16(data: bytes) -> int:
    return int(crc16_many(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def walk(data: bytes, head: Stream) -> Iterator[tuple[int, int, int]]:
    """(first sample, from byte, to byte) of every frame.

    A dense seek table names them; elsewhere a frame ends where the next header stands that has the number due and lets the
    CRC-16 of the frame come out, or at the stream's end."""
    at, sample = head.frames_at, 0
    known = {p[0]: p for p in head.points}
    while at < len(data):
        found = _head(data, at)
        if found is None:
            raise FlacError(f"no frame, or a wrong CRC-8 of its header, at byte {at}")
        samples, own, body, by_sample = found
        point = known.get(sample + samples)
        if sample + samples >= head.samples > 0:
            end = len(data)
        elif point and head.frames_at + point[1] > at:
            end = head.frames_at + point[1]
        else:
            end, sync, due = body, data[at : at + 2], own + (samples if by_sample else 1)
            while (end := data.find(sync, end + 1)) >= 0:
                after = _head(data, end)
                if after and after[1] == due and _crc16(data[at : end - 2]) == int.from_bytes(data[end - 2 : end], "big"):
                    break
            end = end if end >= 0 else len(data)
        yield sample, at, end
        at, sample = end, sample + samples


def _frame(data: bytes, at: int, stream: Stream) -> _Frame:
    found = _head(data, at)
    if found is None:
        raise FlacError(f"no frame, or a wrong CRC-8 of its header, at byte {at}")
    samples, _, body, _ = found
    a, width_code = body - 1, data[at + 3] >> 1 & 7
    if data[at + 3] >> 4:
        raise FlacError("only mono streams are read")
    bits = _Bits(data, a + 1)
    width = _WIDTHS.get(width_code, stream.bits)
    kind = bits.take(8) >> 1
    wasted = 0
    if data[a + 1] & 1:  # a run of zeros and a one: low bits that all samples lack
        wasted = 1
        while not bits.take(1):
            wasted += 1
        width -= wasted
    if kind == 0:
        return _Frame(at, samples, [], 0, [], bits.at + width, "constant", bits.signed(width), width, wasted)
    if kind == 1:
        return _Frame(at, samples, [], 0, [], bits.at, "verbatim", width=width, wasted=wasted)
    if 8 <= kind <= 12:
        order = kind - 8
        warm = [bits.signed(width) for _ in range(order)]
        return _Frame(at, samples, _FIXED[order], 0, warm, bits.at, "rice", width=width, wasted=wasted)
    if kind >= 32:
        order = kind - 31
        warm = [bits.signed(width) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        return _Frame(at, samples, [bits.signed(precision) for _ in range(order)], shift, warm, bits.at, "rice", width=width, wasted=wasted)
    raise FlacError(f"unknown subframe type {kind}")


def decode_frames(streams: list[bytes], check: bool = True) -> Iterator[tuple[int, int, np.ndarray]]:
    """(stream, first sample, samples) of every frame in turn; as many frames are decoded together as DECODED_TOGETHER samples hold."""
    heads = [metadata(data) for data in streams]
    waiting: list[tuple[int, int, int, int, _Frame]] = []
    held = 0
    for k, (data, head) in enumerate(zip(streams, heads, strict=True)):
        for sample, at, end in walk(data, head):
            f = _frame(data, at, head)
            waiting.append((k, sample, at, end, f))
            held += f.samples
            if held >= DECODED_TOGETHER:
                yield from _decode_some(streams, waiting, check)
                waiting, held = [], 0
    yield from _decode_some(streams, waiting, check)


def decode_many(streams: list[bytes], check: bool = True) -> list[np.ndarray]:
    """The samples of each stream, as signed numbers."""
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    sums = [Sums(metadata(data), check) for data in streams]
    for k, sample, x in decode_frames(streams, check):
        sums[k].add(sample, x)
        parts[k].append(x)
    for s in sums:
        s.end()
    return [np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]


class Sums:
    """What is verified and computed of a stream while its blocks of samples go by, in order."""

    def __init__(self, head: Stream, check: bool = True):
        self.head, self.check = head, check
        self.md5, self.sha256, self.tail = hashlib.md5(), hashlib.sha256(), b""
        self.n = self.peak = self.squares = self.crossings = 0
        self.sign: bool | None = None

    def add(self, sample: int, x: np.ndarray) -> None:
        if sample != self.n:
            raise FlacError(f"a frame of sample {sample} where sample {self.n} was due")
        width = -(-self.head.bits // 8)
        raw = np.ascontiguousarray(x, "<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        self.md5.update(raw)
        if self.head.bits == 8:
            pcm = unsigned(x)
            self.sha256.update(pcm)
            self.tail = (self.tail + pcm)[-UNIT:]
        y, sign = x.astype(np.int64), np.signbit(x)
        self.peak = max(self.peak, int(np.abs(y).max()))
        self.squares += int((y * y).sum())
        self.crossings += int(np.count_nonzero(sign[1:] != sign[:-1])) + int(self.sign is not None and bool(sign[0]) != self.sign)
        self.sign = bool(sign[-1])
        self.n += len(x)

    def end(self) -> None:
        if self.head.samples and self.n != self.head.samples:
            raise FlacError(f"{self.n} samples where {self.head.samples} were announced")
        if self.check and self.head.md5 != b"\0" * 16 and self.md5.digest() != self.head.md5:
            raise FlacError("wrong MD5 of the samples")

    def feature(self) -> str:
        """Peak, root mean square and sign changes of the samples."""
        return f"n={self.n};peak={self.peak};rms={math.sqrt(self.squares / max(self.n, 1)):.4f};crossings={self.crossings}"


def unsigned(samples: np.ndarray) -> bytes:
    """8-bit samples as the bytes of their payload."""
    return (samples + 128).astype(np.uint8).tobytes()


def _decode_some(streams: list[bytes], some: list[tuple[int, int, int, int, _Frame]], check: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    if not some:
        return
    frames = [x[4] for x in some]
    length = np.array([end - at for _, _, at, end, _ in some])
    base = np.cumsum(length) - length
    buffer = np.frombuffer(b"".join(streams[k][at:end] for k, _, at, end, _ in some), np.uint8)
    if check:
        found = crc16_many(buffer, base, length - 2)
        last = base + length - 2
        wrong = np.flatnonzero(found != (buffer[last].astype(np.uint16) << 8 | buffer[last + 1]))
        if len(wrong):
            raise FlacError(f"wrong CRC-16 of the frame at byte {some[wrong[0]][2]}")
    sizes = np.array([f.samples for f in frames], np.int64)
    to = np.cumsum(sizes) - sizes
    samples = np.zeros(int(sizes.sum()), np.int32)
    _rice_frames(buffer, frames, base - np.array([f.at for f in frames]), to, samples)
    for (k, sample, *_, f), a in zip(some, to.tolist(), strict=True):
        yield k, sample, samples[a : a + f.samples] << f.wasted if f.wasted else samples[a : a + f.samples]


def _rice_frames(buffer: np.ndarray, frames: list[_Frame], base: np.ndarray, to: np.ndarray, samples: np.ndarray) -> None:
    padded = np.concatenate((buffer, np.zeros(16, np.uint8)))
    window = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))
    lanes, parts = [], []
    data = buffer.tobytes()
    for n, f in enumerate(frames):
        samples[to[n] : to[n] + len(f.warm)] = f.warm
        if f.kind == "constant":
            samples[to[n] : to[n] + f.samples] = f.constant
        elif f.kind == "verbatim":
            bits = _Bits(data, 0)
            bits.at = int(base[n]) * 8 + f.bit
            samples[to[n] : to[n] + f.samples] = [bits.signed(f.width) for _ in range(f.samples)]
        else:
            bits = _Bits(data, 0)
            bits.at = int(base[n]) * 8 + f.bit
            method, order = bits.take(2), bits.take(4)
            lanes.append((n, bits.at, method))
            parts.append(order)
    if not lanes:
        return
    lane = np.array([x[0] for x in lanes])
    bit = np.array([x[1] for x in lanes], np.int64)
    size = np.array([frames[n].samples for n in lane.tolist()])
    warm = np.array([len(frames[n].warm) for n in lane.tolist()])
    wide = np.array([4 + x[2] for x in lanes])
    per_part = size >> np.array(parts)
    turn = np.argsort(-(size - warm), kind="stable")
    lane, bit, size, warm, wide, per_part = lane[turn], bit[turn], size[turn], warm[turn], wide[turn], per_part[turn]
    deep = max(1, int(warm.max()))
    coefficients = np.zeros((deep, len(lane)), np.int64)
    history = np.zeros((deep, len(lane)), np.int64)
    for i, n in enumerate(lane.tolist()):
        f = frames[n]
        coefficients[: len(f.coefficients), i] = f.coefficients
        history[: len(f.warm), i] = f.warm[::-1]
    shift = np.array([frames[n].shift for n in lane.tolist()], np.int64)
    next_part, k = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.uint64)
    raw_bits = np.full(len(lane), -1)
    target = to[lane] + warm
    left = size - warm
    one, top = np.uint64(1), np.uint64(63)
    counts = len(left) - np.searchsorted(left[::-1], np.arange(int(left[0])), side="right")
    shifts = bool(shift.any())
    escapes = False
    index = warm.copy()
    for step, live in enumerate(counts.tolist()):
        due = np.flatnonzero(index[:live] == next_part[:live]) if step else np.arange(live)
        if len(due):
            n = wide[due]
            w = window[bit[due] >> 3].astype(np.uint64) << (bit[due] & 7).astype(np.uint64)
            value = (w >> (64 - n).astype(np.uint64)).astype(np.int64)
            escaped = value == (1 << n) - 1
            bit[due] += n
            k[due] = value.astype(np.uint64)
            raw_bits[due] = -1
            if escaped.any():
                escapes = True
                at = due[escaped]
                w = window[bit[at] >> 3].astype(np.uint64) << (bit[at] & 7).astype(np.uint64)
                raw_bits[at] = (w >> np.uint64(59)).astype(np.int64)
                bit[at] += 5
            next_part[due] = (index[due] // per_part[due] + 1) * per_part[due]
        b = bit[:live]
        w = window[b >> 3].astype(np.uint64) << (b & 7).astype(np.uint64)
        near = w >> np.uint64(11)
        zeros = np.uint64(1075) - (near.astype(np.float64).view(np.int64) >> 52).astype(np.uint64)  # of near, from its exponent
        far = np.flatnonzero(near < np.uint64(1 << 21))  # a run too long for one look, with its remainder
        kk = k[:live]
        rest = ((w << zeros << one) >> (top - kk)) >> one
        value = ((zeros << kk) | rest).astype(np.int64)
        used = (zeros + kk).astype(np.int64) + 1
        for i in far.tolist():
            if raw_bits[i] < 0:
                value[i], used[i] = _long_code(data, int(b[i]), int(kk[i]))
        residual = (value >> 1) ^ -(value & 1)
        if escapes:
            for i in np.flatnonzero(raw_bits[:live] >= 0).tolist():
                bits = _Bits(data, 0)
                bits.at = int(b[i])
                residual[i], used[i] = bits.signed(int(raw_bits[i])), int(raw_bits[i])
        bit[:live] += used
        guess = coefficients[0, :live] * history[0, :live]
        for d in range(1, deep):
            guess += coefficients[d, :live] * history[d, :live]
        now = (guess >> shift[:live] if shifts else guess) + residual
        for d in range(deep - 1, 0, -1):
            history[d, :live] = history[d - 1, :live]
        history[0, :live] = now
        samples[target[:live] + step] = now
        index[:live] += 1


def _long_code(data: bytes, at: int, k: int) -> tuple[int, int]:
    start, bits = at, _Bits(data, 0)
    while not data[at // 8] & (0x80 >> at % 8):
        at += 1
    bits.at = at + 1
    return (at - start) << k | (bits.take(k) if k else 0), at - start + 1 + k


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _parts(batches: Iterator[pa.RecordBatch], column: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that are handled together, so memory holds one slice in its various forms."""
    for batch in batches:
        for a, b in runs(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), most):
            yield batch.slice(a, b - a)


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a FLAC stream; no shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(it, 1):
            texts = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(encode_many([payload(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(batches, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of the samples of each stream of (doc_id, n_bytes, media)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in _parts(it, 2, DECODED_TOGETHER):
            streams = batch.column(2).to_pylist()
            sums = [Sums(metadata(data)) for data in streams]
            for k, offset, x in decode_frames(streams):  # blocks of samples, each with its offset
                sums[k].add(offset, x)
            rows = []
            for data, own in zip(streams, sums, strict=True):
                own.end()
                rows.append((own.n, own.sha256.hexdigest(), zlib.crc32(own.tail), len(data), hashlib.sha256(data).hexdigest(), own.feature()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(batches, SCHEMA)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, sample_offset, pcm): unsigned 8-bit blocks, one for each frame, found by the offset of its first sample."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(it, 1):
            ids, rows, held = batch.column(0).to_pylist(), [], 0
            for k, offset, x in decode_frames(batch.column(1).to_pylist()):
                rows.append((ids[k], offset, unsigned(x)))
                held += len(x)
                if held >= TOGETHER:
                    yield _pcm(rows)
                    rows, held = [], 0
            yield _pcm(rows)

    return media.select("doc_id", "media").mapInArrow(batches, "doc_id long, sample_offset long, pcm binary")


def _pcm(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["doc_id", "sample_offset", "pcm"])


def read_at(data: bytes, sample: int, count: int) -> np.ndarray:
    """`count` samples from `sample` on; only the frames that hold them are decoded, and walked to from the seek point before."""
    head = metadata(data)
    before = max((p for p in head.points if p[0] <= sample), default=(0, 0, 0))
    out, skip = [], 0
    part = Stream(head.bits, head.samples - before[0] if head.samples else 0, head.md5, head.frames_at + before[1], [(p[0] - before[0], p[1] - before[1], p[2]) for p in head.points if p[0] >= before[0]])
    waiting = []
    for first, at, end in walk(data, part):
        first += before[0]
        if first >= sample + count:
            break
        f = _frame(data, at, head)
        if first + f.samples > sample:
            waiting.append((0, first, at, end, f))
    for _, first, x in _decode_some([data], waiting, True):
        skip = skip if out else sample - first
        out.append(x)
    return np.concatenate(out)[skip : skip + count] if out else np.zeros(0, np.int32)
