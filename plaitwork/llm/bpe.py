"""BPE encoding and decoding by a contiguous rank array.

A short word (one pre-token) is held as two contiguous arrays: the byte offsets at which its parts begin
and, beside them, the merge rank of each part with the part to its right.  The encoder scans the ranks
for their minimum, deletes the boundary between the two parts that merge and refreshes only the two
neighbouring ranks.  New words of a batch stand in the rows of one matrix and take these steps together;
longer ones take them alone, and those of over LONG bytes by a heap.  Words repeat, so a bounded memo in each worker process keeps what was encoded.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text;
the string of a special token inside a text becomes its id, as the public ``tokenizers`` library has it
by default; ids decode by joining the bytes of tokens and reading them as UTF-8, with U+FFFD for broken
sequences.  Repeated rows give repeated results; columns other than id and text are left out, so clashing
names do no harm; a null id stays null.  Memory holds one Arrow batch and the bounded memo.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm.common import whole_text

# Fixed value: the public pre-tokenizer pattern of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: white space other than U+0020 and U+000A, with the separators U+001C to U+001F.
ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

NO_RANK = (1 << 31) - 1
MEMO_ENTRIES = 250_000
KEY = 256
#: Longer words are merged one by one; shorter ones of about the same length together.
SHORT = 48
#: Longer words are merged by a heap, as a scan for each merge would take time in proportion to the square of their length.
LONG = 400


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it prints, else the next code point from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + hidden.index(b)) for b in range(256)]


class Memo(dict):
    """A bounded memo: what is used while one generation fills survives into the next.  Keys of over KEY characters aren't kept."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def put(self, key, value) -> None:
        if len(key) > KEY:
            return
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def put_all(self, found: dict) -> None:
        """put() of many, which count as one when it is seen whether a generation is full."""
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self.update(found if max(map(len, found), default=0) <= KEY else {k: v for k, v in found.items() if len(k) <= KEY})

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value


def cuts_at_spaces(text: str) -> bool:
    """True if every space opens a pre-token of its own, so that a byte-level text may be cut there."""
    if "  " in text or "\n " in text or " \n" in text or text.endswith(" "):
        return False
    return not any(c in text for c in ODD_SPACES)


class RankArrayBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file (its path is the parameter)."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = as_bytes(token)
        self.id_of = {self.token_bytes[i]: i for i in vocab.values()}
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(len(self.token_bytes))]
        ranked: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            ranked.setdefault((self.id_of[left], self.id_of[right]), (rank, self.id_of[left + right]))
        self.base = len(self.token_bytes)
        self.merges = {a * self.base + b: found for (a, b), found in ranked.items()}
        self.joined_ids = np.zeros(1 + len(self.merges), np.int32)
        for rank, joined in self.merges.values():
            self.joined_ids[rank] = joined
        self._fill_slots()
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        self.byte_ranks = self._ranks_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in self.specials) + ")") if self.specials else None
        self.word_memo = Memo(self._word, memo_entries)
        self.chunk_memo = Memo(self._chunk, 2 * memo_entries)

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token: parts, and beside them the ranks of neighbours."""
        if len(word) > LONG:
            return self.merge_long(word)
        parts, merges, base = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.merges, self.base
        none = (NO_RANK, 0)
        ranks = [merges.get(a * base + b, none)[0] for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            parts[at] = int(self.joined_ids[least])
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merges.get(parts[at] * base + parts[at + 1], none)[0]
            if at:
                ranks[at - 1] = merges.get(parts[at - 1] * base + parts[at], none)[0]
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """merge_word() by a heap of (rank, place of the left part) and links between parts that are left."""
        parts, merges, base = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.merges, self.base
        n, none = len(parts), (NO_RANK, 0)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [merges.get(a * base + b, none)[0] for a, b in zip(parts, parts[1:], strict=False)] + [NO_RANK]
        heap = [(r, k) for k, r in enumerate(rank) if r != NO_RANK]
        heapify(heap)
        while heap:
            least, at = heappop(heap)
            if rank[at] != least:
                continue  # the part has changed or is gone
            gone = after[at]
            parts[at], rank[gone] = int(self.joined_ids[least]), NO_RANK
            after[at] = right = after[gone]
            parts[gone] = -1
            if right < n:
                before[right] = at
            for left, x in ((at, right), (before[at], at)):
                if left >= 0:
                    rank[left] = merges.get(parts[left] * base + parts[x], none)[0] if x < n else NO_RANK
                    if rank[left] != NO_RANK:
                        heappush(heap, (rank[left], left))
        return [p for p in parts if p >= 0]

    def _fill_slots(self) -> None:
        """An open table of pairs, at most a quarter full; the slot after the last one is the first."""
        self.slot_bits = max(4, (4 * len(self.merges)).bit_length())
        self.slot_keys = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_ranks = np.full(1 << self.slot_bits, NO_RANK, np.int32)
        keys = np.array(list(self.merges), np.int64)
        for key, at in zip(keys.tolist(), self._slot_of(keys).tolist(), strict=True):
            while self.slot_keys[at] != -1:
                at = (at + 1) & ((1 << self.slot_bits) - 1)
            self.slot_keys[at], self.slot_ranks[at] = key, self.merges[key][0]

    def _slot_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        key[(left < 0) | (right < 0)] = -1
        at = self._slot_of(key)
        there = self.slot_keys[at]
        ranks = np.where(there == key, self.slot_ranks[at], NO_RANK)
        ranks[key < 0] = NO_RANK
        more = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.slot_bits) - 1)
            there = self.slot_keys[at[more]]
            hit = there == key[more]
            ranks[more[hit]] = self.slot_ranks[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return ranks

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many short pre-tokens of like length; a row of the matrices is one word's part and rank array."""
        n, width = len(words), max(map(len, words)) + 2
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.array([len(w) for w in words])
        parts = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1).astype(np.int32)
        ranks = np.full((n, width), NO_RANK, np.int32)
        pairs = self.byte_ranks[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
        ranks[:, :-1] = np.where(parts[:, 1:] >= 0, pairs, NO_RANK)
        live, column = np.arange(n), np.arange(width)
        # the places that a row is read from once the boundary after a part is gone, for each place of the part
        after_part = np.minimum(column + (column > column[:, None]), width - 1)
        at_part = np.minimum(column + (column >= column[:, None]), width - 1)
        out = parts
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            least = ranks[row, at]
            more = least != NO_RANK
            if not more.all():
                out[live[~more]] = parts[~more]
                live, parts, ranks, at, least = live[more], parts[more], ranks[more], at[more], least[more]
                row = row[: len(live)]
                if not len(live):
                    break
            elif out is parts:
                parts = parts.copy()
            # delete the boundary after the part at `at`: all that is right of it moves one place
            begin = (row * width)[:, None]
            parts = parts.take(after_part[at] + begin)
            parts[row, at] = self.joined_ids[least]
            ranks = ranks.take(at_part[at] + begin)
            ranks[row, at] = self._ranks_of(parts[row, at], parts[row, at + 1])
            before = np.maximum(at - 1, 0)
            ranks[row, before] = np.where(at > 0, self._ranks_of(parts[row, before], parts[row, at]), ranks[row, before])
        return [p[:k] for p, k in zip(out.tolist(), (out >= 0).sum(axis=1).tolist(), strict=True)]

    def learn(self, chunks: Iterable[str]) -> None:
        """Put chunks that stand after a space, as far as they are new, into the memo; their new words are merged together."""
        new = [c for c in chunks if len(c) <= KEY and c not in self.chunk_memo and c not in self.chunk_memo.older]
        found = [[" " + c] if c.isascii() and c.isalpha() else self.pattern.findall(" " + c) for c in new]
        known, older = self.word_memo, self.word_memo.older
        words = sorted({w for ws in found for w in ws if w not in known and w not in older}, key=len)
        encoded = [w.encode() for w in words]
        fresh: dict[str, tuple[int, ...]] = {}
        for start in range(0, len(words), 2048):
            some = encoded[start : start + 2048]
            short = [(w, b) for w, b in zip(words[start : start + 2048], some, strict=True) if len(b) <= SHORT]
            if short:
                fresh.update(zip((w for w, _ in short), map(tuple, self.merge_words([b for _, b in short])), strict=True))
        get = lambda w: fresh[w] if w in fresh else known[w]
        for c, ws in zip(new, found, strict=True):
            ids = fresh.get(ws[0]) if len(ws) == 1 else None
            self.chunk_memo.put(c, ids or tuple(chain.from_iterable(map(get, ws))))
        for w, ids in fresh.items():
            known.put(w, ids)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """encode() of each text in turn, with the new words of about a megabyte of text merged together."""
        at = 0
        while at < len(texts):
            upto, size, chunks = at, 0, set()
            while upto < len(texts) and size < 2_000_000:
                if cuts_at_spaces(texts[upto]):
                    chunks.update(texts[upto].split(" "))
                size += len(texts[upto])
                upto += 1
            self.learn(chunks)
            yield from map(self.encode, texts[at:upto])
            at = upto

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(self.merge_word(word.encode()))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk that followed a space."""
        return tuple(chain.from_iterable(map(self.word_memo.__getitem__, self.pattern.findall(" " + chunk))))

    def _plain(self, text: str) -> Iterable[tuple[int, ...]]:
        if cuts_at_spaces(text):
            first, *rest = text.split(" ")
            return chain(map(self.word_memo.__getitem__, self.pattern.findall(first)), map(self.chunk_memo.__getitem__, rest))
        return map(self.word_memo.__getitem__, self.pattern.findall(text))

    def encode(self, text: str) -> list[int]:
        if self.special_pattern is None or not any(s in text for s in self.specials):
            return list(chain.from_iterable(self._plain(text)))
        out: list[int] = []
        for part in self.special_pattern.split(text):
            out.extend((self.specials[part],) if part in self.specials else chain.from_iterable(self._plain(part)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, RankArrayBPE] = {}


def loaded(path: str) -> RankArrayBPE:
    """One encoder for each vocabulary in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = RankArrayBPE(path)
    return _LOADED[path]


def encode_column(df: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row of df; no shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in it:
            ids = list(bpe.encode_batch(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(batches, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(df: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """What encode_column gives, as digests made in the same pass: n_tokens, ids_sha256, decoded_sha256 and whether the text came back."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in it:
            n, ids_sha, text_sha, same = [], [], [], []
            texts = batch.column(1).to_pylist()
            for t, ids in zip(texts, bpe.encode_batch(texts), strict=True):
                back = bpe.decode(ids)
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()))
                text_sha.append(sha(back.encode()))
                same.append(back == t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
