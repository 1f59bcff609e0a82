"""Token ids by the public ``tokenizers`` library, with a memo of what it gave for each chunk of text.

The library is asked once for a chunk that stands between spaces or line breaks, then the ids are taken from a bounded
memo; ids_of() asks it for all new chunks of about two megabytes of text in one call, and only once for a word that stands with various
punctuation after it.  Texts that can't be cut there (odd white space, special tokens) and chunks with letters outside the Latin blocks
go to the library whole, so the ids are its own in every case.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import regex

from plaitwork.llm.bpe import BYTE_LEVEL_PATTERN, KEY, MEMO_ENTRIES, Memo, byte_alphabet, cuts_at_spaces

# Fixed value: the pre-tokenizer pattern in the word-end vocabulary's file.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BEYOND_LATIN = regex.compile("[^\x00-ɏ‐-‧]")


class LibraryTokens:
    """ids(text) as a little-endian uint32 array."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.word_ends = bool(spec["model"].get("end_of_word_suffix"))
        self.pattern = regex.compile(WORD_END_PATTERN if self.word_ends else BYTE_LEVEL_PATTERN)
        self.stand_in = dict(enumerate(byte_alphabet()))
        self.pieces = Memo(self._piece, memo_entries)
        self.chunks = Memo(self._chunk, 2 * memo_entries)
        vocab = self.tokenizer.get_vocab()
        self.opens, self.breaks, self.closes = np.zeros((3, 1 + max(vocab.values())), bool)  # ids of tokens that begin with a space, are a line break, end a word
        self.opens[[i for token, i in vocab.items() if token.startswith(self.stand_in[32])]] = True
        self.breaks[[i for token, i in vocab.items() if token == self.stand_in[10]]] = True
        if self.word_ends:
            self.closes[[i for token, i in vocab.items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
            self.words = Tokenizer(self.model)  # for words in the model's alphabet, one on each line
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_in))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii():
            if _BEYOND_LATIN.search(chunk):
                return self._whole(chunk if self.word_ends or chunk[0] == "\n" else " " + chunk)
            if self.word_ends:
                chunk = unicodedata.normalize("NFC", chunk)
        if self.word_ends:
            chunk = chunk.lower()
            found = (chunk,) if chunk.isalpha() else self.pattern.findall(chunk)
        else:
            lead = "" if chunk[:1] == "\n" else " "
            found = (" " + chunk,) if chunk.isalpha() else self.pattern.findall(lead + chunk)
        return b"".join(map(self.pieces.__getitem__, found))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        return next(self.ids_of([text]))

    def _cut(self, text: str) -> list[str] | None:
        """The chunks of a text, whose ids together are the text's; None if it can't be cut.  In a byte-level text a line break is the
        beginning of a chunk, and so stands before the first one, too."""
        if not text or any(s in text for s in self.specials):
            return None
        if self.word_ends:
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")
        # of three line breaks, or two at the end, more than one are in one pre-token
        if text[0] in " \n" or not cuts_at_spaces(text) or "\n\n\n" in text or text.endswith("\n\n"):
            return None
        return f"\n{text}".replace("\n", " \n")[1:].split(" ")

    def _word_and_rest(self, chunk: str) -> tuple[str, str]:
        """A chunk that is a word with or without punctuation after it, in these two parts and as the model gets them; ("", "") for any other."""
        if not chunk.isascii():
            if _BEYOND_LATIN.search(chunk):
                return "", ""
            if self.word_ends:
                chunk = unicodedata.normalize("NFC", chunk)
        if self.word_ends:
            chunk = chunk.lower()
        word = chunk.rstrip(string.punctuation)
        letters = word[1:] if word[:1] == "\n" else word
        return (word, chunk[len(word) :]) if letters.isalpha() else ("", "")

    def _by_library(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks from one call of the library for all; those that it doesn't part clearly are left out."""
        if self.word_ends:
            text, marks = "\0".join(chunks).encode().decode("latin-1").translate(self.stand_in).replace(self.stand_in[0], "\n"), self.closes
        elif any(" " in s or "\n" in s for s in self.specials):
            return {}
        elif chunks and chunks[0][0] == "\n":
            text, marks = "".join(chunks), self.breaks
        else:
            text, marks = " " + " ".join(chunks), self.opens
        ids = np.array((self.words if self.word_ends else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = 4 * np.flatnonzero(marks[ids])
        if len(at) != len(chunks):
            return {}
        raw, cuts = ids.tobytes(), [0, *(at + 4).tolist()] if self.word_ends else [*at.tolist(), 4 * len(ids)]
        return {c: raw[a:b] for c, a, b in zip(chunks, cuts, cuts[1:], strict=False)}

    def _learned(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of each of some chunks; they are new, or of the memo's older generation."""
        known, older = self.chunks, self.chunks.older
        fresh = {c: older[c] for c in chunks if c in older}  # an intersection with a dict would go through all of the dict
        new = list(chunks.difference(fresh) if fresh else chunks)
        together: tuple[list[str], list[str]] = [], []  # what the library gets: chunks after a space, and after a line break
        seen, words, rests = set(), [], []
        for c in new:
            word, rest = self._word_and_rest(c) if len(c) <= KEY else ("", "")
            words.append(word)
            rests.append(rest)
            ask = word or ("" if self.word_ends or c == "\n" or len(c) > KEY else c)
            if ask and ask not in seen:
                seen.add(ask)
                if not rest or ask not in known and ask not in older:
                    together[ask[0] == "\n"].append(ask)
        found: dict[str, bytes] = {}
        for some in together:
            if some:
                found.update(self._by_library(some))
        for c, word, rest in zip(new, words, rests, strict=True):
            if rest:
                raw = found.get(word) or known.get(word) or older.get(word)
                if raw is None:
                    raw = found[word] = self._chunk(word)
                fresh[c] = raw + self.pieces[rest]
            else:
                fresh[c] = found.get(word or c) or self._chunk(c)
        # a word in a chunk is a chunk of its own, and found again beside other punctuation
        found.update(fresh)
        known.put_all(found)
        return fresh

    def ids_of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """ids() of each text in turn, with the new chunks of about two megabytes of text given to the library together."""
        at = 0
        while at < len(texts):
            upto, size, flat, ends = at, 0, [], []
            while upto < len(texts) and size < 2_000_000:
                cut = self._cut(texts[upto])
                flat += cut or ()
                ends.append(len(flat) if cut else -1)
                size += len(texts[upto])
                upto += 1
            ids = list(map(self.chunks.get, flat))
            gaps = list(compress(range(len(ids)), map(is_, ids, repeat(None))))
            if gaps:
                fresh = self._learned({flat[k] for k in gaps})
                for k in gaps:
                    ids[k] = fresh[flat[k]]
            begin = 0
            for text, end in zip(texts[at:upto], ends, strict=True):
                if end < 0:
                    yield np.frombuffer(self._whole(text), "<u4")
                    continue
                yield np.frombuffer(b"".join(ids[begin:end]), "<u4")[0 if self.word_ends else 1 :]
                begin = end
            at = upto


_LOADED: dict[str, LibraryTokens] = {}


def loaded(path: str) -> LibraryTokens:
    if path not in _LOADED:
        _LOADED[path] = LibraryTokens(path)
    return _LOADED[path]
