"""BPE, library tokens, packing and the token store against the tokenizers library."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaitwork.llm import bpe, jvm, library_tokens, packing, queries, token_store
from plaitwork.llm.common import shared_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
ODD = st.text(alphabet=list(" \n\t'ab1.,sSétÉ́ßΣΩ你\x1c\xa0<|endoftext|>"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_ids_are_those_of_the_library(text):
    want = BYTE_LIB.encode(text, add_special_tokens=False).ids
    assert bpe.loaded(BYTE).encode(text) == want
    assert bpe.loaded(BYTE).decode(want) == BYTE_LIB.decode(want, skip_special_tokens=False)
    assert library_tokens.loaded(BYTE).ids(text).tolist() == want
    assert library_tokens.loaded(WORD).ids(text).tolist() == WORD_LIB.encode(text, add_special_tokens=False).ids


def test_words_merged_together_and_alone_agree():
    coder = bpe.RankArrayBPE(BYTE)
    words = [w.encode() for w in (" the", "internationalisation", "q", "Übergröße", "aaaaaaaaaaaa")]
    assert coder.merge_words(words) == [coder.merge_word(w) for w in words]
    small = bpe.RankArrayBPE(BYTE, memo_entries=3)
    texts = ["one two three four five six", "six five four", "seven  eight", "<|endoftext|> one"]
    assert list(small.encode_batch(texts)) == [BYTE_LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_ranks_of_pairs_from_the_slots():
    coder = bpe.loaded(BYTE)
    keys = np.array(sorted(coder.merges), np.int64)
    left, right = keys // coder.base, keys % coder.base
    assert coder._ranks_of(left, right).tolist() == [coder.merges[k][0] for k in keys.tolist()]
    rng = np.random.default_rng(4)
    left, right = rng.integers(-1, coder.base, (2, 20, 5000))
    want = [coder.merges.get(a * coder.base + b, (bpe.NO_RANK,))[0] if min(a, b) >= 0 else bpe.NO_RANK for a, b in zip(left.ravel().tolist(), right.ravel().tolist(), strict=True)]
    assert coder._ranks_of(left.ravel(), right.ravel()).tolist() == want
    assert np.searchsorted(np.flatnonzero(coder.slot_keys >= 0), len(coder.slot_keys)) == len(coder.merges) <= len(coder.slot_keys) // 4


def test_memo_of_chunks_outlasts_that_of_words():
    coder = bpe.RankArrayBPE(BYTE, memo_entries=100)
    text = "x " + " ".join(f"w{k}" for k in range(150))
    want = BYTE_LIB.encode(text, add_special_tokens=False).ids
    assert list(coder.encode_batch([text])) == [want] and len(coder.chunk_memo) == 151  # "x" too
    assert list(coder.encode_batch([text])) == [want]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdenrst éß", min_size=1, max_size=300))
def test_long_words_by_a_heap(text):
    coder = bpe.loaded(BYTE)
    word, most = text.encode(), bpe.LONG
    try:
        bpe.LONG = 1 << 30
        assert coder.merge_long(word) == coder.merge_word(word)
    finally:
        bpe.LONG = most


def test_a_megabyte_of_one_word():
    rng = np.random.default_rng(8)
    text = "x" + "".join(map(chr, rng.integers(97, 123, 1_000_000)))
    began = time.process_time()
    ids = bpe.loaded(BYTE).encode(text)
    assert time.process_time() - began < 60
    assert bpe.loaded(BYTE).decode(ids) == text
    assert ids == BYTE_LIB.encode(text, add_special_tokens=False).ids


def test_memos_keep_no_long_keys():
    memo = bpe.Memo(len, 10)
    assert memo["a" * 10_000] == 10_000 and not memo and memo["ab"] == 2 and len(memo) == 1


def test_round_trip_of_odd_documents(edge_docs, no_docs):
    rows = bpe.round_trip_digests(edge_docs, BYTE).collect()
    assert len(rows) == edge_docs.count() and all(r.round_trip for r in rows)
    assert bpe.round_trip_digests(no_docs, BYTE).count() == 0
    got = {r.doc_id: r for r in bpe.encode_column(edge_docs, BYTE).collect()}
    assert got[1].ids == [] and got[1].decoded == ""
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].ids_sha256 == hashlib.sha256(",".join(map(str, BYTE_LIB.encode("a").ids)).encode()).hexdigest()


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 101, 400))[::-1].copy()
    bins, offsets = packing.first_fit_decreasing(sizes, np.arange(len(sizes)), 100)
    room: list[int] = []
    for size, got, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        want = next((i for i, r in enumerate(room) if r >= size), len(room))
        if want == len(room):
            room.append(100)
        assert (got, offset) == (want, 100 - room[want])
        room[want] -= size


def test_packing_holds_every_id_once(edge_docs, no_docs):
    rows = packing.packed(edge_docs, WORD, length=64, group=4).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*WORD_LIB.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        copies = 3 if doc == 4 else 1
        assert sum(p.length for p in parts) == copies * len(ids)
        for p in parts:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(no_docs, WORD).count() == 0


def test_blocks_come_back_and_damage_is_seen():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 50257, 900), np.zeros(50, int), rng.integers(0, 2**32 - 1, 77), np.array([5]), np.tile(np.arange(7), 200)]
    coded = token_store.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_store.decode_blocks(coded), strict=True))
    assert len(coded[4]) < 400
    assert (token_store.decode_blocks([coded[2]])[0] == blocks[2]).all()  # alone
    bad = bytearray(coded[0])
    bad[400] ^= 4
    with pytest.raises(token_store.TokenFileError):
        token_store.decode_blocks([bytes(bad)])


def test_documents_from_files(edge_docs, no_docs):
    rows = token_store.read_documents(token_store.write_ids(edge_docs, BYTE, 0, block=256)).collect()
    docs = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in edge_docs.collect()))
    at, want = 0, []
    for *_, text, doc in docs:
        ids = np.array([*BYTE_LIB.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)
    assert token_store.read_documents(token_store.write_ids(no_docs, BYTE, 0)).count() == 0


def test_blocks_of_the_jvm_and_of_numpy_agree(spark):
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.2, 4096) % 50257, rng.integers(0, 2**32, 4096), np.tile(np.arange(7), 200), np.array([5]), np.array([0, 2**32 - 1, 0]), np.zeros(300, int), np.zeros(0, int)]
    encode, decode = (jvm.function(spark, "BlockCoder", back, "binary") for back in (False, True))
    df = spark.createDataFrame([(k, bytearray(b.astype("<u4").tobytes())) for k, b in enumerate(blocks)], "k int, ids binary")
    coded = [bytes(r.c) for r in df.select("k", encode(F.col("ids")).alias("c")).orderBy("k").collect()]
    assert coded == token_store.encode_blocks(blocks[:-1]) + token_store.encode_blocks(blocks[-1:])
    bad = []
    for at in range(0, len(coded[0]), 61):
        damaged = bytearray(coded[0])
        damaged[at] ^= 4
        bad.append((-1, damaged))
    rows = [(k, bytearray(c)) for k, c in enumerate(coded)] + bad + [(-1, bytearray(coded[0][:-1])), (-1, bytearray(b"TKB2")), (-1, None)]
    got = spark.createDataFrame(rows, "k int, c binary").select("k", decode(F.col("c")).alias("ids")).collect()
    assert all(r.ids is None if r.k < 0 else bytes(r.ids) == blocks[r.k].astype("<u4").tobytes() for r in got)


def test_a_block_is_decoded_before_its_documents_part(spark):
    blocks = spark.createDataFrame([], "part int, block int, n_ids int, crc long, coded binary, docs array<struct<doc_id:long,start:long,total:long,at:int>>")
    plan = token_store.read_documents(blocks)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explodes = [k for k, line in enumerate(plan) if "Generate explode" in line]
    decodes = [k for k, line in enumerate(plan) if "plaitwork_blockcoder_true(" in line.lower()]
    assert len(explodes) == 1 and decodes and min(decodes) > explodes[0]  # below it, so once a block


def test_a_damaged_file_is_an_error(edge_docs):
    blocks = token_store.write_ids(edge_docs, BYTE, 0, block=256)
    flipped = F.concat(F.expr("substring(coded, 1, 40)"), F.lit(bytearray(b"!")), F.expr("substring(coded, 42)"))
    for crc in (F.col("crc"), F.crc32("coded")):
        with pytest.raises(Exception, match="checksum"):
            token_store.read_documents(blocks.withColumn("coded", flipped).withColumn("crc", crc)).collect()


def test_chunks_learned_together_have_the_ids_of_the_library():
    tokens = library_tokens.LibraryTokens(BYTE, memo_entries=40)
    texts = ["", "one", "one two,three don't", "a\n", "a b.\n\nc d\n\n", "  two  spaces", "é 你好 мир ‘s 'll x", "q" * 900 + " end", "a <|endoftext|> b", "tail \u0301x \x1c y"]
    texts += [" ".join(map(str, range(k, 3 * k))) for k in range(60)]
    for some in (texts, texts[::-1]):
        assert [i.tolist() for i in tokens.ids_of(some)] == [BYTE_LIB.encode(t, add_special_tokens=False).ids for t in some]


def test_four_million_ids_are_coded_and_read_in_seconds(spark):
    ids = bytearray((np.random.default_rng(2).zipf(1.2, 4096) % 50257).astype("<u4").tobytes())
    encode, decode = (jvm.function(spark, "BlockCoder", back, "binary") for back in (False, True))
    df = spark.range(0, 1000, 1, 1).select(F.concat(F.lit(ids), F.encode(F.format_string("%04d", "id"), "utf-8")).alias("ids"))
    began = time.time()
    assert df.where(decode(encode(F.col("ids"))) == F.col("ids")).count() == 1000
    assert time.time() - began < 10


def test_the_query_writes_local_files_without_a_process_for_each(spark, tmp_path):
    session = spark.newSession()  # its settings are its own
    queries.op5_token_store(session, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "out"))
    for path in (tmp_path / "out", shared_dir(session)):  # of the result, and of the blocks
        files = session._jvm.org.apache.hadoop.fs.Path(str(path)).getFileSystem(session._jsparkSession.sessionState().newHadoopConf())
        assert files.getClass().getName() == "plaitwork.llm.LocalFiles"
    assert session.read.parquet(str(tmp_path / "out")).count() == 200


def test_new_chunks_are_looked_up_in_the_older_generation_without_going_through_it():
    class Older(dict):
        def __iter__(self):
            raise AssertionError("gone through")

    ours = library_tokens.LibraryTokens(BYTE)
    list(ours.ids_of(["some words here"]))
    ours.chunks.older = Older(ours.chunks)
    ours.chunks.clear()
    assert [a.tolist() for a in ours.ids_of(["some new words"])] == [BYTE_LIB.encode("some new words", add_special_tokens=False).ids]


def test_crc_of_joined_parts():
    a, b = b"hello" * 9, b"xyz" * 1000
    assert token_store.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    for size in (0, 1, 7, 255, 256, 16384, 99999):
        assert token_store.crc32_joined(zlib.crc32(a), zlib.crc32(bytes(size)), size) == zlib.crc32(a + bytes(size))


def test_a_word_is_given_to_the_library_once_whatever_stands_after_it():
    texts = ["Word word, word.\nword!\n\nWord) \"word\" don't.", "x Straße, STRASSE. straße; İs, ſo.", "word?\n", "word.\n\n", "a\n\n\nword", "\nword", " word", "word, 12. (word): word\tword"]
    for path, lib in ((BYTE, BYTE_LIB), (WORD, WORD_LIB)):
        tokens = library_tokens.LibraryTokens(path)
        asked, whole = [], tokens._by_library
        tokens._by_library = lambda chunks, asked=asked, whole=whole: asked.extend(chunks) or whole(chunks)
        for _ in range(2):
            assert [i.tolist() for i in tokens.ids_of(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert "word" in asked and len(asked) == len(set(asked))
        assert not {"word,", "word.", "word!", "word?", "word;"} & set(asked)
