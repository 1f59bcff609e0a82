"""The pipeline against a plain version, and its stages on odd documents."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plaitwork.llm import language_id, pii, queries
from plaitwork.llm.common import written

from .test_dedup import brute_components, brute_exact, brute_fingerprint
from .test_near_copies import kept_by_all_pairs

WORD_LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_run_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.unionByName(docs.limit(3)).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    filters = language_id.fit(docs)
    rows = {(r.doc_id, r.text) for r in docs.collect() if filters.predict(r.text)[0] != "und"}
    kept = {r[0] for r in brute_exact(sorted(rows)) if r[3]}
    rows = sorted((d, t) for d, t in rows if d in kept)
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components([d for d, _ in rows], fps)
    want = {}
    for doc, text in rows:
        if root[doc] == doc:
            ids = np.array([*WORD_LIB.encode(pii.redacted(text, pii.find(text)[1]), add_special_tokens=False).ids, 1], "<u4")
            for at in range(0, len(ids), 2048):
                want[doc, at] = (len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids))
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)


def test_run_against_all_pairs_of_shingle_sets(spark, tmp_path):
    """run() against plain versions of its stages; near copies share 0.8 of their five-word shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.unionByName(docs.limit(3)).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    filters = language_id.fit(docs)
    rows = {(r.doc_id, r.text) for r in docs.collect() if filters.predict(r.text)[0] != "und"}
    kept = {r[0] for r in brute_exact(sorted(rows)) if r[3]}
    rows = sorted((d, t) for d, t in rows if d in kept)
    left = kept_by_all_pairs(rows)
    want = {}
    for doc, text in rows:
        if doc in left:
            ids = np.array([*WORD_LIB.encode(pii.redacted(text, pii.find(text)[1]), add_special_tokens=False).ids, 1], "<u4")
            for at in range(0, len(ids), 2048):
                want[doc, at] = (len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids))
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    assert len(left) < len(rows)


def test_stages_on_odd_documents(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = written(stage(spark, docs, ""), f"test-{name}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == edge_docs.columns
            docs = out
    assert docs.count() == 0


def test_queries_are_named_by_operator():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_write_local_files_without_a_process_for_each(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, "more text")], "doc_id long, text string")
    corpus_pipeline.drop_exact_copies(spark, docs, "").write.parquet(str(tmp_path / "out"))
    path = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path / "out"))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert files.getClass().getName() == "plaitwork.llm.LocalFiles"
    for mode in (0o640, 0o1777):  # the second one by the way of Hadoop's own class
        files.setPermission(path, spark._jvm.org.apache.hadoop.fs.permission.FsPermission(f"{mode:o}"))
        assert (tmp_path / "out").stat().st_mode & 0o7777 == mode
    (tmp_path / "out").chmod(0o755)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert list((tmp_path / "out").glob(".part-*.crc"))
