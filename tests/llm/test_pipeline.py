"""The corpus pipeline against its stages' brute-force versions."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import zstandard

from sylva.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def plain_score(model, text):
    """By a compressor made anew for each block."""
    if not text:
        return model.share
    data = text.encode()
    sizes = []
    for d in (model.good, model.bad):
        made = zstandard.ZstdCompressionDict(d)
        sizes.append(sum(len(zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False).compress(b)) for b in quality.blocks_of(data, model.block)))
    return 1 / (1 + math.exp(-(model.slope * (sizes[1] - sizes[0]) / len(data) + model.offset)))


def check_packing(docs, pieces):
    """Every document's tokens are there, in pieces of which only the last is short, and sequences have no gaps."""
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.piece, p.start, p.length, p.ids_crc32))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(by_doc[d.doc_id]) == [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(p.length for p in pieces) // 2048) + 1


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, empty texts, clashing names; and an empty table."""
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").where("length(text) > 400").orderBy("doc_id").limit(3).collect()
    a, b, c = (r.text for r in good)
    rows = [(1, a), (1, a), (2, a), (2, b), (None, c), (None, None), (3, ""), (4, a + " end"), (5, (a + " ") * 40 + b)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, possible string")
    for empty in (False, True):
        docs = odd.where("false") if empty else odd
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            out.write.parquet(str(tmp_path / f"{empty}{k}"))
            docs = spark.read.schema(out.schema).parquet(str(tmp_path / f"{empty}{k}"))
            if k < 4:
                assert docs.columns == odd.columns
            if k == 1 and not empty:
                assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted([(2, a), (2, b), (None, c), (3, ""), (4, a + " end"), (5, rows[-1][1])], key=repr)
            if k == 2 and not empty:
                assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted([(2, a), (2, b), (None, c), (3, "")], key=repr)  # 5 is a near copy of b
        assert (docs.count() == 0) == empty


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        was = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = docs.collect()
        if k < 4:
            assert docs.columns == columns and {r.doc_id for r in now} <= {r.doc_id for r in was}
        if k == 0:
            model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in now} == {r.doc_id for r in was if plain_score(model, r.text) >= 0.3}
        if k == 4:
            check_packing(was, now)
        if k == 1:
            assert {r.text for r in now} == {r.text for r in was} and len(now) == len({r.text for r in was})
        if k == 2:
            from tests.llm.test_llm import brute_groups

            assert {r.doc_id for r in now} == {i for i, x in brute_groups([(r.doc_id, r.text) for r in was]).items() if x[2]}
        if k == 3:
            from tests.llm.test_llm import brute_hits

            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = {r.doc_id: r.text for r in was if brute_hits(r.text, items)[1] == 0}
            assert {i: t for i, t in ((r.doc_id, r.text) for r in now) if i in clean} == clean
            assert all(r.n_chars == len(r.text) for r in now)
    assert before >= len({r.doc_id for r in now}) > 0
