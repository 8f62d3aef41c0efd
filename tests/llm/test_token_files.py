from pathlib import Path

import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinfold.llm.token_files import WordCache, default_tokenizer, from_planes, op3_plane_files, pack, to_planes, token_table, unpack
from tests.llm.helpers import DOCS, odd_rows, table


def expected(docs):
    t, at, out = Tokenizer.from_file(default_tokenizer()), 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def found(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(op3_plane_files(spark, sf)) == expected(docs)


def test_odd_rows_small_segments_and_bit_planes(spark, tmp_path):
    d = table(spark, tmp_path, "documents", odd_rows())
    assert found(op3_plane_files(spark, d)) == expected([(r[0], r[1]) for r in odd_rows()])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert found(token_table(docs, default_tokenizer(), plane="bit", block_ids=100, segment_ids=300)) == expected([(r[0], r[1]) for r in odd_rows()])
    assert op3_plane_files(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_round_trip(plane, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    if n:
        assert (from_planes(to_planes(ids, plane), n, plane) == ids).all()
    payload, chunks = pack(ids, 100, plane, 3)
    assert (unpack(payload, chunks, plane) == ids).all()


def test_word_cache_equals_whole_text():
    t = Tokenizer.from_file(default_tokenizer())
    cache = WordCache(Path(default_tokenizer()).read_text(encoding="utf-8"), limit=300)
    for text in ["Don't stop.. 12 a1b2 <|endoftext|> x<|endoftext|>y", "é ́x Å b\x1cc d\x85e", "İstanbul ΣΑΣ ß ﬁ!!? ,. _a_", "日本 語 \U0001f600\U0001f600", "a b ​ c", "don't don't STOP.. stop..", "STOP, stop. J̌ a. é, ΑΣ. <|ENDOFTEXT|> 5. x5, İx."] * 2:
        assert cache.encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
