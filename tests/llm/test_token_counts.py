import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from kinfold.llm.token_counts import Counter, counter_for, default_model, load_pieces, op8_count_viterbi
from tests.llm.helpers import DOCS, odd_rows, table


def library(pieces):
    t = Tokenizer(models.Unigram(list(pieces), unk_id=next((i for i, p in enumerate(pieces) if p[0] == "<unk>"), 0), byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def exact():
    return library(load_pieces(default_model()))


def test_documents(spark, sf, exact):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_count_viterbi(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {d: exact(t) for d, t in text.items()}


def test_odd_rows_and_empty(spark, tmp_path, exact):
    rows = op8_count_viterbi(spark, table(spark, tmp_path, "documents", odd_rows())).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(r[0]), exact(r[1] or "")) for r in odd_rows())
    assert op8_count_viterbi(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "a▁b", "▁", "\n", "a\n\nb \n c", "<s> <0x41></s>", "日本 \U0001f600x", "a" * 300, "abc" * 5000 + " " + "abc" * 5000, "İß ́x", "\x1c\x85 　"])
def test_awkward_texts(text, exact):
    assert counter_for("m", lambda: load_pieces(default_model())).count(text)[0] == exact(text)


TIES = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0), ("bb", -3.0)] + [(f"<0x{i:02X}>", -50.0) for i in range(256)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c\né", max_size=14))
def test_ties_and_unknown_characters(text):
    assert Counter(TIES, limit=5).count(text)[0] == library(TIES)(text)
