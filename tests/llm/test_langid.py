import zlib

from kinfold.llm.langid import Model, accepted, letters, op1_zstd_dictionaries, train, trained_on
from tests.llm.helpers import DOCS, odd_rows, table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_zstd_dictionaries(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"}
    out = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(out) / len(out) > 0.96
    assert sum(r.accepted for r in rows) / len(rows) > 0.97


def test_classification_is_the_smallest_compressed_size(spark, sf):
    import zstandard as z

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(trained_on(docs))
    for r in docs.limit(30).collect():
        plain = letters(r.text).encode()
        sizes = {}
        for lang, raw in model.dictionaries.items():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            c = z.ZstdCompressor(level=model.level, dict_data=d, write_checksum=False, write_content_size=False)
            sizes[lang] = sum(len(c.compress(plain[i : i + model.block])) for i in range(0, len(plain), model.block))
        assert sizes[model.classify(r.text)[0]] == min(sizes.values())


def test_odd_rows_and_empty(spark, tmp_path):
    rows = op1_zstd_dictionaries(spark, table(spark, tmp_path, "documents", odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    by = {(r.doc_id): r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == by[7].lang_pred == "und" and not by[2].accepted
    assert by[None].lang_pred != "und" and not by[None].held_out
    assert op1_zstd_dictionaries(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


def test_stage_keeps_columns_and_drops_rejected(spark, tmp_path):
    d = table(spark, tmp_path, "documents", odd_rows())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = accepted(docs, Model({"en": b"the cat sat on the mat no id here", "de": "größe über naïve café".encode()}, min_margin=0.0))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {0, 1, 4, 5, None}


def test_without_languages_everything_is_undetermined():
    assert Model({}).classify("some words") == ("und", 0.0, False)
    assert Model({"xx": b"abc"}).classify("some words") == ("xx", 1.0, True)


def test_numbers_are_no_letters():
    model = Model({"en": b"the cat sat", "de": b"die katze"})
    for text in ("½ ²", "Ⅷ ①", "12 ٣ ४", "_-", "㊿ ⅓"):
        assert letters(text) == "" and model.classify(text) == ("und", 0.0, False)
    assert letters("a½b Ωm3") == "a b ωm"
