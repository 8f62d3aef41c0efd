from collections import Counter

import corpus_pipeline
from kinfold.llm.common import word_count
from kinfold.llm.token_files import default_tokenizer
from tests.llm.helpers import table
from tests.llm.test_decontaminate import brute as plain_contamination
from tests.llm.test_mixing import WORD
from tests.llm.test_neardup import brute as plain_components
from tests.llm.test_token_files import expected


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        kept[name] = len(after) / len(before)
        if name != "mixture":
            assert set(after) <= set(before)
        if name == "near_duplicates":
            assert sorted(r[0] for r in after) == sorted(r[0] for r in plain_components(before) if r[0] == r[2])
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert sorted(r[0] for r in after) == sorted(r[0] for r in plain_contamination(before, items) if not r[5])
        if name == "mixture":
            total = sum(len(WORD.findall(t)) for _, t in before)
            assert abs(sum(len(WORD.findall(t)) for _, t in after) - total) < 0.001 * total
            whole, cut = dict(before), [x for x in after if x not in set(before)]
            assert len(cut) <= docs.select("source").distinct().count() and all(whole[d].startswith(t) for d, t in cut)
            taken = Counter()
            for d, t in after:
                taken[d] += len(WORD.findall(t))
            assert all(n <= 3 * len(WORD.findall(whole[d])) for d, n in taken.items())
    assert kept["language"] > 0.97 and kept["near_duplicates"] < 1 and kept["decontamination"] < 1
    last = sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()))
    assert last == sorted((r[0], r[2], r[3]) for r in expected([(r.doc_id, r.text) for r in docs.collect()]))
    assert default_tokenizer() and word_count


def test_odd_rows(spark, tmp_path):
    from tests.llm.helpers import DOCS, odd_rows

    d = table(spark, tmp_path, "documents", odd_rows())
    table(spark, tmp_path, "benchmark", [(1, "nothing of this")], "item_id long, text string")
    assert corpus_pipeline.run(spark, d).count() > 0
    e = table(spark, tmp_path / "e", "documents", [], DOCS)
    table(spark, tmp_path / "e", "benchmark", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, e).count() == 0
