import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm.decontaminate import Shard, TestSuffixes, op5_suffix_arrays, scan, words_of
from tests.llm.helpers import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    of = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - window + 1) if w else 0):
                of.setdefault(tuple(w[k : k + window]), set()).add(i)
    lengths = {len(k) for k in of}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := of.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def occurs(part, item_words):
    return any(item_words[k : k + len(part)] == part for k in range(len(item_words) - len(part) + 1))


def longest(text, items, window):
    """(words, place, item, place there) of the longest run that starts with a full window and occurs in an
    item, or of a whole item shorter than a window; ties by place, then item."""
    w, split = words(text), [(i, words(t)) for i, t in items if i is not None]
    found = [(0, 0, None, None)]
    for i, x in split:
        for k in range(len(x)):
            for p in range(len(w)):
                n = 0
                while p + n < len(w) and k + n < len(x) and w[p + n] == x[k + n]:
                    n += 1
                if n >= window or n == len(x):
                    found.append((-n, p, i, k))
    best = min(found)
    return -best[0], *best[1:]


def found(df, docs=None, items=(), window=13):
    rows = df.collect()
    if docs is not None:
        want = [longest(r[1], items, window) for r in docs]
        assert sorted((str(r.doc_id), r.match_words or 0, r.match_at or 0, r.match_item, r.match_item_at) for r in rows) == sorted((str(d[0]), *m) for d, m in zip(docs, want, strict=True))
    return sorted((tuple(r)[:6] for r in rows), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_documents(spark, size):
    sf = f"/root/testdata/{size}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = found(op5_suffix_arrays(spark, sf))
    assert rows == brute(docs, items)
    assert any(r[5] for r in rows)


ODD_ITEMS = [(1, "The cat"), (1, "the CAT"), (2, None), (3, "  !! "), (10, " ".join(f"w{i}" for i in range(30))), (None, "no id"), (4, "Größe, über 日本"), (5, "cat")]
ODD_DOCS = [
    (0, "a cat; THE-CAT sat the", "x"), (0, "a cat; THE-CAT sat the", "x"), (1, None, None), (2, "", "y"), (3, "größe über 日本 x", "y"),
    (4, "z " * 500 + " ".join(f"w{i}" for i in range(5, 25)) + " w9 w10", "y"), (None, "no id", "y"), (6, " ".join(f"w{i}" for i in range(18)) + " " + " ".join(f"w{i}" for i in range(17, 30)), "q"),
]


def test_odd_rows_blocks_and_empty(spark, tmp_path):
    d = table(spark, tmp_path, "documents", ODD_DOCS, DOCS)
    table(spark, tmp_path, "benchmark", [(*r, "q") for r in ODD_ITEMS], ITEMS)
    want = brute([r[:2] for r in ODD_DOCS], [(i, t) for i, t in ODD_ITEMS])
    assert found(op5_suffix_arrays(spark, d), [r[:2] for r in ODD_DOCS], ODD_ITEMS) == want
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.createDataFrame([(*r, "q") for r in ODD_ITEMS], ITEMS)
    assert found(scan(docs, items, block_bytes=10), [r[:2] for r in ODD_DOCS], ODD_ITEMS) == want
    clash = scan(docs.withColumn("_found", F.lit(1)), items, block_bytes=10, keep_rows=True)
    assert clash.columns[-1] == "_found" and clash.count() == sum(not r[5] for r in want)
    kept = scan(docs, items, keep_rows=True)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in want)
    e = table(spark, tmp_path / "e", "documents", [], DOCS)
    table(spark, tmp_path / "e", "benchmark", [], ITEMS)
    assert op5_suffix_arrays(spark, e).count() == 0
    assert all(r.n_hit == 0 for r in scan(docs, spark.read.parquet(f"{e}/benchmark.parquet")).collect())


def test_longest_matches():
    text = " ".join(f"w{i}" for i in range(20))
    assert Shard([words_of("x y " + text + " w3")], TestSuffixes([(7, "q " + text)], window=4)).hits()[2] == [(20, 2, 7, 1)]
    tests = TestSuffixes([(3, "w0 w1 w2 zz w1 w2 w3")], window=3)
    assert Shard([words_of("w0 w1 w2 w3"), words_of("a b")], tests).hits()[2] == [(3, 0, 3, 0), None]
    shared = [(i, f"own{i} " + text) for i in range(50)]
    items, _, best = Shard([words_of(text), words_of("own9 " + text)], TestSuffixes(shared, window=13)).hits()
    assert items == [list(range(50))] * 2 and best[1] == (21, 0, 9, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcX"), max_size=12), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=5))
def test_against_brute_force(docs, items):
    docs, items = [" ".join(d) for d in docs], [(i, " ".join(x)) for i, x in enumerate(items)]
    own, hit, best = Shard([words_of(d) for d in docs], TestSuffixes(items, window=3)).hits()
    want = {r[0]: r for r in brute(list(enumerate(docs)), items, 3)}
    for k in range(len(docs)):
        assert (len(hit[k]), len(own[k])) == want[k][2:4]
        assert (best[k] or (0, 0, None, None)) == longest(docs[k], items, 3)
