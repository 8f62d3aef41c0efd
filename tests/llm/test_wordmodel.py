import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import kinfold.llm.wordmodel as wm
from kinfold.llm.common import Scratch
from kinfold.llm.quality import FACTS, base_counts, rate
from kinfold.llm.wordmodel import expand, half_of, shapes, squeeze, squeeze_sorted, expand_sorted, word_scores
from tests.llm.helpers import odd_rows, table


def tokens(text):
    """Lower-cased words, every character from U+3000 to U+9FFF a word of its own."""
    return re.findall("[\u3000-\u9fff]|[^\x20\x09-\x0d\u3000-\u9fff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def outlines(text):
    def sign(c):
        return "a" if c > "\x7f" or "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else c

    return [re.sub(r"(.)\1+", r"\1", "".join(map(sign, w)), flags=re.S) for w in re.findall("[^\x20\x09-\x0d]+", text)]


def plain(rows, scored, words):
    """Mean log probability under the model of ``rows`` by definition, ``words`` the vocabulary's size."""
    bi = Counter(g for t in rows for g in zip(["", *t], t))
    uni = Counter(w for _, w in bi)

    def discount(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return [0, 0.5, 0.75, 0.9]
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.7]
        return [0, *[min(max(x, 0.01), k + 0.99) for k, x in enumerate(raw)]]

    d1, d2, by = discount(uni), discount(bi), defaultdict(list)
    for (v, _), n in bi.items():
        by[v].append(n)
    total = sum(uni.values())

    def p(v, w):
        one = (uni.get(w, 0) - d1[min(uni.get(w, 0), 3)] + sum(d1[min(n, 3)] for n in uni.values()) / words) / total if total else 1 / words
        if v not in by:
            return one
        n = bi.get((v, w), 0)
        return (n - d2[min(n, 3)] + sum(d2[min(m, 3)] for m in by[v]) * one) / sum(by[v])

    return [math.fsum(math.log(p(*g)) for g in zip(["", *t], t)) / len(t) if t else 0.0 for t in scored]


def texts_of(rng, n):
    return sorted({" ".join(rng.choice(["a", "b", "C", "dé", "x1", "the&&", "日本", "|", "f."]) * rng.choice((1, 1, 2)) for _ in range(rng.randint(1, 40))) for _ in range(n)})


def test_scores_are_those_of_the_other_half(spark, monkeypatch):
    for chunk, seed in ((1 << 20, 3), (300, 4)):
        monkeypatch.setattr(wm, "CHUNK", chunk)
        texts = texts_of(random.Random(seed), 50) + ["", " \n"]
        docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts) for lang in ("en", None)], "doc_id long, text string, lang string").repartition(3)
        halves = {(r.doc_id, r.lang): r.h for r in docs.withColumn("h", half_of()).collect()}
        got = {(r.doc_id, r.lang): r for r in word_scores(docs, base_counts, FACTS, Scratch(spark, "t")).collect()}
        assert len(got) == len(halves)
        for cut, name in ((tokens, "word_logp"), (outlines, "shape_logp")):
            split = [cut(t) for t in texts]
            vocabulary = len({w for t in split for w in t})
            for lang in ("en", None):
                for half in (0, 1):
                    own, other = ([i for i in range(len(texts)) if halves[i, lang] == h] for h in (half, 1 - half))
                    for i, want in zip(own, plain([split[k] for k in other], [split[k] for k in own], vocabulary), strict=True):
                        assert math.isclose(got[i, lang][name], want, rel_tol=1e-9), (texts[i], name)
        for (i, _), r in got.items():
            assert tuple(r[f] for f in FACTS) == base_counts(texts[i]) and r.n_scored == len(tokens(texts[i]))


def test_packing():
    rng = np.random.default_rng(0)
    for a in (rng.integers(0, 1 << 48, 1000, np.uint64), np.zeros(0, np.uint64), np.zeros(5, np.uint64), np.array([(1 << 48) - 1], np.uint64)):
        assert (expand(squeeze(a)) == a).all() and (expand_sorted(squeeze_sorted(np.sort(a))) == np.sort(a)).all()
    assert shapes("Ab&&  c99É".encode()) == b"Aa& a9a" and shapes(b"") == b""


def test_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{table(spark, tmp_path, 'documents', odd_rows())}/documents.parquet")
    rows = word_scores(docs, base_counts, FACTS, Scratch(spark, "t")).collect()
    assert len(rows) == len(odd_rows()) and all(math.isfinite(r.word_logp) and math.isfinite(r.shape_logp) for r in rows)


def test_results_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r for r in rate(docs.repartition(1)).collect()}
    monkeypatch.setattr(wm, "CHUNK", 20_000)
    many = {r.doc_id: r for r in rate(docs.repartition(7)).collect()}
    assert all(many[k].kept == one[k].kept and math.isclose(many[k].word_logp, one[k].word_logp, rel_tol=1e-9) for k in one)


def test_model_grows_with_the_corpus_and_sees_word_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")

    def pairs(df):
        chunks = wm.chunked(df, base_counts, Scratch(spark, "t")).where("layer = 0").collect()
        return len(np.unique(np.concatenate([wm.opened(r.asDict(True)).keys for r in chunks])))

    assert pairs(docs) > 2 * pairs(docs.where("doc_id % 3 = 0"))
    good = [r for r in docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").collect() if len(r.text.split()) >= 100][:40]
    rng, mixed = random.Random(2), []
    for r in good:
        words = r.text.split()
        rng.shuffle(words)
        mixed.append((-10 - r.doc_id, " ".join(words), r.lang))
    judged = {r.doc_id: r.perplexity for r in rate(docs.unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))).where(F.col("doc_id").isin([r.doc_id for r in good] + [m[0] for m in mixed])).collect()}
    assert sum(judged[-10 - r.doc_id] > judged[r.doc_id] for r in good) > 0.9 * len(good)
