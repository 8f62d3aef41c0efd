import math
import random
import re
from collections import Counter

import numpy as np

from kinfold.llm.quality import BANDS, base_counts, op7_kneser_ney, rate
from tests.llm.helpers import DOCS, odd_rows, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = t.split("\n")
    threes = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if threes[x] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_base_counts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in [*texts, None, "", "a a a a", "x\n\n\nx\n y\n y", "a b c a b c d a b c", "é#\x0b|é   z"]:
        assert base_counts(t) == plain_base(t)


SCRIPTS = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщыэюя", "zh": "的一是不了人我在有他这中大来上个国和也子时道出而要于就下得可"}


def test_every_script_has_bands_of_its_own(spark):
    rng, rows = random.Random(1), []
    for lang, letters in SCRIPTS.items():
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(60)]
        for _ in range(80):
            rows.append((len(rows), " ".join(rng.choice(words[:20] if rng.random() < 0.6 else words) for _ in range(90)), lang))
    start = len(rows)
    for lang in SCRIPTS:  # another language's text under this label
        other = next(r[1] for r in rows if r[2] != lang)
        rows.append((len(rows), other, lang))
    out = {r.doc_id: r for r in rate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(out[i].kept for i in range(start)) > 0.97 * start
    assert not any(out[i].kept for i in range(start, len(rows)))


def plain_bands(rows):
    """The verdict by its definition, from the scores."""
    limits = {}
    for column, (low, high, floor) in BANDS.items():
        for lang in {r.lang for r in rows}:
            own = sorted(math.floor(r[column] * 1000) for r in rows if r.lang == lang and r.n_scored)
            if own:
                q1, q2, q3 = np.percentile(own, [25, 50, 75]) / 1000
                dev = max((q3 - q1) / 1.349, floor)
                limits[column, lang] = q2 - low * dev, q2 + high * dev
    return {
        r.doc_id: not r.base_failed and all((b := limits.get((c, r.lang))) is not None and b[0] <= r[c] <= b[1] for c in BANDS) for r in rows
    }


def test_verdict_is_that_of_the_bands(spark):
    rows = rate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert {r.doc_id: r.kept for r in rows} == plain_bands(rows)


def test_documents_and_bands(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = op7_kneser_ney(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        b = plain_base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    sound = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(sound) / len(sound) > 0.98
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.integers(33, 126, 600)) + " " + " ".join("qzx" + str(i) for i in range(60))
    judged = {r.doc_id: r for r in rate(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-5, noise, "en")], "doc_id long, text string, lang string"))).collect()}
    assert not judged[-5].kept and not judged[-5].base_failed


def test_odd_rows_and_empty(spark, tmp_path):
    rows = op7_kneser_ney(spark, table(spark, tmp_path, "documents", odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert op7_kneser_ney(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


def test_bands_reject_what_labels_call_bad(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sound = [r for r in op7_kneser_ney(spark, sf).collect() if r.doc_id in label and not r.base_failed]
    bad, good = ([r.kept for r in sound if label[r.doc_id] == q] for q in (0, 1))
    assert sum(bad) < 0.4 * len(bad) and sum(good) > 0.98 * len(good), (sum(bad), len(bad), sum(good), len(good))
