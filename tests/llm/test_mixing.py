import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinfold.llm.mixing import apportion, mix, mixed, narrow, op9_sainte_lague, shard_of, targets
from tests.llm.helpers import DOCS, odd_rows, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def check(rows, docs, near=0.02):
    sizes, ids = defaultdict(int), {}
    for d, t, s in docs:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        ids.setdefault(d, s)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken = defaultdict(int)
    for r in rows:
        s = ids[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= near * want[s] + 3, (s, taken[s], want[s])


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op9_sainte_lague(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, docs, near=0.05)
    assert sorted(map(str, rows)) == sorted(map(str, op9_sainte_lague(spark, sf).collect()))


def plain(rows, block, shard_words):
    """The mix by its definition, block by block and word by word: the multiset of (doc_id, size, taken)."""
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(r["size"] for r in rows if r.source == s) for s in sources}
    want = targets([words[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))])

    def seats(wanted, n):
        got = [0] * len(wanted)
        for _ in range(n if sum(wanted) else 0):
            i = max((i for i in range(len(got)) if wanted[i]), key=lambda i: (Fraction(wanted[i]) / (2 * got[i] + 1), -i))
            got[i] += 1
        return got

    out = []
    for s, q in zip(sources, seats(want, sum(words.values()) // block), strict=True):
        shards = max(1, words[s] // shard_words)
        cells = defaultdict(list)
        for r in rows:
            if r.source == s:
                (cells[r.shard] if r["size"] else cells[None]).append(r)
        out += [(r.doc_id, 0, 0) for r in cells.pop(None, [])]
        assert all(0 <= c < shards for c in cells)
        own = sorted(cells)
        for c, blocks in zip(own, seats([sum(r["size"] for r in cells[c]) for c in own], q), strict=True):
            line = [i for i, r in enumerate(sorted(cells[c], key=lambda r: (r.h, r.doc_id or 0))) for _ in range(r["size"])]
            taken = defaultdict(int)
            for k in range(min(blocks * block, 3 * len(line))):
                taken[line[k % len(line)]] += 1
            out += [(r.doc_id, r["size"], taken[i]) for i, r in enumerate(sorted(cells[c], key=lambda r: (r.h, r.doc_id or 0)))]
    return Counter(out)


def placed(df, shard_words, seed=5):
    """Rows with their seeded hash and shard; only the hashes are Spark's."""
    rows = narrow(df, seed)
    n = rows.groupBy("source").agg(F.sum("size").alias("w")).withColumnRenamed("source", "_s")
    shards = F.greatest(F.lit(1), F.expr(f"cast(w div {shard_words} as int)"))
    return rows.join(n, rows.source.eqNullSafe(n._s)).withColumn("shard", shard_of(F.col("h"), shards, seed)).collect()


@pytest.mark.parametrize("block,shard_words", [(32, 1 << 16), (8, 5000), (100, 300)])
def test_every_word_follows_from_the_blocks(spark, block, shard_words):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame(odd_rows() + [(None, "twin twin", "en", "a", 1, 1, "z")] * 7, DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (df, df.limit(60).unionByName(odd)):
        got = Counter((r.doc_id, r["size"], r.taken) for r in mix(docs, block_words=block, shard_words=shard_words).collect())
        assert got == plain(placed(docs, shard_words), block, shard_words)


def test_mixed_rows_hold_the_words_that_the_mix_takes(spark):
    rows = odd_rows() + [(i, f"w{i} " * (i % 7 + 1), "en", "ab"[i % 2], 1, 1, "q") for i in range(40, 90)] + [(None, "twin  twin\nx", "en", "a", 1, 1, "z")] * 9
    docs = spark.createDataFrame([(*r, 1, "c", "h", 2, 3) for r in rows], DOCS + ", _i int, copies string, h string, cut int, `a.b` int")
    for options in ({"block_words": 1}, {"block_words": 3, "shard_words": 20}):
        out = mixed(docs, **options)
        assert out.columns == docs.columns
        got = defaultdict(int)
        for r in out.collect():
            assert r["a.b"] == 3 and r.h == "h"
            got[r.doc_id, r.source] += len(WORD.findall(r.text or ""))
        want = defaultdict(int)
        for r in mix(docs, **options).collect():
            want[r.doc_id, r.source] += r.taken
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        assert sum(not WORD.findall(r.text or "") for r in out.collect()) == sum(not WORD.findall(r[1] or "") for r in rows)
        whole = {r[1] for r in rows}
        assert all(any(w is not None and w.startswith(r.text) for w in whole) for r in out.collect() if r.text)


def test_odd_rows_and_empty(spark, tmp_path):
    rows = op9_sainte_lague(spark, table(spark, tmp_path, "documents", odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert op9_sainte_lague(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


def test_targets_stop_at_three_times_the_size():
    assert targets([100, 10, 1000], [5, 2, 1]) == [300.0, 30.0, 780.0]
    assert targets([8, 8, 8], [5, 2, 1]) == [15.0, 6.0, 3.0]
    assert targets([0, 5], [5, 2]) == [0.0, 5.0]


def test_apportion_is_the_seat_by_seat_method():
    def plain(w, seats):
        got = [0] * len(w)
        for _ in range(seats):
            i = max(range(len(w)), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        return got

    for w in ([5.0, 3.0, 1.0], [100.0, 1.0, 1.0, 1.0], [7.0, 7.0, 7.0], [0.0, 2.0], [53.0, 24.0, 23.0], [1e6] + [1.0] * 50):
        for seats in (0, 1, 2, 5, 10, 99):
            assert apportion(w, seats) == plain(w, seats), (w, seats)


def test_a_long_document_shuts_out_no_others(spark):
    for long, shard_words in ((20_000, 1 << 14), (100_000, 1 << 16), (1_000_000, 1 << 16)):
        rows = [(0, "w " * long, "a")] + [(i, "w " * 300, "a") for i in range(1, 301)] + [(i, "w " * 500, "b") for i in range(400, 520)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        check(mix(df, shard_words=shard_words).collect(), rows, near=0.001)
