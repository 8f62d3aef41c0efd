import random
import re

import numpy as np
import pytest

import kinfold.llm.components as cc
import kinfold.llm.neardup as nd
from kinfold.llm.common import Scratch
from kinfold.llm.components import components
from kinfold.llm.neardup import deduplicated, near_duplicates, op6_hamming_join, shingle_sets, signature
from tests.llm.helpers import DOCS, odd_rows, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """(doc_id, n, component) by comparing every pair that shares a shingle."""
    sets = [plain_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for j in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        a, b = j
        same = len(sets[a] & sets[b])
        if 100 * same >= 85 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_documents(spark, size):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()]
    assert found(op6_hamming_join(spark, f"/root/testdata/{size}")) == brute(docs)


def test_odd_rows_and_empty(spark, tmp_path):
    d = table(spark, tmp_path, "documents", odd_rows())
    assert found(op6_hamming_join(spark, d)) == brute([(r[0], r[1]) for r in odd_rows()])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = deduplicated(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {0, 2, 3, 4, 5, 7, None}
    assert op6_hamming_join(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


@pytest.mark.parametrize("small,block", [(128, 512), (6, 5), (2, 3)])
def test_edited_copies_in_small_blocks(spark, monkeypatch, small, block):
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(3)
    docs, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 25)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            docs.append((n, " ".join(w)))
            n += 1
    rng.shuffle(docs)
    assert found(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_one_doc_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = [(1, a), (1, b), (2, a), (3, b), (None, a + " more"), (None, "alone without an id")]
    assert found(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_one_row_of_each_component_stays(spark):
    a, b, x = "a one of its own kind here", "b two of its own kind there", "x words"
    rows = [(1, b), (5, b), (5, a), (None, b), (7, x), (7, x), (None, "only without id"), (None, "only without id"), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, node int, _row int, root int, `doc.x` int")
    out = deduplicated(docs)
    assert out.columns == docs.columns
    want = [(1, b), (5, a), (7, x), (None, "only without id"), (8, None), (8, None), (9, "")]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(want, key=str)


def test_index_and_filter_have_one_threshold(spark):
    """Signatures at any distance up to the threshold share a key, wherever the errors are."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, nd.SYMBOLS).astype(np.uint8)
    rows = [(0, bytearray(base.tobytes()))]
    for i in range(1, 120):
        other = base.copy()
        at = rng.permutation(nd.SYMBOLS)[: nd.MAX_DISTANCE]
        other[at] ^= 1
        rows.append((i, bytearray(other.tobytes())))
    keys = {}
    for r in nd.filed(spark.createDataFrame(rows, "node long, sig binary")).collect():
        keys.setdefault(r.node, set()).add(r.key)
    assert all(keys[0] & keys[i] for i in range(1, 120))


def test_shingles_and_signatures():
    texts = ["A b\tc d e f g", None, "", "a b", "a b c d e f g a b c d e f g", "é ö ü ä ß É", "x " * 3000, "ab c d e f"]
    got = shingle_sets(texts)
    assert [len(g) for g in got] == [len(plain_set(t)) for t in texts]
    assert (got[0] == shingle_sets(["a B C d e f g"])[0]).all()
    rng = np.random.default_rng(0)
    wrong = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400, np.uint64)
        a, b = pool[:370], np.concatenate([pool[30:370], pool[370:]])
        wrong.append(sum(x != y for x, y in zip(signature(a), signature(b))) / nd.SYMBOLS)
    assert abs(np.mean(wrong) - (1 - 340 / 400)) < 0.01


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc"), "t").collect()
    assert {r.node: r.root for r in got} == {x: top(x) for x in up if any(x in e and e[0] != e[1] for e in edges)} and len(got) == len({r.node for r in got})


def by_search(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    out = {}
    for start in sorted(near):
        todo = [] if start in out else [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def awkward_edges():
    rng = random.Random(2)
    some = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)]
    path = [(1000 + i, 1000 + (i + 1) * 7919 % 401) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(0, 400, 3)]
    star = [(9000, 5000 + i) for i in range(500)]
    return [*some, *path, *star, *star[:50], (1 << 62, -(1 << 62))]


def test_a_small_edge_table_is_not_shuffled_round_by_round(spark, monkeypatch):
    written, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name, *a: written.append(name) or put(self, df, name, *a))
    edges = awkward_edges()
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc"), "t").collect()
    assert {r.node: r.root for r in got} == by_search(edges) and len(got) == len(by_search(edges))
    assert len(written) <= 2
    assert components(spark.createDataFrame([(4, 4)], "u long, v long"), Scratch(spark, "cc"), "t").count() == 0


@pytest.mark.parametrize("whole,ends", [(0, False), (1300, True)])
def test_components_by_rounds(spark, monkeypatch, whole, ends):
    """Of a table that is too large for one task, for good or until a round has made it smaller."""
    written, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name, *a: written.append(name) or put(self, df, name, *a))
    monkeypatch.setattr(cc, "WHOLE", whole)
    edges = awkward_edges()
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc"), "t").collect()
    assert {r.node: r.root for r in got} == by_search(edges) and len(got) == len(by_search(edges))
    assert "t1" in written and ("t-roots" in written) == ends


def test_least_reachable():
    rng = np.random.default_rng(4)
    for n, m in ((3, 2), (50, 30), (2000, 1500), (2000, 4000)):
        edges = rng.integers(0, n, (m, 2))
        edges = edges[edges[:, 0] != edges[:, 1]]
        nodes, roots = cc.least_reachable(edges[:, 0], edges[:, 1])
        assert dict(zip(nodes.tolist(), roots.tolist())) == by_search(edges.tolist())
