import math
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from kinfold.llm.sharding import Node, grid_tree, lines, op4_hash_tree, place, shard_documents, shares
from tests.llm.helpers import DOCS, odd_rows, table


def check(rows, docs):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs
    )
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and (r.grown_shard == r.shard or r.grown_shard == 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op4_hash_tree(spark, sf).collect()
    check(rows, docs)
    assert any(r.grown_shard == 24 for r in rows)


def test_odd_rows_and_empty(spark, tmp_path):
    check(op4_hash_tree(spark, table(spark, tmp_path, "documents", odd_rows())).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert op4_hash_tree(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


def test_every_growth_step_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(3000)
    at = df.select("id", *[place(F.col("id"), grid_tree(n)).alias(f"s{n}") for n in range(11, 28)]).collect()
    for n in range(11, 27):
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in at)


def test_weights_shape_the_draw_and_confine_movement(spark):
    def tree(w):
        return Node(children=(Node(children=(Node(shard=0), Node(shard=1))), Node(weight=w, children=(Node(shard=2), Node(shard=3)))))

    rows = spark.range(20000).select(place(F.col("id"), tree(1)).alias("a"), place(F.col("id"), tree(3)).alias("b")).collect()
    share = sum(r.b >= 2 for r in rows) / len(rows)
    assert abs(share - 0.75) < 0.02
    assert all(r.a == r.b or r.b >= 2 for r in rows)
    assert all(r.b == r.a for r in rows if r.a >= 2)


def chained(*values):
    """Spark's hash of whole numbers (strings of bytes as they are), by the public algorithm."""
    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed=h)
    return h


def expected(key, at, seed=17):
    """The descent in plain arithmetic: best clock of the regions, then the part under its mark."""
    best = None
    for k, line in enumerate(at):
        u = [((chained((seed, 4), (key, 8), (k, 4), (0, 4), (i, 4)) >> 11) + 0.5) / 2**53 for i in range(5)]
        r, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
        mark = min(math.exp(r * (math.floor(math.log(line.length) / r + u[4]) - u[4])), line.length)
        draw = (c / (mark * math.exp(r)) / line.weight, k, mark)
        best = min(best, draw) if best else draw
    return next((s for a, b, s in at[best[1]].parts if a < best[2] <= b), None)


def test_placement_is_the_descent_worked_out_apart(spark):
    for tree in (grid_tree(24), grid_tree(29, 2, 3), Node(children=(Node(weight=2.5, children=(Node(shard=0, weight=3), Node(weight=0.5, children=(Node(shard=1), Node(shard=2))))), Node(children=(Node(shard=3),))))):
        rows = spark.range(1500).select("id", place(F.col("id"), tree).alias("s")).collect()
        assert all(r.s == expected(r.id, lines(tree)) for r in rows)
        share = shares(Node(children=tuple(Node(weight=x.weight, children=x.children) for x in tree.children)))
        total = sum(share.values())
        count = Counter(r.s for r in spark.range(40_000).select(place(F.col("id"), tree).alias("s")).collect())
        assert all(abs(count[s] / 40_000 - w / total) < 0.012 for s, w in share.items())


def test_weights_inside_a_region_move_rows_only_where_they_change(spark):
    def tree(*w):
        return Node(children=(Node(children=tuple(Node(shard=i, weight=x) for i, x in enumerate(w))), Node(children=(Node(shard=9, weight=2),))))

    first = lines(tree(1, 1, 1))
    grown, less = lines(tree(1, 2.5, 1), first), lines(tree(1, 0.25, 1), first)
    gone = lines(tree(1, 0, 1), first)
    rows = spark.range(20_000).select(*[place(F.col("id"), x).alias(n) for n, x in (("a", first), ("g", grown), ("l", less), ("o", gone))]).collect()
    assert all(r.g in (r.a, 1) for r in rows) and all(r.l == r.a or r.a == 1 for r in rows) and all(r.o == r.a or r.a == 1 for r in rows)
    for name, w in (("g", 2.5), ("l", 0.25), ("o", 0)):
        assert abs(sum(r[name] == 1 for r in rows) / len(rows) - w / (4 + w)) < 0.012


def test_many_equal_rows_get_slots(spark):
    df = spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    rows = shard_documents(df, grid_tree(3)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 25_050 and all(sorted(v) == list(range(len(v))) for v in by.values())
