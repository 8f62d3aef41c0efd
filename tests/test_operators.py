"""Hand-made cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from kinfold.operators import decisions as de
from kinfold.operators import evaluation as ev
from kinfold.operators import folds as fo
from kinfold.operators import learning as le
from kinfold.operators import pairs as pa
from kinfold.operators import reports as rp
from kinfold.operators import retrieval as rt

PAIR = "country int, src int, rec long, s1 long, p double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


def test_arbitration_and_thresholds(spark):
    t = frame(spark, [(0, 2, 0, 0, 0.9), (0, 2, 0, 1, 0.95), (0, 2, 1, 1, 0.6), (0, 3, 0, 1, 0.4)], PAIR)
    a = de.arbitrated(t)

    def kept(*args):
        return {k for k, r in by(a.select("*", de.threshold_rule(*args).alias("keep")).collect(), "src", "rec", "s1").items() if r.keep}

    assert {k for k, r in by(a.collect(), "src", "rec", "s1").items() if r.winner} == {(2, 0, 1), (2, 1, 1), (3, 0, 1)}
    assert kept(0.5, 0.5) == {(2, 0, 1), (2, 1, 1)} and kept(0.99, 0.1) == set() and kept(0.5, 0.5, False) == {(2, 0, 0), (2, 0, 1), (2, 1, 1)}


def test_f_half(spark):
    cases = [((0, 0, 0), 1), ((0, 1, 0), 0), ((1, 0, 0), 0), ((1, 1, 1), 1), ((4, 3, 3), 0.9375), ((2, 3, 2), 0.714286)]
    rows = frame(spark, [c for c, _ in cases], "k int, m int, tp int").select(de.f_half(F.col("k"), F.col("m"), F.col("tp")).alias("f")).collect()
    assert [round(r.f, 6) for r in rows] == [f for _, f in cases]


def test_per_entity_and_oracle(spark):
    truth = frame(spark, [("a", "1"), ("a", "2"), ("b", "3")], "s1 string, rid string")
    pred = frame(spark, [("a", "1"), ("a", "1"), ("x", "9"), ("c", "7")], "s1 string, rid string")
    e = frame(spark, [("a",), ("b",), ("c",)], "s1 string")
    got = by(ev.per_entity(truth, pred, e).collect(), "s1")
    assert [(got[k,].k, got[k,].m, got[k,].tp) for k in "abc"] == [(2, 1, 1), (1, 0, 0), (0, 1, 0)]
    best = by(ev.oracle(truth, pred, e).collect(), "s1")
    assert best["a",].f05 == pytest.approx(1.25 * 0.5 / 0.75) and best["b",].f05 == 0 and best["c",].f05 == 1


def test_group_stats(spark):
    t = frame(spark, [(1, 0, 0.2), (1, 1, 0.9), (1, 2, 0.5), (2, 3, 0.4)], "g int, i int, p double")
    r = [x for _, x in sorted(by(pa.group_stats(t, ["g"], "i", extra=(F.col("p") > 0.3).cast("int")).collect(), "i").items())]
    assert [x["rank"] for x in r] == [2, 0, 1, 0] and [x.second for x in r] == [0.5, 0.5, 0.5, 0] and [x.n for x in r] == [3, 3, 3, 1] and [x.extra_sum for x in r] == [2, 2, 2, 1]


def test_competition(spark):
    t = frame(spark, [(0, 2, 0, 0, 0.3), (0, 2, 0, 1, 0.8), (0, 2, 1, 1, 0.6), (0, 3, 0, 1, 0.7)], PAIR)
    r = by(pa.competition_features(t).collect(), "src", "rec", "s1")
    o = [r[2, 0, 0], r[2, 0, 1], r[2, 1, 1], r[3, 0, 1]]
    assert [round(x.p_minus_rec_other, 6) for x in o] == [-0.5, 0.5, 0.6, 0.7]
    assert [x.s1src_n05 for x in o] == [0, 2, 2, 1] and [x.s1_n05 for x in o] == [0, 3, 3, 3] and [x.s1_pmax_other_src for x in o] == [0, 0.7, 0.7, 0.8] and [x.s1_n_best for x in o] == [0, 3, 3, 3]


def test_expected_f(spark):
    q = [(0, 0.99), (0, 0.95), (0, 0.05), (1, 0.02), (2, 0.9)]
    t = frame(spark, [(0, 2, i, s, p) for i, (s, p) in enumerate(q)], PAIR)
    assert [r.keep for r in de.expected_f(de.arbitrated(t)).orderBy("rec").collect()] == [True, True, False, False, True]


def test_margins(spark):
    t = frame(spark, [(0, 2, 0, 0, 2.0), (0, 2, 0, 1, -1.0), (0, 2, 1, 0, 3.0), (0, 2, 2, 0, None)], PAIR.replace("p double", "ce double"))
    r = by(pa.scored_margin(t).collect(), "rec", "s1")
    assert (r[0, 0].ce_minus_rec_other, r[0, 1].ce_minus_rec_other, r[1, 0].ce_minus_rec_other, r[2, 0].ce_minus_rec_other) == (3, -3, None, None)


def test_union(spark):
    tf = frame(spark, [(0, 2, 1, 1, 0.5, 0, 0.5), (0, 2, 2, 1, 0.4, 1, 0.4)], "country int, src int, rec long, s1 long, score double, rank int, cos double")
    d = frame(spark, [(0, 2, 1, 1, 0.9, 0, -1), (0, 2, 3, 1, 0.8, -1, 2)], "country int, src int, rec long, s1 long, cos double, drank_rec int, drank_s1 int")
    r = by(pa.union_candidates(tf, d).collect(), "rec")
    assert len(r) == 3 and r[1,].cos == 0.5 and r[3,].score == 0 and r[3,]["rank"] == 6 and r[3,].drank_rec == 6 and r[1,].n_retrievers == 2 and r[2,].in_dense == 0


def test_distance(spark):
    t = frame(spark, [(0, 2, 0, 0, 0.6), (0, 2, 0, 1, 0.95), (0, 2, 1, 1, 0.6), (0, 2, 2, 1, 0.4)], PAIR)
    got = [r.d for r in de.arbitrated(t).withColumn("d", de.decision_distance(0.7, 0.5)).orderBy("rec", "s1").collect()]
    assert [round(x, 6) for x in got] == [math.inf, 0.25, 0.1, 0.1]


def test_keys_beyond_their_bits_raise(spark):
    with pytest.raises(Exception, match="exceeds"):
        frame(spark, [(0, 2, 1 << 23, 1, 0.5)], PAIR).select(pa.packed_pair_checked()).collect()


def test_packed_keys_equal_sql_beyond_their_bits(spark, tmp_path):
    import duckdb

    from kinfold.plans import catalog

    spark.range(1, 31).selectExpr("id as c_custkey", "concat('c', id) as c_name", "'m' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(5, 3), ((1 << 22) - 1, 3), (1 << 22, 3), ((1 << 22) + 5, 3), ((1 << 23) + 5, 3), (9_000_000, (1 << 21) - 1), (9_000_001, 1 << 21), (7, 3_000_000), (8, None)]
    frame(spark, orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["packed_keys"](spark, str(tmp_path))
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = duck.execute(catalog.ORACLES["packed_keys"])
    names = [d[0] for d in want.description]
    rows = got.select(*names).collect()
    assert sorted(str(tuple(r)) for r in rows) == sorted(map(str, want.fetchall()))
    assert {r.rec for r in rows} == {rec for rec, _ in orders}


@pytest.mark.parametrize("row", [(0, 2, 1 << 42, 1, 0.5), (0, 2, -1, 1, 0.5), (0, 1 << 20, 1, 1, 0.5), (0, -2, 1, 1, 0.5)])
def test_keys_that_would_lose_bits_raise(spark, row):
    with pytest.raises(Exception, match="cannot be shifted"):
        frame(spark, [row], PAIR).select(pa.packed_key("pair")).collect()


def test_missing_fold_raises(spark):
    e = frame(spark, [(0, 1, 0)], "country int, s1 long, fold int")
    with pytest.raises(Exception, match="no fold"):
        pa.with_fold(frame(spark, [(0, 2, 1, 5, 0.5)], PAIR), e).collect()


def test_siblings(spark):
    t = frame(spark, [(0, "subway", True), (1, "subway", True), (2, "subway", False), (3, "cafe", True), (4, "", True), (5, "cafe", False)], "i long, n string, ok boolean")
    assert [r.sibling for r in fo.next_sibling(t, "n", "i", F.col("ok")).orderBy("i").collect()] == [1, 0, -1, -1, -1, -1]


def test_folds_are_even_and_whole(spark):
    e = spark.range(1003).select((F.col("id") % 3).alias("country"), F.col("id").alias("s1"), (F.col("id") % 9).alias("k"))
    got = fo.assign_folds(e).groupBy("country", "k_bucket", "fold").count().collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r.country, r.k_bucket), []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def test_budget_takes_whole_keys(spark):
    t = spark.range(500).select((F.col("id") % 37).alias("e"), "id")
    got = fo.within_budget(t, "e", 200, F.xxhash64("e"))
    per = {r.e: r["count"] for r in got.groupBy("e").count().collect()}
    full = {r.e: r["count"] for r in t.groupBy("e").count().collect()}
    assert per and all(full[k] == v for k, v in per.items()) and 200 - max(full.values()) <= sum(per.values()) <= 200


def test_find_rank(spark):
    lists = frame(spark, [(0, 4, 0), (0, 7, 1), (0, 9, 2), (2, 1, 0)], "q long, d long, rank int")
    wanted = frame(spark, [(0, 9), (0, 5), (2, 1), (1, 3)], "q long, d long")
    asked = frame(spark, [(0,), (2,)], "q long")
    r = by(rt.rank_of(wanted, lists, asked).collect(), "q", "d")
    assert [r[k]["rank"] for k in [(0, 9), (0, 5), (2, 1), (1, 3)]] == [2, -1, 0, -2]


def test_retrieval_does_not_depend_on_partitions(spark):
    import random

    rng = random.Random(0)
    rows = [("x", i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(6))) for i in range(60)]
    df = frame(spark, rows, "part string, id long, text string")
    a, b = df.where("id < 20"), df.where("id >= 20")
    one = sorted(map(tuple, rt.record_side(b, a, 3, 0.9).collect()))
    assert one == sorted(map(tuple, rt.record_side(b.repartition(7), a.repartition(3), 3, 0.9).collect()))
    assert max(r[4] for r in one) == 2
    short = frame(spark, [("x", 1, "one"), ("x", 2, ""), ("x", 3, "one two")], "part string, id long, text string")
    assert rt.record_side(short, short, 3, 1.0).count() > 0


def test_dense_and_two_sided(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 8))
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    got = {(r.q, r["rank"]): r.d for r in rt.dense_top_k(df.where("id < 7"), df, 4, block=16).collect()}
    for q in range(7):
        assert [got[q, k] for k in range(4)] == np.argsort(-(v @ v[q]), kind="stable")[:4].tolist()
    both = rt.two_sided(frame(spark, [(1, 2, 0.5, 0)], "q long, d long, score double, rank int"), frame(spark, [(1, 2, 0.5, 3), (4, 2, 0.1, 1)], "q long, d long, score double, rank int"))
    assert sorted(map(tuple, both.collect())) == [(1, 2, 0.5, 0, 3), (4, 2, 0.1, -1, 1)]
    assert rt.pair_cosine(frame(spark, [(0, 1)], "q long, d long"), df, df).first().cos == pytest.approx(float(v[0] @ v[1]), abs=1e-5)


def test_bootstrap_and_verdict(spark):
    d = spark.range(400).select(F.col("id").alias("key"), F.lit(0.01).alias("d"))
    b = ev.paired_bootstrap(d, 100)
    assert b["delta"] == pytest.approx(0.01) and b["significant"] and ev.verdict(b) == "KEEP"
    noise = spark.range(400).select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("d"))
    assert not ev.paired_bootstrap(noise, 100)["significant"] and ev.verdict({"ci_low": -1, "ci_high": -0.1, "delta": -0.5}) == "WORSE"
    with pytest.raises(ValueError):
        ev.paired_bootstrap(d.where("key < 0"), 10)


def test_config():
    assert ev.parse_config("NA:f20, A:r3") == [("NA", "fwd", 20), ("A", "rev", 3)]
    with pytest.raises(ValueError):
        ev.parse_config("NA:x2")


def test_cross_fit_never_sees_its_own_fold(spark):
    rows = [(i, i % 3, float(i % 7), int(i % 7 > 3) if i % 3 else int(i % 7 <= 3)) for i in range(300)]
    d = frame(spark, rows, "s1 long, fold int, x double, label int")
    p = le.cross_predict(le.cross_fit(d, ["x"], [0, 1, 2], kind="forest"), d, ["x"]).collect()
    own = [abs((r.p > 0.5) - r.label) for r in p if r.fold == 0]
    assert sum(own) / len(own) > 0.9  # fold 0 has its labels turned round, which its model never saw
    assert le.choose_ensemble({"a": 0.9, "b": 0.9004, "c": 0.91}, "a") == "c" and le.choose_ensemble({"a": 0.9, "b": 0.9004}, "a") == "a"
    assert le.shared_features([d], ["x", "y"]) == ["x"]


def test_gbt_stops_on_held_entities(spark):
    d = frame(spark, [(i, i % 2, float(i % 5), int(i % 5 > 2)) for i in range(200)], "s1 long, fold int, x double, label int")
    models = le.cross_fit(d, ["x"], [0, 1], stop_share=0.2)
    out = le.cross_predict(models, d, ["x"]).collect()
    assert sum(abs((r.p > 0.5) - r.label) for r in out) == 0 and le.importances(models[0][1], ["x"])[0][0] == "x"


def test_reports(spark):
    e = frame(spark, [(0, 1), (0, 2), (1, 3)], "country int, s1 long")
    assert rp.stress_share(4, 5) == pytest.approx(0.2)
    assert rp.density_removed(e, 1.0).count() == 3 and rp.density_removed(e, 0.0).count() == 0
    assert rp.without(frame(spark, [(0, 2, 1, 1, 0.5), (1, 2, 1, 3, 0.5)], PAIR), e.where("country = 0")).count() == 1


def test_calibration_and_combiner(spark):
    t = frame(spark, [(i, i / 500, int(i % 500 > 250), (i % 2) * 1.0 if i % 3 else None) for i in range(500)], "rec long, p double, label int, s double")
    q = [r.q for r in le.calibrated(t, t).orderBy("p").collect()]
    assert q == sorted(q) and 0 <= q[0] and q[-1] <= 1
    new = le.combined(t, t, least=50).collect()
    assert len(new) == 500 and all(r.p_new == r.p for r in new if r.s is None)
    with pytest.raises(ValueError):
        le.combined(t.limit(10), t)


def test_audit_config_ranks_all_pairs_of_a_large_customer(spark, tmp_path):
    import duckdb

    from kinfold.plans import catalog

    spark.range(1, 31).selectExpr("id as c_custkey", "concat('c', id) as c_name", "'m' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 24_001).selectExpr("id * 3 as o_orderkey", "if(id % 50 = 0, id % 29 + 1, 7) as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["audit_config"](spark, str(tmp_path))
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = duck.execute(catalog.ORACLES["audit_config"])
    names = [d[0] for d in want.description]
    assert [tuple(float(v) for v in r) for r in got.select(*names).collect()] == [tuple(float(v) for v in r) for r in want.fetchall()]
