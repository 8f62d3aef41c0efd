"""The linkage run end to end: sources to candidates and features, cross-fitted scores, decisions, lists.

Folders. ``{data}/{split}/{split}_source{1,2,3}.tsv`` and ``{data}/train/train_ground_truth.tsv`` are
read; ``{out}/{split}/`` gets views, features and entities, ``{out}/models`` one model per fold and
``{out}/rules`` the chosen rule with its scores. Each step writes whole tables with success markers and
is skipped when its table is there, so a run can be resumed.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.similarity import string_block
from kinfold.functions.text import normalized, source_digit
from kinfold.operators import decisions as de
from kinfold.operators import evaluation as ev
from kinfold.operators import learning as le
from kinfold.operators import pairs as pa
from kinfold.operators import reports as rp
from kinfold.operators.folds import assign_folds, fold_crosstab
from kinfold.operators.retrieval import record_side
from kinfold.sources import tables as tb

RETRIEVAL = ["score", "rank", "gap_rec", "n_cand_rec", "rank_s1", "gap_s1", "n_cand_s1", "n_cand_s1_src"]
STRINGS = [
    "name_ratio", "name_tset", "name_partial", "name_jw", "legal_ratio", "nospace_ratio", "translit_ratio", "addr_ratio", "addr_tset", "addr_partial", "digit_jacc", "house_state", "n_digits_s1",
    "n_digits_rec", "rec_indic", "rec_addr_empty", "name_len_ratio", "addr_len_ratio", "num_only_s1", "num_only_rec", "num_conflict", "num_conflict_len", "name_num_conflict", "name_num_diff",
]
COMPETITION = [
    "rec_pmax", "rec_p2", "p_minus_rec_other", "rec_prank", "rec_n", "s1src_pmax", "s1src_prank", "s1src_n05", "s1src_psum", "p_minus_s1src_other", "s1_n05", "s1_pmax_other_src", "s1_n_best",
]
FEATURES = [*RETRIEVAL, *STRINGS, "src"]
FAMILIES = {"gbt": GBTClassificationModel, "forest": RandomForestClassificationModel, "logistic": LogisticRegressionModel}


def views(spark: SparkSession, data: str, out: str, split: str) -> DataFrame:
    """Normalised views of all sources of a split, with their source number."""

    def make() -> DataFrame:
        parts = [tb.load_source(spark, f"{data}/{split}/{split}_source{i}.tsv").withColumn("source", F.lit(i)) for i in (1, 2, 3)]
        return normalized(parts[0].unionByName(parts[1]).unionByName(parts[2]))

    return tb.cached(spark, f"{out}/{split}/views", make)


def truth(spark: SparkSession, data: str) -> DataFrame:
    return tb.truth_pairs(tb.read_tsv(spark, f"{data}/train/train_ground_truth.tsv", tb.TRUTH)).select("s1", F.col("rid").alias("rec"))


def entity_table(v: DataFrame, pairs: DataFrame | None, n_folds: int = 5) -> DataFrame:
    """(country, s1, k, k_bucket, fold) of all entities; k is 0 without truth."""
    e = v.where("source = 1").select("country", F.col("entity_id").alias("s1"))
    k = pairs.groupBy("s1").agg(F.count(F.lit(1)).alias("k")) if pairs is not None else e.select("s1").limit(0).withColumn("k", F.lit(0).cast("long"))
    counted = e.join(k, "s1", "left").select("country", "s1", F.coalesce("k", F.lit(0)).alias("k"))
    return assign_folds(counted, n_folds, order=F.pmod(F.xxhash64("s1"), F.lit(1_000_003)))


def candidate_table(v: DataFrame, k: int = 3, max_df: float = 0.01, min_score: float = 0.0) -> DataFrame:
    """(country, src, rec, s1, score, rank): each record's best entities of its country."""
    t = v.select(F.col("country").alias("part"), F.col("entity_id").alias("id"), "source", F.concat_ws(" ", "name_n", "addr_n").alias("text"))
    found = record_side(t.where("source > 1").drop("source"), t.where("source = 1").drop("source"), k, max_df, min_score)
    return found.select(F.col("part").alias("country"), source_digit(F.col("q")).alias("src"), F.col("q").alias("rec"), F.col("d").alias("s1"), "score", "rank")


def feature_table(candidates: DataFrame, v: DataFrame) -> DataFrame:
    """Retrieval windows and string features; texts are joined only to the pairs that are left."""
    cols = ["name_n", "addr_n", "name_legal", "name_nospace", "addr_digits", "script", "name_tr"]
    a, b = (v.where(w).select(F.col("entity_id").alias(key), *[F.col(c).alias(p + c) for c in cols]) for w, key, p in (("source = 1", "s1", "a_"), ("source > 1", "rec", "b_")))
    t = pa.retrieval_windows(candidates).join(b, "rec").join(a, "s1")
    return t.select("country", "src", "rec", "s1", *RETRIEVAL, *[c.alias(k) for k, c in string_block().items()])


def build(spark: SparkSession, data: str, out: str, split: str, **retrieval) -> tuple[DataFrame, DataFrame]:
    """(features, entities) of a split, labelled and with folds for the training split."""
    v = views(spark, data, out, split)
    known = truth(spark, data) if split == "train" else None
    ents = tb.cached(spark, f"{out}/{split}/entities", lambda: entity_table(v, known))

    def make() -> DataFrame:
        f = feature_table(candidate_table(v, **retrieval), v)
        return pa.with_fold(pa.labelled(f, known), ents) if known is not None else f

    return tb.cached(spark, f"{out}/{split}/features", make), ents


def chosen_rule(scored: DataFrame, ents: DataFrame, report_fold: int) -> dict:
    """Thresholds against the expected-F rule: chosen on the other folds, reported on ``report_fold``."""
    fit, held = F.col("fold") != report_fold, F.col("fold") == report_fold
    a = de.arbitrated(scored).persist()

    def macro(kept: DataFrame, e: DataFrame) -> float:
        per = e.join(kept.groupBy("country", "s1").agg(F.count(F.lit(1)).alias("m"), F.sum("label").alias("tp")), ["country", "s1"], "left").fillna(0)
        return per.agg(F.avg(de.f_half(F.col("k"), F.col("m"), F.col("tp")))).first()[0] or 0.0

    best = de.best_setting(de.tuned(a.where(fit), ents.where(fit), de.grid())).first()
    by_threshold = a.where(de.threshold_rule(best.t_first, best.t_rest))
    calibrated = le.calibrated(a.where(fit & F.col("winner")), a)
    by_expectation = de.expected_f(calibrated, "q").where("keep")
    rules = {
        "threshold": {"t_first": best.t_first, "t_rest": best.t_rest, "tune": best.f05, "report": macro(by_threshold.where(held), ents.where(held))},
        "expected_f": {"tune": macro(by_expectation.where(fit), ents.where(fit)), "report": macro(by_expectation.where(held), ents.where(held))},
    }
    rules["chosen"] = "expected_f" if rules["expected_f"]["tune"] > rules["threshold"]["tune"] else "threshold"
    a.unpersist()
    return rules


def save_json(spark: SparkSession, path: str, value) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first().value)


def train(spark: SparkSession, data: str, out: str, folds: tuple[int, ...] = (0, 1, 2, 3, 4), report_fold: int = 0, kind: str = "gbt", tau: float = 0.003) -> dict:
    """Two stages: pair features, then competition features on the pairs that pruning leaves."""
    f, ents = build(spark, data, out, "train")
    first = le.cross_fit(f, FEATURES, list(folds), kind=kind)
    for fold, m in first:
        m.write().overwrite().save(f"{out}/models/first{fold}")
    spark.createDataFrame([(kind,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/models/kind")
    p1 = le.cross_predict(first, f, FEATURES).select(*f.columns, "p")
    p1.write.mode("overwrite").parquet(f"{out}/train/p1")
    kept = pa.competition_features(de.pruned(spark.read.parquet(f"{out}/train/p1"), tau)).withColumnRenamed("p", "p1")
    kept.write.mode("overwrite").parquet(f"{out}/train/second")
    kept, names = spark.read.parquet(f"{out}/train/second"), [*FEATURES, "p1", *COMPETITION]
    second = le.cross_fit(kept, names, list(folds), kind=kind, salt=9)
    for fold, m in second:
        m.write().overwrite().save(f"{out}/models/second{fold}")
    le.cross_predict(second, kept, names).select("country", "src", "rec", "s1", "fold", "label", "p").write.mode("overwrite").parquet(f"{out}/train/p2")
    rules = chosen_rule(spark.read.parquet(f"{out}/train/p2"), ents, report_fold)
    rules |= {"folds": list(folds), "report_fold": report_fold, "tau": tau}
    save_json(spark, f"{out}/rules", rules)
    return rules


def load_models(spark: SparkSession, out: str, stage: str, folds: list[int]) -> list:
    kind = spark.read.text(f"{out}/models/kind").first().value
    return [(f, FAMILIES[kind].load(f"{out}/models/{stage}{f}")) for f in folds]


def kept_pairs(spark: SparkSession, out: str, scored: DataFrame, rules: dict) -> DataFrame:
    """Scored pairs with ``keep`` under the chosen rule."""
    a = de.arbitrated(scored)
    if rules["chosen"] == "threshold":
        t = rules["threshold"]
        return a.withColumn("keep", de.threshold_rule(t["t_first"], t["t_rest"]))
    fitted = de.arbitrated(spark.read.parquet(f"{out}/train/p2")).where((F.col("fold") != rules["report_fold"]) & F.col("winner"))
    return de.expected_f(le.calibrated(fitted, a), "q")


def predict(spark: SparkSession, data: str, out: str, name: str, split: str = "test") -> dict:
    """Score a split with the mean of the fold models, decide, write and validate both lists."""
    rules = load_json(spark, f"{out}/rules")
    f, ents = build(spark, data, out, split)
    base = f.drop("fold", "label")
    p1 = le.cross_predict(load_models(spark, out, "first", rules["folds"]), base, FEATURES).select(*base.columns, "p")
    kept = pa.competition_features(de.pruned(p1, rules["tau"])).withColumnRenamed("p", "p1")
    p2 = le.cross_predict(load_models(spark, out, "second", rules["folds"]), kept, [*FEATURES, "p1", *COMPETITION])
    decided = tb.cached(spark, f"{out}/{split}/decided-{name}", lambda: kept_pairs(spark, out, p2.select("country", "src", "rec", "s1", "p"), rules))
    rows = decided.select("s1", F.col("rec").alias("rid"), "keep")
    return tb.snapshot(spark, f"{out}/submissions/{name}", rows, ents.select("s1"), {"rule": rules["chosen"], "report": rules[rules["chosen"]]["report"]})


def compare(spark: SparkSession, a: str, b: str, report_fold: int = 0) -> dict:
    """Paired bootstrap of two runs' per-entity scores on the report fold."""
    scores = []
    for out in (a, b):
        rules, ents = load_json(spark, f"{out}/rules"), spark.read.parquet(f"{out}/train/entities").where(F.col("fold") == report_fold)
        got = kept_pairs(spark, out, spark.read.parquet(f"{out}/train/p2"), rules).where("keep").groupBy("s1").agg(F.count(F.lit(1)).alias("m"), F.sum("label").alias("tp"))
        scores.append(ents.join(got, "s1", "left").fillna(0).select("s1", de.f_half(F.col("k"), F.col("m"), F.col("tp")).alias("f")))
    both = scores[0].withColumnRenamed("f", "_a").join(scores[1].withColumnRenamed("f", "_b"), "s1")
    boot = ev.paired_bootstrap(both.select(F.col("s1").alias("key"), (F.col("_b") - F.col("_a")).alias("d")))
    return boot | {"verdict": ev.verdict(boot)}


def profile(spark: SparkSession, out: str) -> DataFrame:
    """Per-country statistics of the training run's decisions."""
    rules = load_json(spark, f"{out}/rules")
    return rp.country_profile(spark.read.parquet(f"{out}/train/entities"), kept_pairs(spark, out, spark.read.parquet(f"{out}/train/p2"), rules))


def stress(spark: SparkSession, out: str, share: float = 0.19, seed: int = 1000) -> dict:
    """The report fold's score before and after a share of the entities is taken out of the universe."""
    rules, ents, p2 = load_json(spark, f"{out}/rules"), spark.read.parquet(f"{out}/train/entities"), spark.read.parquet(f"{out}/train/p2")
    gone = rp.density_removed(ents, share, seed).select("country", "s1")
    left, pairs = ents.join(gone, ["country", "s1"], "left_anti"), rp.without(p2, gone)
    return {"unstressed": rules["threshold"]["report"], "stressed": chosen_rule(pairs, left, rules["report_fold"])["threshold"]["report"], "share": share}


def folds_report(spark: SparkSession, data: str, out: str) -> DataFrame:
    return fold_crosstab(build(spark, data, out, "train")[1])
