"""Scoring per entity, strata, bootstrap, blocking audits and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.decisions import f_half


def per_entity(truth: DataFrame, pred: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1, k, m, tp, f05) for every entity; repeated pairs count once, others' pairs not at all."""
    e = entities.select("s1").distinct()
    t, p = truth.select("s1", "rid").distinct(), pred.select("s1", "rid").distinct()
    both = t.withColumn("_t", F.lit(1)).join(p.withColumn("_p", F.lit(1)), ["s1", "rid"], "full")
    counts = both.groupBy("s1").agg(F.sum("_t").alias("k"), F.sum("_p").alias("m"), F.sum(F.col("_t") * F.col("_p")).alias("tp"))
    out = e.join(counts, "s1", "left").select("s1", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("k", "m", "tp")])
    return out.withColumn("f05", f_half(F.col("k"), F.col("m"), F.col("tp")))


def oracle(truth: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Scores of a perfect matcher on the candidates."""
    return per_entity(truth, candidates.select("s1", "rid").join(truth.select("s1", "rid").distinct(), ["s1", "rid"], "left_semi"), entities)


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f05").alias("f05"), F.count(F.lit(1)).alias("n"))


def k_bucket(k: Column, top: int = 6) -> Column:
    return F.least(k, F.lit(top))


def strata(scores: DataFrame, by: tuple[str, ...], value: str = "f05") -> DataFrame:
    """One row for all and one per value of each column: stratum, n, share, mean."""
    label = F.lit("ALL")
    for c in by:
        label = F.when(F.grouping(c) == 0, F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))).otherwise(label)
    sets = [[]] + [[F.col(c)] for c in by]
    out = scores.groupingSets(sets, *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value), label.alias("stratum"))
    whole = scores.agg(F.count(F.lit(1)).alias("_all"))
    return out.crossJoin(F.broadcast(whole)).select("stratum", "n", (F.col("n") / F.col("_all")).alias("share"), value)


def paired_bootstrap(deltas: DataFrame, resamples: int = 1000, alpha: float = 0.05, seed: int = 0) -> dict:
    """Mean of ``d`` with a percentile interval from Poisson resampling: each row's weights are drawn
    from its key's hash, summed per resample by Spark, so nothing but one row a resample is collected."""
    import math

    table, cum = [], 0.0
    for i in range(12):
        cum += math.exp(-1) / math.factorial(i)
        table.append(cum)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "b"), 11).cast("double") + 0.5) / float(1 << 53)
    w = sum((F.when(u >= t, 1).otherwise(0) for t in table[1:]), F.when(u >= table[0], 1).otherwise(0))
    drawn = deltas.select("key", "d").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", w)
    means = sorted(r.m for r in drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("d")) / F.greatest(F.sum("w"), F.lit(1))).alias("m")).collect())
    seen = deltas.agg(F.avg("d").alias("d"), F.count(F.lit(1)).alias("n")).first()
    if not seen.n:
        raise ValueError("no entities to compare")

    def quantile(q: float) -> float:
        x = q * (len(means) - 1)
        i = int(x)
        return means[i] + (x - i) * (means[min(i + 1, len(means) - 1)] - means[i])

    low, high = quantile(alpha / 2), quantile(1 - alpha / 2)
    return {"delta": seen.d, "ci_low": low, "ci_high": high, "significant": low > 0 or high < 0, "n_entities": seen.n}


def verdict(boot: dict, materiality: float = 0.002) -> str:
    """What a paired comparison says of the second run."""
    if boot["ci_low"] > 0 and boot["delta"] >= materiality:
        return "KEEP"
    return "WORSE" if boot["ci_high"] < 0 else "NO CLEAR DIFFERENCE"


def parse_config(spec: str) -> list[tuple[str, str, int]]:
    """``"NA:f20,A:r3"``: views with forward or reverse lists of a length."""
    out = []
    for part in filter(None, map(str.strip, spec.split(","))):
        view, lists = part.split(":")
        out.append((view, "fwd" if lists[0] == "f" else "rev" if lists[0] == "r" else _bad(lists), int(lists[1:])))
    return out


def _bad(lists: str) -> str:
    raise ValueError(f"lists are f<k> or r<k>, not {lists}")


def reachable(config: list[tuple[str, str, int]]) -> Column:
    """Whether a row of a rank table is found by any component of a configuration."""
    out = F.lit(False)
    for view, way, k in config:
        r = F.col(f"{view}_{way}")
        out = out | ((r >= 0) & (r < k))
    return out


def audit(ranks: DataFrame, entities: DataFrame, candidates: DataFrame, config: list[tuple[str, str, int]]) -> DataFrame:
    """One row: oracle F0.5, pair recall (all, other scripts, little name overlap) and candidate counts.
    ``ranks`` has the true pairs (s1, script, name_jacc and list ranks), ``candidates`` (s1, src, rec)."""
    pairs = ranks.withColumn("hit", reachable(config))
    per = pairs.groupBy("s1").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("hit").cast("int")).alias("tp"))
    n_cand = candidates.select("s1", "src", "rec").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("c"))
    e = entities.select("s1").join(per, "s1", "left").join(n_cand, "s1", "left").fillna(0)
    scores = e.agg(F.avg(f_half(F.col("k"), F.col("tp"), F.col("tp"))).alias("oracle_f05"), F.avg("c").alias("c_mean"), F.floor(F.percentile("c", 0.9)).alias("c_p90"), F.max("c").alias("c_max"))
    hit = F.col("hit").cast("double")
    recall = pairs.agg(F.avg(hit).alias("pair_recall"), F.avg(F.when(F.col("script") > 0, hit)).alias("recall_other_script"), F.avg(F.when(F.col("name_jacc") < 0.25, hit)).alias("recall_low_name"))
    return scores.crossJoin(recall)


def recall_gate(dense: DataFrame, base: DataFrame, k: int = 3) -> DataFrame:
    """Per country recall at ``k`` of two retrievers and whether the first is at least as good. Both
    have (country, q, d, rank) of true pairs."""
    a = dense.groupBy("country").agg(F.avg(F.col("rank").between(0, k - 1).cast("double")).alias("dense"))
    b = base.groupBy("country").agg(F.avg(F.col("rank").between(0, k - 1).cast("double")).alias("tfidf"))
    return a.join(b, "country").withColumn("passed", F.round("dense", 9) >= F.round("tfidf", 9))


def loss_split(entities: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per k bucket and overall the F0.5 lost to wrong pairs, to rejected true candidates and to true
    pairs never retrieved. ``entities`` (s1, k), ``kept`` (s1, label), ``pairs`` (s1, label)."""
    got = kept.groupBy("s1").agg(F.count(F.lit(1)).alias("m"), F.sum("label").alias("tp"))
    there = pairs.groupBy("s1").agg(F.sum("label").alias("reach"))
    e = entities.select("s1", "k").join(got, "s1", "left").join(there, "s1", "left").fillna(0)
    k, tp, reach = F.col("k"), F.col("tp"), F.col("reach")
    e = e.withColumns({"actual": f_half(k, F.col("m"), tp), "clean": f_half(k, tp, tp), "oracle": f_half(k, reach, reach), "bucket": k_bucket(k)})
    mean = [F.avg(F.col("clean") - F.col("actual")).alias("wrong"), F.avg(F.col("oracle") - F.col("clean")).alias("rejected"), F.avg(1 - F.col("oracle")).alias("missed")]
    return e.cube("bucket").agg(F.count(F.lit(1)).alias("n"), *mean)


def error_anatomy(kept: DataFrame, parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shares of wrong kept pairs by why: orphan record, parent retrieved, parent not retrieved."""
    wrong = kept.where("label = 0").join(parents.select("rec", "parent"), "rec")
    found = pairs.where("label = 1").select("rec", F.lit(1).alias("_f")).distinct()
    kind = F.when(F.col("parent") < 0, "orphan").when(F.col("_f").isNotNull(), "parent_retrieved").otherwise("parent_missing")
    counted = wrong.join(found, "rec", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(counted.agg(F.sum("n").alias("_all"))).select("kind", "n", (F.col("n") / F.col("_all")).alias("share"))
