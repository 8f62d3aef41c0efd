"""From probabilities to matches: arbitration, threshold and expected-F rules, tuning, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.operators.pairs import ENT, REC

TOLERANCE = 1e-12


def arbitrated(pairs: DataFrame) -> DataFrame:
    """``winner``: the record's best entity. ``pos``: the winner's place in its entity by p (-1 for
    losers), ``top_p``: the entity's best winner (0 for losers)."""
    won = pairs.withColumn("winner", F.row_number().over(W.partitionBy(*REC).orderBy(F.desc("p"), "s1")) == 1)
    order = W.partitionBy(*ENT, "winner").orderBy(F.desc("p"), "src", "rec")
    return won.withColumns({
        "pos": F.when(F.col("winner"), F.row_number().over(order) - 1).otherwise(-1),
        "top_p": F.when(F.col("winner"), F.first("p").over(order)).otherwise(0.0),
    })


def threshold_rule(t_first: Column | float, t_rest: Column | float, arbitrate: bool = True) -> Column:
    """Keep an entity's best winner from ``t_first`` on, and its others from ``t_rest`` on if the best is kept."""
    one, rest = (x if isinstance(x, Column) else F.lit(x) for x in (t_first, t_rest))
    p, pos = F.col("p"), F.col("pos")
    if not arbitrate:
        return p >= one
    return F.col("winner") & (((pos == 0) & (p >= one)) | ((pos > 0) & (p >= rest) & (F.col("top_p") >= one)))


def f_half(k: Column, m: Column, tp: Column) -> Column:
    """F0.5 of counts of true, predicted and correct pairs; nothing true: 1 if nothing is predicted."""
    precision, recall = tp / F.greatest(m, F.lit(1)), tp / F.greatest(k, F.lit(1))
    return F.when(k == 0, (m == 0).cast("double")).when(tp > 0, 1.25 * precision * recall / (0.25 * precision + recall)).otherwise(0.0)


def grid(low: float = 0.10, high: float = 0.95, step: float = 0.05) -> list[float]:
    return [round(low + i * step, 3) for i in range(int((high - low) / step + 1e-9) + 1)]


def tuned(arbitrated_pairs: DataFrame, entities: DataFrame, points: list[float], arbitrate: bool = True) -> DataFrame:
    """(t_first, t_rest, f05) for every pair of thresholds.

    Each entity's winners become sorted arrays once; its counts under a threshold are array filters,
    so the work is entities x grid without a shuffle per setting. Without arbitration there is one
    threshold, t_rest equal to t_first.
    """
    spark = entities.sparkSession
    combos = [(a, b) for a in points for b in (points if arbitrate else [a])]
    table = F.broadcast(spark.createDataFrame(combos, "t_first double, t_rest double"))
    own = arbitrated_pairs.where("winner") if arbitrate else arbitrated_pairs
    lists = own.groupBy(*ENT).agg(F.collect_list(F.struct("p", "label")).alias("_l"), F.max("p").alias("_top"))
    e = entities.select(*ENT, "k").join(lists, list(ENT), "left").withColumn("_l", F.coalesce("_l", F.array().cast("array<struct<p:double,label:int>>")))
    met = e.crossJoin(table)
    if arbitrate:
        met = met.withColumn("_first", F.coalesce(F.col("_top") >= F.col("t_first"), F.lit(False)))
        rest = F.filter("_l", lambda x: x["p"] >= F.col("t_rest"))
        best = F.array_sort("_l", lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
        head = F.slice(best, 1, 1)
        chosen = F.when(~F.col("_first"), F.slice("_l", 1, 0)).when(F.size(rest) > 0, rest).otherwise(head)
    else:
        chosen = F.filter("_l", lambda x: x["p"] >= F.col("t_first"))
    counted = met.withColumn("_c", chosen).select("t_first", "t_rest", "k", F.size("_c").alias("m"), F.size(F.filter("_c", lambda x: x["label"] == 1)).alias("tp"))
    return counted.groupBy("t_first", "t_rest").agg(F.avg(f_half(F.col("k"), F.col("m"), F.col("tp"))).alias("f05"))


def best_setting(grid_scores: DataFrame) -> DataFrame:
    """The best row; among equals (to 9 places) the first in (t_first, t_rest)."""
    return grid_scores.orderBy(F.desc(F.round("f05", 9)), "t_first", "t_rest").limit(1)


def expected_f(arbitrated_pairs: DataFrame, q: str = "p", beta2: float = 0.25) -> DataFrame:
    """``keep``: the prefix of each entity's winners by q that maximises expected F0.5, or nothing if
    the chance that no candidate is true is at least as high."""
    won = arbitrated_pairs.where("winner").withColumn("_q", F.least(F.greatest(F.col(q).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6)))
    ent = W.partitionBy(*ENT)
    order = ent.orderBy(F.desc("_q"), "src", "rec")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    t = won.withColumns({"_pos": F.row_number().over(order) - 1, "_cs": F.sum("_q").over(run), "_ek": F.sum("_q").over(ent), "_none": F.exp(F.sum(F.log1p(-F.col("_q"))).over(ent))})
    t = t.withColumn("_s", (1 + beta2) * F.col("_cs") / (beta2 * F.col("_ek") + F.col("_pos") + 1))
    t = t.withColumn("_best", F.max("_s").over(ent))
    t = t.withColumn("_m", F.min(F.when(F.col("_s") >= F.col("_best") - TOLERANCE, F.col("_pos"))).over(ent))
    keep = (F.col("_none") < F.col("_best")) & (F.col("_pos") <= F.col("_m"))
    own = t.withColumn("keep", keep).drop("_q", "_pos", "_cs", "_ek", "_none", "_s", "_best", "_m")
    return own.unionByName(arbitrated_pairs.where(~F.col("winner")).withColumn("keep", F.lit(False)))


def pruned(pairs: DataFrame, tau: float = 0.003, p: str = "p") -> DataFrame:
    return pairs.where(F.col(p) >= tau)


def prune_curve(pairs: DataFrame, entities: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, cand_per_s1, oracle_f05): what pruning at each level leaves reachable."""
    n = entities.count()
    counts = [F.sum(F.when(F.col("p") >= t, 1).otherwise(0)).alias(f"m{i}") for i, t in enumerate(taus)]
    hits = [F.sum(F.when((F.col("p") >= t) & (F.col("label") == 1), 1).otherwise(0)).alias(f"t{i}") for i, t in enumerate(taus)]
    per = entities.select(*ENT, "k").join(pairs.groupBy(*ENT).agg(*counts, *hits), list(ENT), "left").fillna(0)
    rows = [F.struct(F.lit(t).alias("tau"), F.col(f"m{i}").alias("m"), F.col(f"t{i}").alias("tp")) for i, t in enumerate(taus)]
    long = per.select("k", F.explode(F.array(*rows)).alias("x")).select("k", "x.*")
    return long.groupBy("tau").agg((F.sum("m") / max(n, 1)).alias("cand_per_s1"), F.avg(f_half(F.col("k"), F.col("tp"), F.col("tp"))).alias("oracle_f05"))


def decision_distance(t_first: float, t_rest: float) -> Column:
    """How far a winner's p is from the threshold it faces; infinite for losers."""
    return F.when(F.col("winner"), F.abs(F.col("p") - F.when(F.col("pos") == 0, t_first).otherwise(t_rest))).otherwise(float("inf"))


def nearest(pairs: DataFrame, n: int, distance: str = "d", ties: tuple[str, ...] = ("country", "src", "rec", "s1")) -> DataFrame:
    """The ``n`` pairs nearest to their decision."""
    return pairs.where(F.col(distance) < float("inf")).orderBy(distance, *ties).limit(n)
