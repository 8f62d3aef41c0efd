"""Diagnostics over whole runs: density stress, country profiles, probes and data profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.folds import sampled
from kinfold.operators.pairs import ENT, REC


def density_removed(entities: DataFrame, share: float = 0.19, seed: int = 1000) -> DataFrame:
    """A random share of entities, to be taken out of the universe."""
    return sampled(entities, share, "s1", seed)


def without(pairs: DataFrame, removed: DataFrame) -> DataFrame:
    return pairs.join(removed.select(*ENT), list(ENT), "left_anti")


def country_profile(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per country: entities, candidates and kept pairs per entity, share of entities without a kept pair,
    quantiles of records' best p and their share from 0.5 on. ``pairs`` has p and keep."""
    e = entities.groupBy("country").agg(F.count(F.lit(1)).alias("entities"))
    per = pairs.groupBy(*ENT).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("keep").cast("int")).alias("m"))
    c = per.groupBy("country").agg(F.sum("c").alias("c"), F.sum("m").alias("m"), F.sum((F.col("m") > 0).cast("int")).alias("some"))
    best = pairs.groupBy(*REC).agg(F.max("p").alias("b"))
    q = best.groupBy("country").agg(*[F.percentile("b", x).alias(f"best_p_q{int(x * 100)}") for x in (0.1, 0.5, 0.9)], F.avg((F.col("b") >= 0.5).cast("double")).alias("share_best_p_half"))
    out = e.join(c, "country", "left").join(q, "country", "left").fillna(0, ["c", "m", "some"])
    return out.select(
        "country", "entities", (F.col("c") / F.col("entities")).alias("candidates_per_s1"), (F.col("m") / F.col("entities")).alias("predicted_per_s1"),
        (1 - F.col("some") / F.col("entities")).alias("share_empty"), "best_p_q10", "best_p_q50", "best_p_q90", "share_best_p_half",
    )


def emptied(lists: DataFrame, entities: DataFrame, country) -> DataFrame:
    """Id lists with those of one country's entities emptied."""
    own = entities.where(F.col("country") == country).select("s1", F.lit(True).alias("_own"))
    return lists.join(own, "s1", "left").withColumn("ids", F.when(F.col("_own"), "").otherwise(F.col("ids"))).drop("_own")


def orphan_shares(records: DataFrame) -> DataFrame:
    """Per source: records and the share without an entity."""
    return records.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("parent") < 0).cast("double")).alias("orphan_share"))


def match_histogram(entities: DataFrame) -> DataFrame:
    """Entities by number of matches."""
    return entities.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def density(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Records per entity by country."""
    e = entities.groupBy("country").agg(F.count(F.lit(1)).alias("entities"))
    r = records.groupBy("country").agg(F.count(F.lit(1)).alias("records"))
    return e.join(r, "country", "left").fillna(0).withColumn("density", F.col("records") / F.col("entities"))


def stress_share(train: float, test: float) -> float:
    """The share of entities to take out for training to be as dense as test."""
    return 1 - train / test


def position_correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Whether row positions of partners leak their match."""
    return pairs.agg(F.corr(a, b).alias("corr"))


def text_profile(df: DataFrame) -> DataFrame:
    """Rows, share of empty addresses and of names in Indic scripts of normalised tables."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("addr_n") == "").cast("double")).alias("empty_addr"), F.avg((F.col("script") > 0).cast("double")).alias("indic"))
