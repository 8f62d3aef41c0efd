"""Candidate pairs: truth lookups, unions of retrievers and competition windows.

A pair table has (country, src, rec, s1) and a score or probability. Every ordering ends in an id, so
results do not depend on how rows are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REC, ENT_SRC, ENT = ("country", "src", "rec"), ("country", "src", "s1"), ("country", "s1")
PACK = {"entity": (("country", 32), ("s1", 0)), "record": (("country", 40), ("src", 32), ("rec", 0)), "pair": (("src", 43), ("rec", 21), ("s1", 0))}


def packed_key(kind: str) -> Column:
    """The fields of a key, shifted and or-ed into one 64-bit integer.

    An id beyond its bits runs into the next field, and such keys may coincide: see
    ``packed_pair_checked``. As in DuckDB, a shift of a negative field or one that loses bits raises."""
    out = F.lit(0).cast("long")
    for field, shift in PACK[kind]:
        c = F.col(field).cast("long")
        if shift:
            lost = (c < 0) | (c >= 1 << (63 - shift))
            c = F.when(lost, F.raise_error(F.lit(f"{field} cannot be shifted by {shift} bits")).cast("long")).otherwise(F.shiftleft(c, shift))
        out = out.bitwiseOR(c)
    return out


def packed_pair_checked() -> Column:
    """The pair key where it must be unique: ids beyond their bits raise."""
    fits = (F.col("s1") < 1 << 21) & (F.col("rec") < 1 << 22) & (F.col("s1") >= 0) & (F.col("rec") >= 0)
    return F.when(fits, packed_key("pair")).otherwise(F.raise_error(F.lit("an id exceeds the bits of a pair key")).cast("long"))


def with_parents(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Records with their true entity, -1 for orphans."""
    return records.join(truth.select("rec", F.col("s1").alias("parent")), "rec", "left").withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where the entity is the record's parent."""
    out = pairs.join(truth.select("rec", F.col("s1").alias("_p")), "rec", "left")
    return out.withColumn("label", F.coalesce((F.col("_p") == F.col("s1")).cast("int"), F.lit(0))).drop("_p")


def with_fold(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with their entity's fold; a missing entity raises."""
    out = pairs.join(entities.select(*ENT, "fold"), list(ENT), "left")
    return out.withColumn("fold", F.when(F.col("fold").isNotNull(), F.col("fold")).otherwise(F.raise_error(F.lit("a pair's entity has no fold")).cast("int")))


def retrieval_windows(pairs: DataFrame, score: str = "score") -> DataFrame:
    """Gaps, ranks and counts among a record's and an entity's candidates."""
    rec, es = W.partitionBy(*REC), W.partitionBy(*ENT_SRC)
    s = F.col(score)
    return pairs.withColumns({
        "gap_rec": F.max(s).over(rec) - s,
        "n_cand_rec": F.count(F.lit(1)).over(rec),
        "rank_s1": F.row_number().over(es.orderBy(s.desc(), "rec")) - 1,
        "gap_s1": F.max(s).over(es) - s,
        "n_cand_s1_src": F.count(F.lit(1)).over(es),
        "n_cand_s1": F.count(F.lit(1)).over(W.partitionBy(*ENT)),
    })


def dense_windows(pairs: DataFrame) -> DataFrame:
    """Cosine gaps and ranks among union candidates."""
    rec, es, c = W.partitionBy(*REC), W.partitionBy(*ENT_SRC), F.col("cos")
    return pairs.withColumns({
        "dgap_rec": F.max(c).over(rec) - c,
        "drank_rec_all": F.row_number().over(rec.orderBy(c.desc(), "s1")) - 1,
        "dgap_s1": F.max(c).over(es) - c,
        "drank_s1_all": F.row_number().over(es.orderBy(c.desc(), "rec")) - 1,
    })


def union_candidates(tfidf: DataFrame, dense: DataFrame, absent: int = 6) -> DataFrame:
    """Full union of two retrievers: score 0 and rank ``absent`` where one did not find the pair, the
    first retriever's cosine first. Dense ranks are -1 where a list lacks the pair."""
    keys = ["country", "src", "rec", "s1"]
    a = tfidf.select(*keys, "score", "rank", F.col("cos").alias("_ct"), F.lit(1).alias("in_tfidf"))
    b = dense.select(*keys, F.col("cos").alias("_cd"), "drank_rec", "drank_s1")

    def listed(c: str) -> Column:
        return F.coalesce(F.col(c) >= 0, F.lit(False))

    def place(c: str) -> Column:
        return F.when(listed(c), F.col(c)).otherwise(absent)

    def one(c: Column) -> Column:
        return c.cast("int")

    return a.join(b, keys, "full").select(
        *keys, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.lit(absent)).alias("rank"), F.coalesce("in_tfidf", F.lit(0)).alias("in_tfidf"),
        F.coalesce("_ct", "_cd").alias("cos"), one(listed("drank_rec") | listed("drank_s1")).alias("in_dense"), place("drank_rec").alias("drank_rec"), place("drank_s1").alias("drank_s1"),
        (F.coalesce("in_tfidf", F.lit(0)) + one(listed("drank_rec")) + one(listed("drank_s1"))).alias("n_retrievers"),
    )


def group_stats(df: DataFrame, by: list[str], tie: str, p: str = "p", extra: Column | None = None, prefix: str = "") -> DataFrame:
    """Rank (0 best), max, second (0 alone), size, sum and sum of ``extra`` of ``p`` in each group."""
    g = W.partitionBy(*by)
    order = g.orderBy(F.desc(p), tie)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = {
        "rank": F.row_number().over(order) - 1,
        "max": F.first(p).over(whole),
        "second": F.coalesce(F.nth_value(p, 2).over(whole), F.lit(0.0)),
        "n": F.count(F.lit(1)).over(g),
        "sum": F.sum(p).over(g),
    }
    if extra is not None:
        out["extra_sum"] = F.sum(extra).over(g)
    return df.withColumns({prefix + k: v for k, v in out.items()})


def competition_features(pairs: DataFrame) -> DataFrame:
    """How a pair's p stands against the record's other entities and the entity's other records."""
    half = (F.col("p") > 0.5).cast("int")
    t = group_stats(pairs, list(REC), "s1", prefix="r_")
    t = group_stats(t, list(ENT_SRC), "rec", extra=half, prefix="e_")
    ent = W.partitionBy(*ENT)
    other = F.max(F.when(F.col("src") == 2, F.col("p"))).over(ent), F.max(F.when(F.col("src") == 3, F.col("p"))).over(ent)

    def margin(x: str) -> Column:
        return F.col("p") - F.when(F.col(f"{x}rank") == 0, F.col(f"{x}second")).otherwise(F.col(f"{x}max"))

    return t.select(
        *pairs.columns, F.col("r_max").alias("rec_pmax"), F.col("r_second").alias("rec_p2"), margin("r_").alias("p_minus_rec_other"), F.col("r_rank").alias("rec_prank"),
        F.col("r_n").alias("rec_n"), F.col("e_max").alias("s1src_pmax"), F.col("e_rank").alias("s1src_prank"), F.col("e_extra_sum").alias("s1src_n05"), F.col("e_sum").alias("s1src_psum"),
        margin("e_").alias("p_minus_s1src_other"), F.sum(half).over(ent).alias("s1_n05"), F.coalesce(F.when(F.col("src") == 2, other[1]).otherwise(other[0]), F.lit(0.0)).alias("s1_pmax_other_src"),
        F.sum((F.col("r_rank") == 0).cast("int")).over(ent).alias("s1_n_best"),
    )


def scored_margin(pairs: DataFrame, ce: str = "ce") -> DataFrame:
    """Margin to the record's best other scored entity; null if unscored or alone."""
    scored = F.col(ce).isNotNull()
    g = W.partitionBy(*REC, scored)
    order = g.orderBy(F.desc(ce), "s1")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, second = F.first(ce).over(whole), F.nth_value(ce, 2).over(whole)
    against = F.when(F.row_number().over(order) == 1, second).otherwise(first)
    return pairs.withColumn("ce_minus_rec_other", F.when(scored & (F.count(F.lit(1)).over(g) > 1), F.col(ce) - against))


def not_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates."""
    return matches.join(candidates, ["s1", "rid"], "left_anti")
