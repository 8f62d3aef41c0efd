"""Folds, deterministic samples, negatives and batches for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.binding import let


def _times(x: Column, c: int) -> Column:
    """The low 64 bits of a product. Spark's own product raises on overflow, so it is put together from
    products of 32-bit halves with 16-bit ones."""
    c0, c1 = c & 0xFFFFFFFF, c >> 32

    def half(y: Column, d: int) -> Column:
        return (F.shiftleft((y * F.lit(d >> 16)).bitwiseAND(0xFFFF), 16) + y * F.lit(d & 0xFFFF)).bitwiseAND(0xFFFFFFFF)

    def joined(v: Column) -> Column:
        low, high = v.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(v, 32)
        top = half(high, c0) + half(low, c1)

        def carried(p: Column) -> Column:
            upper = (F.shiftrightunsigned(p["carry"], 16) + p["top"]).bitwiseAND(0xFFFFFFFF)
            return F.shiftleft(upper, 32).bitwiseOR(F.shiftleft(p["carry"].bitwiseAND(0xFFFF), 16)).bitwiseOR(p["first"].bitwiseAND(0xFFFF))

        first = low * F.lit(c0 & 0xFFFF)
        return let(F.struct(first.alias("first"), (F.shiftrightunsigned(first, 16) + low * F.lit(c0 >> 16)).alias("carry"), top.alias("top")), carried)

    return let(x, joined)


def entity_uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) from a 64-bit key and a salt, the same for all rows of the key.

    Fixed values: the multipliers and shifts of a splitmix64 finaliser.
    """
    start = salt * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    start -= (start >> 63) << 64
    x = _times(key.cast("long"), 0x9E3779B97F4A7C15).bitwiseXOR(F.lit(start).cast("long"))
    x = _times(let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30))), 0xBF58476D1CE4E5B9)
    x = _times(let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27))), 0x94D049BB133111EB)
    x = let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))
    return F.shiftrightunsigned(x, 11) / F.lit(float(1 << 53))


def key_of(df: DataFrame, c: str) -> Column:
    """A column as a 64-bit key; text is hashed."""
    return F.xxhash64(c) if dict(df.dtypes)[c] == "string" else F.col(c)


def assign_folds(entities: DataFrame, n_folds: int = 5, seed: int = 0, top: int = 6, order: Column | None = None) -> DataFrame:
    """Add k_bucket and fold: entities of a (country, bucket) are dealt in turn in hash order.

    A stratum may hold much of the table, so it is numbered in 64 hash buckets with offsets rather than
    in one sorted task; folds are equally large to one entity either way.
    """
    key = order if order is not None else F.pmod(F.col("s1") * 7919 + seed, F.lit(1_000_003))
    e = entities.withColumns({"k_bucket": F.least("k", F.lit(top)), "_h": key}).withColumn("_b", F.floor(F.col("_h") * 64 / 1_000_003))
    sizes = e.groupBy("country", "k_bucket", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("country", "k_bucket").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy("country", "k_bucket", "_b").orderBy("_h", "s1")
    dealt = e.withColumn("_r", F.row_number().over(inside) - 1).join(starts, ["country", "k_bucket", "_b"])
    return dealt.withColumn("fold", ((F.col("_o") + F.col("_r")) % n_folds).cast("int")).drop("_h", "_b", "_o", "_r")


def fold_crosstab(entities: DataFrame, n_folds: int = 5) -> DataFrame:
    """Entities per (country, k_bucket) and fold."""
    return entities.groupBy("country", "k_bucket").pivot("fold", list(range(n_folds))).count().fillna(0)


def sampled(df: DataFrame, share: float, key: str, salt: int) -> DataFrame:
    """All rows of a deterministic share of keys."""
    return df.where(entity_uniform(key_of(df, key), salt) < share)


def row_capped(df: DataFrame, cap: int, key: str, salt: int, share: float = 1.0) -> DataFrame:
    """``sampled`` with the share lowered so that about ``cap`` rows are left."""
    n = df.count()
    return sampled(df, share if n * share <= cap else cap / n, key, salt)


def within_budget(df: DataFrame, key: str, budget: int, order: Column) -> DataFrame:
    """Whole keys in ``order`` as long as their rows fit the budget. One row per key is ordered,
    first inside 256 ranges of the order, then over the ranges."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(order).alias("_h"))
    dealt = sizes.withColumn("_b", F.shiftrightunsigned(F.col("_h").cast("long").bitwiseXOR(F.lit(-(1 << 63))), 56))
    inside = W.partitionBy("_b").orderBy("_h", key).rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.groupBy("_b").agg(F.sum("_n").alias("_t"))
    starts = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    fits = dealt.withColumn("_c", F.sum("_n").over(inside)).join(F.broadcast(starts), "_b").where(F.col("_o") + F.col("_c") <= budget)
    return df.join(fits.select(key), key, "left_semi")


def next_sibling(df: DataFrame, key: str, idc: str, allowed: Column) -> DataFrame:
    """``sibling``: the next allowed row with the same non-empty key, the last one's is the first; -1 if
    there is none or the row is not allowed."""
    ok = F.coalesce(allowed & (F.col(key) != ""), F.lit(False))
    g = W.partitionBy(F.when(ok, F.col(key)), F.when(~ok, F.xxhash64(idc)))  # rows without a sibling stay apart
    following = F.coalesce(F.lead(idc).over(g.orderBy(idc)), F.first(idc).over(g.orderBy(idc)))
    return df.withColumn("sibling", F.when(ok & (F.count(F.lit(1)).over(g) > 1), following).otherwise(-1))


def hard_negatives(candidates: DataFrame) -> DataFrame:
    """(country, src, rec, neg_s1): each record's best-ranked candidate that is not its entity."""
    return candidates.where("label = 0").groupBy("country", "src", "rec").agg(F.min_by("s1", F.struct("rank", "s1")).alias("neg_s1"))


def prioritised(options: list[tuple[str, int]]) -> tuple[Column, Column]:
    """The first option column that is not null and not -1, and its kind code."""
    value, kind = F.lit(None).cast("long"), F.lit(None).cast("int")
    for c, code in reversed(options):
        there = F.col(c).isNotNull() & (F.col(c) >= 0)
        value, kind = F.when(there, F.col(c)).otherwise(value), F.when(there, code).otherwise(kind)
    return value, kind


def training_triplets(records: DataFrame, candidates: DataFrame, entities: DataFrame, folds: list[int], salt: int = 3) -> DataFrame:
    """(country, src, rec, pos_s1, neg_s1, neg_kind) of records whose entity is in ``folds``. Negatives
    are of those folds too: 0 a retrieved one, 1 same name, 2 same first word, 3 a random one."""
    e = entities.where(F.col("fold").isin(folds)).select("country", "s1", "name")
    named = next_sibling(e, "name", "s1", F.lit(True)).withColumnRenamed("sibling", "same_name")
    both = next_sibling(named.withColumn("_w", F.coalesce(F.get(F.split("name", " "), F.lit(0)), F.lit(""))), "_w", "s1", F.lit(True)).withColumnRenamed("sibling", "same_first")
    ring = W.partitionBy("country").orderBy(entity_uniform(F.col("s1"), salt), "s1")
    pool = both.withColumn("rand", F.coalesce(F.lead("s1").over(ring), F.first("s1").over(ring))).withColumn("rand", F.when(F.col("rand") != F.col("s1"), F.col("rand")))
    hard = hard_negatives(candidates.join(e.select("country", "s1"), ["country", "s1"], "left_semi"))
    t = records.where("parent >= 0").join(pool.drop("name", "_w").withColumnRenamed("s1", "parent"), ["country", "parent"]).join(hard, ["country", "src", "rec"], "left")
    value, kind = prioritised([("neg_s1", 0), ("same_name", 1), ("same_first", 2), ("rand", 3)])
    return t.select("country", "src", "rec", F.col("parent").alias("pos_s1"), value.alias("neg_s1"), kind.alias("neg_kind")).where("neg_s1 is not null")


def owner_fold(records: DataFrame, entities: DataFrame, n_folds: int = 5, salt: int = 11) -> DataFrame:
    """``owner``: the fold of a record's entity, a hash fold for orphans."""
    out = records.join(entities.select("country", F.col("s1").alias("parent"), F.col("fold").alias("_f")), ["country", "parent"], "left")
    drawn = F.least(F.floor(entity_uniform(F.col("rec"), salt) * n_folds), F.lit(n_folds - 1)).cast("int")
    return out.withColumn("owner", F.coalesce("_f", drawn)).drop("_f")


def batches(pairs: DataFrame, size: int, by: str = "country", order: Column | None = None) -> DataFrame:
    """``batch``: full batches of one country in hash order; what is left over is dropped."""
    g = W.partitionBy(by)
    key = order if order is not None else F.xxhash64("rec", "src")
    n = F.row_number().over(g.orderBy(key, "src", "rec")) - 1
    out = pairs.withColumns({"_n": n, "_all": F.count(F.lit(1)).over(g)}).withColumn("batch", F.floor(F.col("_n") / size))
    return out.where((F.col("batch") + 1) * size <= F.col("_all")).drop("_n", "_all")


def masks(batch_rows: DataFrame) -> DataFrame:
    """(batch, row, col, false_negative, duplicate_text): columns of a batch (its positives, then its
    negatives) that are row's own entity or read like it, other than row's own positive."""
    b = batch_rows.withColumn("row", F.row_number().over(W.partitionBy("batch").orderBy("src", "rec")) - 1)
    n = F.count(F.lit(1)).over(W.partitionBy("batch"))
    pos = b.select("batch", F.col("row").alias("col"), F.col("pos_s1").alias("_s"), F.col("pos_text").alias("_t"))
    neg = b.select("batch", (F.col("row") + n).alias("col"), F.col("neg_s1").alias("_s"), F.col("neg_text").alias("_t"))
    both = b.select("batch", "row", "pos_s1", "pos_text").join(pos.unionByName(neg), "batch").where("row <> col")
    out = both.withColumns({"false_negative": F.col("_s") == F.col("pos_s1"), "duplicate_text": F.col("_t") == F.col("pos_text")})
    return out.where("false_negative or duplicate_text").select("batch", "row", "col", "false_negative", "duplicate_text")
