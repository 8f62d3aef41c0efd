"""Candidate retrieval as similarity joins on postings: n-grams, purging, TF-IDF, top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.binding import let


def word_grams(text: Column, n: int = 2) -> Column:
    """White-space tokens and their blank-joined n-grams up to ``n``."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def grams(t: Column) -> Column:
        def joined(k: int) -> Column:
            at = F.when(F.size(t) >= k, F.sequence(F.lit(0), F.size(t) - k)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(k)]))

        return F.concat(t, *[joined(k) for k in range(2, n + 1)])

    return let(words, grams)


def char_grams(text: Column, n: int = 3) -> Column:
    """Character n-grams inside words, each word between single blanks."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def of(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substr(p, i, F.lit(n)))

    return F.flatten(F.transform(words, of))


def postings(df: DataFrame, grams: Column, by: list[str], idf_id: str = "id") -> DataFrame:
    """(by, id, term, tf); terms travel as 64-bit hashes."""
    return df.select(*by, F.col(idf_id).alias("id"), F.explode(grams).alias("_g")).groupBy(*by, "id", F.xxhash64("_g").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequencies(tf: DataFrame, sizes: DataFrame, by: list[str], max_df: float, min_df: int = 1) -> DataFrame:
    """(by, term, idf): ln((N + 1) / (df + 1)) + 1 of the terms in at least ``min_df`` documents and at most
    the share ``max_df`` of them. ``sizes`` has (by, n_docs)."""
    df = tf.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("_df"))
    kept = df.join(sizes, by).where((F.col("_df") <= F.lit(max_df) * F.col("n_docs")) & (F.col("_df") >= min_df))
    return kept.select(*by, "term", (F.log((F.col("n_docs") + 1) / (F.col("_df") + 1)) + 1).alias("idf"))


def term_weights(tf: DataFrame, sizes: DataFrame, by: list[str], max_df: float, min_df: int = 1) -> DataFrame:
    """``tf`` with ``w``: (1 + ln tf) x idf. Terms in more than ``max_df`` of the documents go before
    anything is joined, which shortens the longest postings."""
    idf = inverse_frequencies(tf, sizes, by, max_df, min_df)
    return tf.join(idf, [*by, "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf")).drop("idf", "tf")


def norms(weights: DataFrame, by: list[str]) -> DataFrame:
    """Euclidean length of each document's weights."""
    return weights.groupBy(*by, "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def weighted(tf: DataFrame, sizes: DataFrame, by: list[str], max_df: float, min_df: int = 1) -> DataFrame:
    """(by, id, term, w): L2-normed TF-IDF weights."""
    w = term_weights(tf, sizes, by, max_df, min_df)
    return w.join(norms(w, by), [*by, "id"]).select(*by, "id", "term", (F.col("w") / F.col("norm")).alias("w"))


def scored_pairs(queries: DataFrame, index: DataFrame, by: list[str], min_score: float = 0.0) -> DataFrame:
    """(by, q, d, score): dot products of all pairs that share a term."""
    q, d = queries.withColumnsRenamed({"id": "q", "w": "_a"}), index.withColumnsRenamed({"id": "d", "w": "_b"})
    return q.join(d, [*by, "term"]).groupBy(*by, "q", "d").agg(F.round(F.sum(F.col("_a") * F.col("_b")), 9).alias("score")).where(F.col("score") > min_score)


def top_k(pairs: DataFrame, k: int, per: list[str], score: str = "score", tie: str = "d") -> DataFrame:
    """The best ``k`` of each group with rank 0 first; ties by the least id."""
    rank = F.row_number().over(W.partitionBy(*per).orderBy(F.desc(score), F.asc(tie)))
    return pairs.withColumn("rn", rank).where(F.col("rn") <= k).withColumn("rank", F.col("rn") - 1).drop("rn")


def record_side(records: DataFrame, entities: DataFrame, k: int = 3, max_df: float = 0.01, min_score: float = 0.0, grams=word_grams, min_df: int = 1) -> DataFrame:
    """(part, q, d, score, rank): for each record its ``k`` best entities of the same part.

    Both sides have (part, id, text); frequencies are taken over both sides of a part. The gram counts
    are read four times, so they are persisted (memory, then disk) when the result is first computed.
    """
    both = entities.select("part", F.lit(0).alias("side"), "id", "text").unionByName(records.select("part", F.lit(1).alias("side"), "id", "text"))
    sizes = both.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"))
    tf = postings(both, grams(F.col("text")), ["part", "side"]).persist()
    w = term_weights(tf, sizes, ["part"], max_df, min_df)
    q, d = (w.where(F.col("side") == s).select("part", "term", F.col("id").alias(x), F.col("w").alias(f"_{x}")) for s, x in ((1, "q"), (0, "d")))
    dots = q.join(d, ["part", "term"]).groupBy("part", "q", "d").agg(F.sum(F.col("_q") * F.col("_d")).alias("_s"))
    length = norms(w, ["part", "side"])
    nq, nd = (length.where(F.col("side") == s).select("part", F.col("id").alias(x), F.col("norm").alias(f"_n{x}")) for s, x in ((1, "q"), (0, "d")))
    scored = dots.join(nq, ["part", "q"]).join(nd, ["part", "d"]).select("part", "q", "d", F.round(F.col("_s") / (F.col("_nq") * F.col("_nd")), 9).alias("score"))
    return top_k(scored.where(F.col("score") > min_score), k, ["part", "q"])


def forward_reverse(pairs: DataFrame, k_forward: int, k_reverse: int) -> tuple[DataFrame, DataFrame]:
    """Lists of both directions from one scored-pair table: entity to records, record to entities."""
    fwd = top_k(pairs, k_forward, ["part", "src", "d"], tie="q") if "src" in pairs.columns else top_k(pairs, k_forward, ["part", "d"], tie="q")
    return fwd, top_k(pairs, k_reverse, [c for c in ("part", "src", "q") if c in pairs.columns])


def sampled_queries(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """A hash sample of the query side; the index side stays whole."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top_k(queries: DataFrame, index: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(q, d, score, rank): exact top-k by inner product. The index is cut into blocks of vectors; each
    query meets each block as one row, so rows made are queries x blocks and each block keeps ``k``."""
    import numpy as np
    import pyarrow as pa

    n = index.count()
    blocks = max(1, -(-n // block))
    packed = index.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_b"), F.struct("id", "vec").alias("v")).groupBy("_b").agg(F.collect_list("v").alias("_v"))
    query_blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("_qb"), F.struct("id", "vec").alias("v")).groupBy("_qb").agg(F.collect_list("v").alias("_q"))
    met = asked.crossJoin(packed).select("_q", "_v")

    def run(batches):
        for batch in batches:
            for q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = np.array([x["vec"] for x in q], float), np.array([x["vec"] for x in v], float)
                s = np.round(a @ b.T, 12)
                ids = np.array([x["id"] for x in v])
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(q)), order.shape[1])
                at = order.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.array([x["id"] for x in q])[rows], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(s[rows, at], pa.float64())], names=["q", "d", "score"])

    return top_k(met.mapInArrow(run, "q long, d long, score double"), k, ["q"])


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (q, d) with ``cos`` of their vectors."""
    a, b = left.select(F.col("id").alias("q"), F.col("vec").alias("_a")), right.select(F.col("id").alias("d"), F.col("vec").alias("_b"))
    return pairs.join(a, "q").join(b, "d").withColumn("cos", F.round(dot(F.col("_a"), F.col("_b")), 6)).drop("_a", "_b")


def two_sided(record_lists: DataFrame, entity_lists: DataFrame) -> DataFrame:
    """Union of record-side and entity-side lists (q, d): cosine of either, ranks -1 where absent."""
    a = record_lists.select("q", "d", F.col("score").alias("_x"), F.col("rank").alias("drank_rec"))
    b = entity_lists.select("q", "d", F.col("score").alias("_y"), F.col("rank").alias("drank_s1"))
    out = a.join(b, ["q", "d"], "full")
    return out.select("q", "d", F.coalesce("_x", "_y").alias("cos"), F.coalesce("drank_rec", F.lit(-1)).alias("drank_rec"), F.coalesce("drank_s1", F.lit(-1)).alias("drank_s1"))


def rank_of(wanted: DataFrame, lists: DataFrame, queried: DataFrame, name: str = "rank") -> DataFrame:
    """``wanted`` (q, d) with the rank of d in q's list: -1 not found, -2 q was never a query."""
    asked = queried.select("q", F.lit(True).alias("_asked")).distinct()
    out = wanted.join(lists.select("q", "d", F.col("rank").alias("_r")), ["q", "d"], "left").join(asked, "q", "left")
    return out.withColumn(name, F.when(F.col("_asked").isNull(), -2).otherwise(F.coalesce("_r", F.lit(-1)))).drop("_r", "_asked")


def recall_at(ranks: DataFrame, ks: tuple[int, ...], by: str | None = None) -> DataFrame:
    """Share of pairs found at rank below each k, overall and per group."""
    aggs = [F.avg(((F.col("rank") >= 0) & (F.col("rank") < k)).cast("double")).alias(f"r_at_{k}") for k in ks]
    return ranks.cube(by).agg(F.count(F.lit(1)).alias("n"), *aggs) if by else ranks.agg(F.count(F.lit(1)).alias("n"), *aggs)


def projected(df: DataFrame, buckets: float = 2.0, tables: int = 3, seed: int = 1):
    """A random-projection index of vectors for approximate search (vector column ``features``)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=buckets, numHashTables=tables, seed=seed).fit(df)
