"""Incremental blocking: records that arrive as a stream against a fixed entity index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.retrieval import inverse_frequencies, norms, postings, scored_pairs, top_k, word_grams


@dataclass
class EntityIndex:
    """``idf`` (part, term, idf) of the known terms, ``weights`` (part, id, term, w) of the entities."""

    idf: DataFrame
    weights: DataFrame
    grams: object


def entity_index(entities: DataFrame, known: DataFrame, max_df: float = 0.01, min_df: int = 1, grams=word_grams) -> EntityIndex:
    """An index of ``entities`` (part, id, text). Frequencies are those of all ``known`` documents (part,
    id, text), the entities or more, so that arriving records are weighed as a batch join would."""
    by = ["part", "side"]
    both = known.select("part", F.lit(1).alias("side"), "id", "text").unionByName(entities.select("part", F.lit(0).alias("side"), "id", "text"))
    tf = postings(both, grams(F.col("text")), by)
    idf = inverse_frequencies(tf, both.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs")), ["part"], max_df, min_df)
    return EntityIndex(idf, _unit(tf.where("side = 0").drop("side"), idf), grams)


def _unit(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """(part, id, term, w): weights of length one; terms that the index does not know have none."""
    w = tf.join(idf, ["part", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return w.join(norms(w, ["part"]), ["part", "id"]).select("part", "id", "term", (F.col("w") / F.col("norm")).alias("w"))


def arriving_matches(stream: DataFrame, index: EntityIndex, k: int = 3, min_score: float = 0.0):
    """A ``foreachBatch`` body: scores each micro-batch against the index and keeps the best ``k``.

    Ranking needs whole records, and a record is never split over micro-batches, so each batch is
    complete on its own; the sink gets (part, q, d, score, rank).
    """

    def body(sink):
        def run(batch: DataFrame, batch_id: int) -> None:
            queries = _unit(postings(batch, index.grams(F.col("text")), ["part"]), index.idf)
            scored = scored_pairs(queries, index.weights, ["part"], min_score)
            sink(top_k(scored, k, ["part", "q"]).withColumn("batch_id", F.lit(batch_id)))

        return run

    return body


def windowed_arrivals(events: DataFrame, time: str = "ts", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Arrivals and distinct users per time window and type; late rows beyond ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))
