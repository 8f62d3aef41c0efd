"""Source mixing by Sainte-Laguë apportionment of equal-token blocks.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a
target stops at ``max_repeat`` times its source's size and the excess is reshared by weight.

Apportionment. The mix has one block for every ``block_words`` words of all documents; each goes to
the source with the highest quotient target / (2 blocks + 1), and inside a source to the shard with the
highest quotient of its words, so every (source, shard) cell has an integer quota of blocks.

Selection. A cell's documents stand in seeded hash order, their words one after the other, cut into
equal blocks. The quota takes blocks from the first on, and from the first again where it is larger
than the cell, up to ``max_repeat`` rounds. So a cell's mix is some whole rounds, the documents before
the cut once more, and the words before the cut of the one document it falls into.

Shards. A source has a shard for every ``shard_words`` of its words; beyond ``max_cells`` shards in all,
shards hold as many more words as that needs. The driver handles a row per source (at most
``max_cells``, else an error) and a row per cell, never documents.

Documents without words take no part: their ``taken`` is 0, and ``mixed`` leaves them as they are. Null
sources are a source of their own. Repeated rows are separate documents that stand together; they are
carried as one row with a count. An empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import SPACED, Scratch, read, repeated, session, word_count

WEIGHTS = (5, 2, 1)
PIECE = "[\\x20\\x09-\\x0D]*+" + SPACED + "+"
"""A word with the white space before it."""


def targets(sizes: list[int], weights: list[int], max_repeat: int = 3) -> list[float]:
    """Shares of the total by weight, none above ``max_repeat`` times its size: sources are capped from
    the least size for its weight on, while the share that is left to them exceeds their cap."""
    left, weight, caps = sum(sizes), sum(weights), [max_repeat * s for s in sizes]
    out: dict[int, float] = {}
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(caps[i], weights[i])):
        if left * weights[i] <= caps[i] * weight:
            break
        out[i] = float(caps[i])
        left, weight = left - caps[i], weight - weights[i]
    return [out[i] if i in out else left * weights[i] / weight for i in range(len(sizes))]


def apportion(wanted: list[float], seats: int, limits: list[int] | None = None) -> list[int]:
    """Sainte-Laguë: seats one by one to the highest wanted / (2 seats + 1), first index on ties.
    Starts below the rounded shares, which every highest-quotient allocation passes through."""
    total = sum(wanted)
    if not total or seats <= 0:
        return [0] * len(wanted)
    limits = limits if limits is not None else [seats] * len(wanted)
    got = [min(limit, max(0, int(seats * w / total) - 1)) for w, limit in zip(wanted, limits, strict=True)]
    heap = [(-Fraction(w) / (2 * g + 1), i) for i, (w, g) in enumerate(zip(wanted, got, strict=True)) if w > 0]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        if got[i] >= limits[i]:
            continue
        got[i] += 1
        left -= 1
        heapq.heappush(heap, (-Fraction(wanted[i]) / (2 * got[i] + 1), i))
    return got


def narrow(docs: DataFrame, seed: int) -> DataFrame:
    """(source, size, h) of every row: ``h`` orders a cell and is alike for repeated rows alone."""
    size = word_count(F.col("text"))
    return docs.select("doc_id", "source", size.alias("size"), order_hash(size, seed).alias("h"))


def order_hash(size: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0")), "doc_id", "text", size)


def shard_of(h: Column, shards: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(seed)), shards).cast("int")


class Plan:
    """What a mix takes: ``sources`` (source, shards, source_size, target), ``groups`` (source, doc_id,
    size, h, n rows alike) and ``cells`` (source, shard, full, at, cut): all documents of the cell
    ``full`` times, those whose h is before ``at`` once more, and ``cut`` words of those at ``at``."""

    def __init__(self, docs: DataFrame, block_words: int, shard_words: int, max_cells: int, max_repeat: int, seed: int):
        self.spark, self.seed, self.max_repeat = session(docs), seed, max_repeat
        scratch = Scratch(self.spark, "mixing")
        alike = narrow(docs, seed).groupBy("source", "doc_id", "size", "h").agg(F.count(F.lit(1)).alias("n"))
        self.groups = scratch.put(alike, "groups")
        found = self.groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).limit(max_cells + 1).collect()
        if len(found) > max_cells:
            raise ValueError(f"more than {max_cells} sources; raise max_cells")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r.words for r in found]
        total = sum(sizes)
        wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], max_repeat) if total else [0.0] * len(sizes)
        per_shard = max(shard_words, -(-total // max_cells))
        rows = [(r.source, max(1, n // per_shard), n, t) for r, n, t in zip(found, sizes, wanted, strict=True)]
        self.sources = self.spark.createDataFrame(rows, "source string, shards int, source_size long, target double")
        placed = self.on_source(self.groups.where("size > 0")).withColumn("shard", shard_of(F.col("h"), F.col("shards"), seed))
        of: dict = {}
        for c in placed.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect():
            of.setdefault(c.source, []).append((c["shard"], c.words))
        quotas = []
        for r, q in zip(found, apportion(wanted, total // block_words), strict=True):
            own = sorted(of.get(r.source, []))
            for (shard, n), blocks in zip(own, apportion([float(n) for _, n in own], q), strict=True):
                words = min(max_repeat * n, blocks * block_words)
                quotas.append((r.source, shard, words // n, words % n))
        quota = self.spark.createDataFrame(quotas, "source string, shard int, full long, rest long")
        before = W.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
        start = placed.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)))
        inside = self.on_cell(start, quota).where("start <= rest and rest < start + size * n")
        one = inside.groupBy("source", "shard").agg(F.max("full").alias("full"), F.max("h").alias("at"), F.max(F.col("rest") - F.col("start")).alias("cut"))
        self.cells = scratch.put(one.coalesce(1), "cells")

    def on_source(self, rows: DataFrame) -> DataFrame:
        s = F.broadcast(self.sources.withColumnRenamed("source", "_source"))
        return rows.join(s, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")

    @staticmethod
    def on_cell(rows: DataFrame, cells: DataFrame) -> DataFrame:
        c = F.broadcast(cells.withColumnsRenamed({"source": "_source", "shard": "_shard"}))
        return rows.join(c, rows["source"].eqNullSafe(F.col("_source")) & (rows["shard"] == F.col("_shard")), "left").drop("_source", "_shard")

    def decided(self, rows: DataFrame) -> DataFrame:
        """Add source_size, target, ``copies``, and ``cut``: words that all rows alike share, where the cut is."""
        at = self.on_cell(self.on_source(rows).withColumn("shard", shard_of(F.col("h"), F.col("shards"), self.seed)), self.cells)
        on = (F.col("size") > 0) & F.col("at").isNotNull()
        copies = F.when(on, F.col("full") + (F.col("h") < F.col("at")).cast("long")).otherwise(F.lit(0).cast("long"))
        return at.withColumns({"copies": copies, "cut": F.when(on & (F.col("h") == F.col("at")), F.col("cut")).otherwise(F.lit(0).cast("long"))}).drop("shards", "shard", "full", "at")


def extra(index: str) -> Column:
    """Words of the cut that go to the row with this number among the rows alike."""
    return F.greatest(F.least(F.col("cut") - F.col(index) * F.col("size"), F.col("size")), F.lit(0))


def mix(docs: DataFrame, block_words: int = 32, shard_words: int = 1 << 16, max_cells: int = 100_000, max_repeat: int = 3, seed: int = 5) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one per row of ``docs``."""
    plan = Plan(docs, block_words, shard_words, max_cells, max_repeat, seed)
    rows = repeated(plan.decided(plan.groups), "n", "_i")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + extra("_i")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its ``n``-th word, white space as it was."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, block_words: int = 32, shard_words: int = 1 << 16, max_cells: int = 100_000, max_repeat: int = 3, seed: int = 5, length: str = "n_chars") -> DataFrame:
    """``docs`` with every row as often as the mix takes it whole, and one row in each cell cut at the
    word where the last block ends (a column named ``length`` then has the cut text's characters).
    Columns unchanged; rows without words are left as they are. Texts are not shuffled: a row's share
    follows from its own hash and its cell's row, which is broadcast."""
    plan = Plan(docs, block_words, shard_words, max_cells, max_repeat, seed)
    size = word_count(F.col("text"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col("source").alias("source"), size.alias("size"), order_hash(size, seed).alias("h"))
    rows = plan.decided(rows)
    kept = rows.select("doc", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("copies")).where("copies > 0")
    out = kept.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc")
    # rows at the cut: repeated rows are numbered in buckets, on a table so that numbers and offsets agree
    many = F.broadcast(plan.groups.where("n > 1").join(F.broadcast(plan.cells.where("cut > 0").select(F.col("at").alias("h"))), "h", "left_semi").select("h", F.col("n")))
    at = rows.where("cut > 0")
    single = at.join(many, "h", "left_anti").withColumn("_i", F.lit(0).cast("long"))
    salted = Scratch(plan.spark, "cuts").put(at.join(many.select("h"), "h", "left_semi").withColumn("_b", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")), "rows")
    ahead = W.partitionBy("h").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("h", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    numbered = salted.withColumn("_r", F.row_number().over(W.partitionBy("h", "_b").orderBy("size"))).join(F.broadcast(offsets), ["h", "_b"]).withColumn("_i", F.col("_o") + F.col("_r") - 1)
    cut = single.select("doc", "size", "cut", "_i").unionByName(numbered.select("doc", "size", "cut", "_i")).withColumn("_w", extra("_i")).where("_w > 0")
    text = F.when(F.col("_w") == F.col("size"), F.col("doc.text")).otherwise(first_words(F.col("doc.text"), F.col("_w")))
    parts = [
        text.alias(c) if c == "text" else F.when(F.col("_w") == F.col("size"), F.col(f"doc.`{c}`")).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c) if c == length else F.col(f"doc.`{c}`").alias(c)
        for c in docs.columns
    ]
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns]).unionByName(cut.select(*parts))


def op9_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
