"""Hierarchical weighted hash tree: documents to shards by descending region, rack, shard.

A region's shards lie on a line, each on as much of it as its weight times its rack's. Per document a
region draws by consistent weighted sampling: five hashes of (seed, document, region) give a mark on the
line, uniform over it, and a clock that is exponential in the line's length. The region with the least
clock, divided by its own weight, wins, and its mark is handed down: it falls into the rack and the
shard that own that place. So a document costs five hashes a region and a binary search in one line,
not a draw for every shard.

When a line grows at its end, a region's draw changes only if its mark falls into the new part, and its
clock only becomes less; when a region's weight changes, marks stay. So rows move into the part that
grew and nowhere else: independent draws at rack and shard level would let rows that enter a grown
region land in its old shards, against the ``key`` law. ``lines`` with ``before`` keeps what shards have
and appends what they gain; what a shard gives up becomes a gap, and a mark in a gap is drawn anew,
after ``ATTEMPTS`` draws by the least clock of all shards.

Null keys are all drawn alike. Repeated rows land together and are carried as one row with a count.
Documents with null text have no bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import Scratch, crc_of_text, read, repeated, session


@dataclass(frozen=True)
class Node:
    """A tree node: a leaf names its shard, an inner node its children."""

    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())


def grid_tree(n_shards: int, racks: int = 3, per_rack: int = 4) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` equal shards, filled in order."""
    regions: list[list[list[Node]]] = []
    for s in range(n_shards):
        region, rack = divmod(s, racks * per_rack)[0], s // per_rack % racks
        if region == len(regions):
            regions.append([])
        if rack == len(regions[region]):
            regions[region].append([])
        regions[region][rack].append(Node(shard=s))
    return Node(children=tuple(Node(children=tuple(Node(children=tuple(k)) for k in r)) for r in regions))


ATTEMPTS = 4


@dataclass(frozen=True)
class Line:
    """A region: its weight and the (start, end, shard) parts of its line, in order, gaps between them."""

    weight: float
    parts: tuple[tuple[float, float, int], ...]

    @property
    def length(self) -> float:
        return self.parts[-1][1] if self.parts else 0.0

    @property
    def whole(self) -> bool:
        return all(a[1] == b[0] for a, b in zip(self.parts, self.parts[1:], strict=False)) and (not self.parts or self.parts[0][0] == 0)


def shares(node: Node, weight: float = 1.0) -> dict[int, float]:
    """Weight of every shard below a node, without the node's own."""
    out = {}
    for c in node.children:
        out |= {c.shard: weight * c.weight} if c.shard is not None else shares(c, weight * c.weight)
    return out


def lines(tree: Node, before: list[Line] | None = None) -> list[Line]:
    """The regions' lines. Shards stand in order of their numbers, which grow with time; after ``before``
    they keep their parts, gain at the end and give up their latest parts first."""
    out = []
    for k, region in enumerate(tree.children):
        want = dict(sorted((shares(region) if region.shard is None else {region.shard: 1.0}).items()))
        parts = []
        for a, b, shard in reversed(before[k].parts if before and k < len(before) else ()):
            has = sum(y - x for x, y, s in before[k].parts if s == shard)
            cut = max(0.0, has - want.get(shard, 0.0) - sum(y - x for x, y, s in before[k].parts if s == shard and x > a))
            if b - min(cut, b - a) > a:
                parts.insert(0, (a, b - min(cut, b - a), shard))
        end = parts[-1][1] if parts else 0.0
        for shard, w in want.items():
            gain = w - sum(y - x for x, y, s in parts if s == shard)
            if gain > 1e-12:
                parts.append((end, end + gain, shard))
                end += gain
        out.append(Line(region.weight, tuple(parts)))
    return out


def uniform(seed: int, *cols: Column) -> Column:
    """A double in (0, 1) from 53 bits of the rows' hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def owner(mark: Column, parts: tuple[tuple[float, float, int], ...]) -> Column:
    """The shard whose part holds the mark, by halving; null in a gap."""
    if len(parts) == 1:
        a, b, shard = parts[0]
        return F.when((mark > a) & (mark <= b), F.lit(shard))
    half = len(parts) // 2
    return F.when(mark <= parts[half - 1][1], owner(mark, parts[:half])).otherwise(owner(mark, parts[half:]))


def drawn(key: Column, region: int, line: Line, seed: int, attempt: int) -> Column:
    """(clock, region, mark): consistent weighted sampling of one region's line."""
    u = [uniform(seed, key, F.lit(region), F.lit(attempt), F.lit(i)) for i in range(5)]
    r, c = -F.log(u[0] * u[1]), -F.log(u[2] * u[3])
    step = F.floor(F.lit(math.log(line.length)) / r + u[4])
    mark = F.least(F.exp(r * (step - u[4])), F.lit(line.length))
    return F.struct((c / (mark * F.exp(r)) / F.lit(line.weight)).alias("t"), F.lit(region).alias("region"), mark.alias("mark"))


def place(key: Column, tree: Node | list[Line], seed: int = 17) -> Column:
    """The shard of ``key``: the region with the least clock, then the place its mark falls on."""
    at = tree if isinstance(tree, list) else lines(tree)
    live = [(k, line) for k, line in enumerate(at) if line.parts and line.weight > 0]
    if not live:
        raise ValueError("no shard of the tree has a positive weight")

    def attempt(n: int) -> Column:
        draws = [drawn(key, k, line, seed, n) for k, line in live]

        def fall(best: Column) -> Column:
            out = F.lit(None).cast("int")
            for k, line in live:
                out = F.when(best["region"] == k, owner(best["mark"], line.parts)).otherwise(out)
            return out

        return let(F.least(*draws) if len(draws) > 1 else draws[0], fall)

    if all(line.whole for _, line in live):
        return attempt(0)
    weight: dict[int, float] = {}
    for _, line in live:
        for a, b, shard in line.parts:
            weight[shard] = weight.get(shard, 0.0) + (b - a) * line.weight
    clocks = [F.struct((-F.log(uniform(seed, key, F.lit(-1), F.lit(s))) / F.lit(w)).alias("t"), F.lit(s).alias("s")) for s, w in weight.items()]
    return F.coalesce(*[attempt(n) for n in range(ATTEMPTS)], (F.least(*clocks) if len(clocks) > 1 else clocks[0])["s"])


def let(x: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def slots(placed: DataFrame, scratch: Scratch, buckets: int = 256) -> DataFrame:
    """Add ``slot``: positions gapless from 0 in each shard, without sorting a shard in one task.

    Equal rows are one row with a count. They are dealt to ``buckets`` hash buckets of a shard, numbered
    inside each, and each bucket starts where the buckets before it end. The offsets table has shards x
    buckets rows. Rows of ``placed`` are told apart by all their columns.
    """
    alike = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = scratch.put(alike.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")), "placed")
    sizes = rows.groupBy("shard", "_b").agg(F.sum("_n").alias("_s"))
    before = W.partitionBy("shard").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = scratch.put(sizes.select("shard", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o")), "offsets")
    inside = W.partitionBy("shard", "_b").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("_r", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "_b"])
    return repeated(numbered, "_n", "_i").withColumn("slot", F.col("_o") + F.col("_r") + F.col("_i")).drop("_b", "_o", "_r", "_n", "_i")


def shard_documents(docs: DataFrame, tree: Node | list[Line], grown: Node | list[Line] | None = None, seed: int = 17, buckets: int = 256) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot[, grown_shard]); one per row of ``docs``.

    Only the narrow row is shuffled, never the text. Null text counts as no bytes.
    """
    scratch = Scratch(session(docs), "sharding")
    placed = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        crc_of_text(F.col("text")).alias("text_crc32"),
        place(F.col("doc_id"), tree, seed).cast("int").alias("shard"),
        *([place(F.col("doc_id"), grown, seed).cast("int").alias("grown_shard")] if grown else []),
    )
    return slots(placed, scratch, buckets)


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"), grid_tree(24), grid_tree(25))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
