"""Near duplicates: b-bit MinHash signatures joined by a multi-index Hamming join.

Signature. A document's set holds the 64-bit hashes of its distinct 5-word shingles (A-Z lower-cased,
words between ASCII white space; fewer words: the whole sequence). 96 one-byte MinHash symbols are its
signature; documents with equal sets are one node.

Join. The symbols are cut into 16 chunks of 6. By pigeonhole two signatures that differ in at most 31
symbols have a chunk with at most one error, so filing every node under each chunk with each symbol left
out in turn (96 keys) brings all pairs under that distance together: index and filter have one threshold.
At a similarity of 0.85 a pair exceeds it in 5 of a million cases.

Groups. ``spanning_links`` finds links that join all of a group's close pairs. A group of up to ``SMALL``
nodes is one task's. In a larger one every node is compared with a hub first, then with a hub of those
that no hub took, as long as that halves them. What the links have joined is left out; only pairs of
different components remain, and those are dealt as pairs of blocks with one side outside the group's
largest component. So a large group of near copies costs a few rows a node, no pair is left out, and
pairs inside a component are never enumerated.

Check. The same is done for the components of the candidate edges, with pairs confirmed on full sets.
Links that hold give the final components, named by their least doc_id.

Documents without words are linked with nothing and name themselves. Rows without doc_id are linked as
others are but cannot name a component; one with only such rows has no component_id, and its rows are
kept. Rows with one doc_id and different texts are separate nodes. ``deduplicated`` keeps one row of
each component (least doc_id, then first row) and all rows without words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import LOWER, Scratch, read, released, runs, session, ship, shuffle_width
from kinfold.llm.components import components
from kinfold.llm.words import BASE, mix, word_hashes

CHUNKS, WIDTH, ERRORS, WORDS = 16, 6, 1, 5
SYMBOLS = CHUNKS * WIDTH
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
SMALL, BLOCK, HEAVY = 128, 512, 1 << 15
"""Nodes of a group that one task takes whole, nodes of a block, shingles that count as a node more."""
_rng = np.random.Generator(np.random.PCG64(5))
_ODD = _rng.integers(0, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 1 << 31, SYMBOLS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SYMBOLS).astype(np.uint32)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, limits = word_hashes([(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts])
    n = len(words)
    rolling = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolling[: max(n - k, 0)] += words[k:] * _ODD[k]
    rolling = mix(rolling)
    out, at = [], 0
    for end in limits:
        count = end - at
        if count >= WORDS:
            out.append(np.unique(rolling[at : end - WORDS + 1]))
        elif count:
            out.append(mix(np.array([np.concatenate([words[at:end] * _ODD[:count], _ODD[WORDS:] * np.uint64(count)]).sum()], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at = end
    return out


def signature(shingles: np.ndarray) -> bytes:
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    return (least * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8).tobytes()


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that name a set, whatever the order."""
    return int(mix(shingles + BASE).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(shingles ^ _ODD[0])).astype(np.int64)) if len(shingles) else 0


def sketch(rows: DataFrame) -> DataFrame:
    """(_row, doc_id, n_shingles, node, check, sig) per row (_row, doc_id, text)."""
    ship(session(rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, check, sig = [], [], [], []
            for part in runs(batch, 2, 1 << 20):
                for s in shingle_sets(part.column(2).to_pylist()):
                    a, b = set_id(s)
                    n.append(len(s))
                    node.append(a)
                    check.append(b)
                    sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sig, pa.binary())], names=["_row", "doc_id", "n_shingles", "node", "check", "sig"])

    return rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "_row long, doc_id long, n_shingles long, node long, check long, sig binary")


def filed(nodes: DataFrame) -> DataFrame:
    """(node, key): each chunk of the signature with each of its symbols left out."""
    keys = []
    for slot in range(SYMBOLS):
        chunk, out = divmod(slot, WIDTH)
        first = chunk * WIDTH + 1
        keys.append(F.xxhash64(F.lit(slot), F.substring("sig", first, out), F.substring("sig", first + out + 1, WIDTH - 1 - out)))
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def spanning(nodes: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, left: np.ndarray, right: np.ndarray, holds=None, label=None) -> list[tuple[int, int]]:
    """Edges over close pairs (left, right) that ``holds`` accepts, one for each time two clusters meet.
    Pairs inside a cluster are not looked at; ``label`` names the clusters there are already. ``right``
    may be ``left``, and nodes ascend."""
    label, out = np.arange(len(nodes)) if label is None else label, []
    for i in left:
        js = right[right > i] if left is right else right
        js = js[label[js] != label[i]]
        js = js[(100 * np.minimum(sizes[js], sizes[i]) >= 85 * np.maximum(sizes[js], sizes[i])) & (nodes[js] != nodes[i])]
        if not len(js):
            continue
        apart = (sigs[js] != sigs[i]).sum(1)
        js = js[np.argsort(apart, kind="stable")][: int((apart <= MAX_DISTANCE).sum())]
        for j in js:
            if label[j] != label[i] and (holds is None or holds(i, j)):
                label[label == label[j]] = label[i]
                out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= 85 * (len(a) + len(b) - same)


def edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["u", "v"])


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def in_groups(exact: bool):
    """A batch function over rows (g, bi, bj, seg, label, node, n_shingles, sig[, text]) sorted by the first
    three and node: links between the nodes of segments bi and bj of g."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for (_, bi, bj), group in groupby(rows_of(batches), key=lambda r: r[:3]):
            held = list(group)
            if len(held) < 2:
                continue
            seg, nodes = np.array([r[3] for r in held]), np.array([r[5] for r in held])
            sigs = np.frombuffer(b"".join(r[7] for r in held), np.uint8).reshape(-1, SYMBOLS)
            sets = [shingle_sets([r[8]])[0] for r in held] if exact else []
            left = np.flatnonzero(seg == bi)
            right = left if bi == bj else np.flatnonzero(seg == bj)
            label = np.unique([r[4] for r in held], return_inverse=True)[1]
            found.update(spanning(nodes, np.array([r[6] for r in held]), sigs, left, right, (lambda i, j, s=sets: similar(s[i], s[j])) if exact else None, label))
            if len(found) >= 1 << 16:
                yield edge_batch(list(found))
                found = set()
        if found:
            yield edge_batch(list(found))

    return released(run)


def with_hub(exact: bool):
    """A batch function over rows (node, n_shingles, sig, hub, hub_n, hub_sig[, text, hub_text]): links (u, v)
    of the nodes that are close to their hub."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            out = []
            for node, n, sig, hub, hub_n, hub_sig, *texts in rows_of([batch]):
                apart = int((np.frombuffer(sig, np.uint8) != np.frombuffer(hub_sig, np.uint8)).sum())
                if apart > MAX_DISTANCE or 100 * min(n, hub_n) < 85 * max(n, hub_n):
                    continue
                if exact:
                    if last[0] != hub:
                        last = hub, shingle_sets([texts[1]])[0]
                    if not similar(shingle_sets([texts[0]])[0], last[1]):
                        continue
                out.append((node, hub))
            yield edge_batch(out)

    return released(run)


def spanning_links(groups: DataFrame, payload: DataFrame, scratch: Scratch, name: str, exact: bool) -> DataFrame:
    """Links (u, v) that join whatever close pairs of a group join. ``groups`` has (g, weight, node,
    score): a group's weight in nodes, and a node's score as a hub; ``payload`` (node, n_shingles, sig[, text])."""
    held = ["node", "n_shingles", "sig", *(["text"] if exact else [])]
    payload = payload.select(*held)

    def dealt(parts: DataFrame) -> DataFrame:
        columns = parts.join(payload, "node").select("g", "bi", "bj", "seg", "label", *held)
        ordered = columns.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj", "node")
        return ordered.mapInArrow(in_groups(exact), "u long, v long")

    zero = {c: F.lit(0) for c in ("bi", "bj", "seg")}
    small = dealt(groups.where(F.col("weight") <= SMALL).withColumns(zero | {"label": F.col("node")}))
    big = scratch.put(groups.where(F.col("weight") > SMALL).drop("weight"), f"{name}-big")
    waiting, left, found, turn = big, big.count(), None, 0
    as_hub = payload.withColumnsRenamed({"node": "hub", "n_shingles": "hub_n", "sig": "hub_sig", "text": "hub_text"})
    while left:
        hubs = waiting.groupBy("g").agg(F.max(F.struct("score", "node")).alias("_h")).select("g", F.col("_h.node").alias("hub"))
        open_ = scratch.put(waiting.join(scratch.put(hubs, f"{name}-hubs{turn}"), "g").where("node <> hub"), f"{name}-open{turn}")
        pairs = open_.select("node", "hub").distinct().join(payload, "node").join(as_hub, "hub")
        pairs = pairs.select("node", "n_shingles", "sig", "hub", "hub_n", "hub_sig", *(["text", "hub_text"] if exact else []))
        links = scratch.put(pairs.mapInArrow(with_hub(exact), "u long, v long"), f"{name}-star{turn}")
        found = links if found is None else found.unionByName(links)
        near = open_.join(links.select(F.col("u").alias("node"), F.col("v").alias("hub")), ["node", "hub"], "left_anti")
        waiting = scratch.put(near.select("g", "node", "score"), f"{name}-waiting{turn}")
        before, left, turn = left, waiting.count(), turn + 1
        if 2 * left > before:
            break
    if found is None:
        return small.distinct()
    labels = components(found, scratch, f"{name}-stars").select("node", F.col("root").alias("label"))
    labelled = scratch.put(big.select("g", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), f"{name}-labelled")
    heavy = labelled.join(payload.select("node", (1 + F.col("n_shingles") / F.lit(HEAVY)).alias("_one")), "node") if exact else labelled.withColumn("_one", F.lit(1.0))
    sums = heavy.groupBy("g", "label").agg(F.count(F.lit(1)).alias("_c"), F.sum("_one").alias("_w"))
    tops = sums.groupBy("g").agg(F.max(F.struct("_c", "label")).alias("_top"), F.count(F.lit(1)).alias("_k"), F.sum("_w").alias("_all"), F.max_by("_w", F.struct("_c", "label")).alias("_most")).where("_k > 1")
    tops = scratch.put(tops.select("g", F.col("_top.label").alias("_top"), F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("int").alias("_ks"), F.ceil(F.col("_most") / BLOCK).cast("int").alias("_kd")), f"{name}-tops")
    own = labelled.join(tops, "g").withColumn("_out", F.col("label") != F.col("_top"))
    h = F.xxhash64("node")
    own = own.withColumn("seg", F.when(F.col("_out"), F.pmod(h, F.col("_ks"))).otherwise(F.col("_ks") + F.pmod(h, F.col("_kd"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("_out"), F.col("_ks") + F.col("_kd")).otherwise(F.col("_ks")) - 1)
    parted = own.withColumn("_t", F.explode(others)).withColumns({"bi": F.least("seg", "_t"), "bj": F.greatest("seg", "_t")})
    return small.unionByName(found).unionByName(dealt(parted)).distinct()


def candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that join all nodes (node, n_shingles, sig) which are close and share a key.
    A node's score as a hub is one over all its keys, so a group of near copies has few hubs."""
    keys = filed(nodes).groupBy("key").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1")
    shared = scratch.put(filed(nodes).join(keys, "key"), "keys")
    groups = shared.select(F.col("key").alias("g"), "weight", "node", F.xxhash64("node").alias("score"))
    return spanning_links(groups, nodes, scratch, "keyed", exact=False)


def confirm(texts: DataFrame, nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) that hold on full sets and span the same components as all links do. The hub of a large
    component is the node that shares most keys with others."""
    roots = scratch.put(components(edges, scratch, "candidate"), "roots")
    scores = scratch.spark.read.parquet(f"{scratch.root}/keys").groupBy("node").agg(F.sum("weight").alias("score"))
    placed = scratch.put(roots.join(nodes, "node").join(scores, "node"), "placed")
    weights = scratch.put(placed.groupBy("root").agg((F.count(F.lit(1)) + F.sum("n_shingles") / F.lit(HEAVY)).alias("weight")), "weights")
    groups = placed.join(weights, "root").select(F.col("root").alias("g"), "weight", "node", "score")
    payload = scratch.put(placed.select("node", "n_shingles", "sig", "_row").join(texts, "_row").drop("_row"), "payload")
    return spanning_links(groups, payload, scratch, "confirmed", exact=True)


def linked(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes in ``rows``, sketches of the rows (_row, text)."""
    grouped = rows.where("n_shingles > 0").groupBy("node", "check", "n_shingles").agg(F.min("_row").alias("_row"), F.min("sig").alias("sig"))
    nodes = scratch.put(grouped.drop("check").repartition(shuffle_width(scratch.spark), "node"), "nodes")
    edges = scratch.put(candidates(nodes.select("node", "n_shingles", "sig"), scratch), "edges")
    links = confirm(texts, nodes, edges, scratch)
    roots = components(links, scratch, "linked")
    named = scratch.put(nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    scratch.drop("keys")
    return named


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    scratch = Scratch(session(docs), "neardup")
    texts = scratch.put(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "rows")
    rows = scratch.put(sketch(texts), "sketches")
    of = linked(rows, texts.select("_row", "text"), scratch)
    members = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "node").join(of, "node")
    names = scratch.put(members.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    found = members.join(names, "root").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.unionByName(empty).withColumn("kept", kept)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component and all rows without words, columns unchanged."""
    scratch = Scratch(session(docs), "dedup")
    whole = scratch.put(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "rows")
    rows = scratch.put(sketch(whole.select("_row", "doc.doc_id", "doc.text")), "sketches")
    of = linked(rows, whole.select("_row", "doc.text"), scratch)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "_row")
    first = rows.where("n_shingles > 0").join(of, "node").groupBy("root").agg(F.min(order).alias("_o")).select(F.col("_o._row").alias("_row"))
    kept = first.unionByName(rows.where("n_shingles = 0").select("_row"))
    return whole.join(kept, "_row", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op6_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
