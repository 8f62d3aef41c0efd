"""Modified Kneser-Ney over word pairs, in sorted hash arrays that are counted and asked by bucket.

Every pair of neighbouring words of every text counts, so the model grows with the corpus; nothing of it
is gathered on the driver or broadcast but a row of discounts for each language. Words are lower-cased,
between ASCII white space, and every character from U+3000 to U+9FFF is a word; a text starts with a mark
of its own. Words and pairs travel as 44-bit hashes with the language in them: among n of them one in
2**44 / n is mistaken for another.

There are two models of each language: of the words themselves, and of their shapes (runs of lower-case
letters, capitals and digits as one sign each, other ASCII signs as they are), which tells the build of a
text where its words are rare.

Texts of one language and half are packed into chunks of about ``CHUNK`` bytes: the hashes of
their distinct words, the text as places in that array, and what is known of each text. The chunk table
is bucketed by chunk, so that joining what is found out about a chunk does not shuffle it. Then

1. every chunk sends its distinct pairs, with counts, to the bucket of their hash. A bucket sorts and sums
   them, and answers each chunk with the other half's count of its pairs; the first chunk that has a
   pair also gets the own half's, and so speaks for it in what follows;
2. every chunk sends, for its words, the sums over pairs it speaks for: the occurrences of a word as the
   first of a pair, its pairs seen once, twice and more often, and its pairs as the second. The word's
   bucket adds them up and answers with the other half's;
3. every chunk scores its texts.

Texts are dealt to two halves by the hash of language and text, and each half is scored by the counts of
the other: a text's own pairs would vouch for themselves. Exact copies fall into one half. A first word
that the other half does not have leaves the probability to the second word's continuation count, and
that to a uniform share of all words. Sums do not depend on how texts are dealt to tasks.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import LOWER, Scratch, released, runs, session, ship, shuffle_width
from kinfold.llm.words import mix, word_hashes

BITS, CHUNK, BUCKET = 44, 24 << 20, 1 << 22
LAYERS = ("word", "shape")
SHAPE = bytes(ord("a") if b >= 128 or 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b for b in range(256))
_ODD = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
CHUNKS = "chunk long, layer int, lang string, half int, model string, doc_id array<long>, facts binary, words binary, places binary"


_CHUNKS = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, each as wide as the largest needs, compressed."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Numbers as differences, which are small where they ascend and wrap around where they do not."""
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def expand_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw), dtype=np.uint64)


def model_of(layer: int, lang: str | None) -> str:
    return LAYERS[layer] + ("" if lang is None else ":" + lang)


def model_hash(model: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(model.encode(), digest_size=8).digest(), "little"))


def half_of() -> Column:
    return F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\0")), F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")


def shapes(raw: bytes) -> bytes:
    """A text with runs of one kind of character cut to the first."""
    a = np.frombuffer(raw.translate(SHAPE), np.uint8)
    return a[np.append(True, a[1:] != a[:-1])].tobytes() if len(a) else raw


def pack_texts(model: str, raw: list[bytes]) -> tuple[bytes, bytes, list[int]]:
    """The hashes of the distinct words (or shapes) of some texts and of the mark that starts a text, more
    frequent ones first, so that places are small numbers, and sorted among equals; the texts' words as
    places in them, and where each text ends."""
    if model.startswith(LAYERS[0]):
        hashes, ends = word_hashes([r.translate(LOWER) for r in raw], apart=True)
    else:
        hashes, ends = word_hashes([shapes(r) for r in raw])
    keys = mix(hashes ^ model_hash(model)) >> np.uint64(64 - BITS)
    words, at, n = np.unique(np.append(keys, start_key(model)), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return squeeze_sorted(words[order]), squeeze(rank[at[:-1]]), ends


def start_key(model: str) -> np.uint64:
    return mix(np.array([~model_hash(model)], np.uint64))[0] >> np.uint64(64 - BITS)


class Chunk:
    """A chunk read back: ``v`` and ``w`` are the places of each pair's words, ``pair`` its place among the
    sorted distinct pairs ``keys``, and ``count`` how often each of those occurs."""

    def __init__(self, model: str, words: bytes, places: bytes, ends: np.ndarray):
        held = expand_sorted(words)
        order = np.argsort(held)
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        self.words, self.w = held[order], at[expand(places).astype(np.int64)]
        self.v = np.empty_like(self.w)
        self.v[1:] = self.w[:-1]
        begins = np.concatenate([[0], ends[:-1]])
        self.v[begins[begins < ends]] = np.searchsorted(self.words, start_key(model))
        hashed = mix(self.words[self.v] * _ODD[0] + mix(self.words[self.w] * _ODD[1])) >> np.uint64(64 - BITS)
        self.keys, first, self.pair, self.count = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
        self.first_v, self.first_w = self.v[first], self.w[first]


def chunked(docs: DataFrame, facts, scratch: Scratch) -> DataFrame:
    """The chunk table of ``docs`` (doc_id, lang, text). ``facts`` gives whole numbers for a text, which the
    chunk keeps beside its end."""
    ship(session(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple, list] = {}
        sizes: dict[tuple, int] = {}

        def packed(key: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = held.pop(key)
            sizes.pop(key)
            made += 1
            for layer in range(len(LAYERS)):
                model = model_of(layer, key[0])
                words, places, ends = pack_texts(model, [r[2] for r in rows])
                table = np.array([[*r[1], e] for r, e in zip(rows, ends, strict=True)] if layer == 0 else [[e] for e in ends], np.uint64)
                columns = [part << 32 | made << 1 | layer, layer, key[0], key[1], model, [r[0] for r in rows], squeeze(table.reshape(-1)), words, places]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, _CHUNKS, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in (some for whole in batches for some in runs(whole, 2, 1 << 21)):
            for doc_id, lang, text, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                held.setdefault((lang, half), []).append((doc_id, facts(text), raw))
                sizes[lang, half] = sizes.get((lang, half), 0) + len(raw) + 64
                if sizes[lang, half] >= CHUNK:
                    yield from packed((lang, half))
                if sum(sizes.values()) >= 2 * CHUNK:
                    yield from packed(max(sizes, key=sizes.__getitem__))
        for key in list(held):
            yield from packed(key)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", half_of().alias("half")).mapInArrow(released(run), CHUNKS)
    spark, name = session(docs), f"kinfold_chunks_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("compression", "none").option("path", f"{scratch.root}/chunks")
    writer.bucketBy(shuffle_width(spark), "chunk").saveAsTable(name)
    atexit.register(lambda: spark.sparkContext._jsc and spark.sql(f"drop table if exists {name}"))
    return spark.table(name)


def facts_of(raw: bytes, n: int) -> np.ndarray:
    return expand(raw).astype(np.int64).reshape(n, -1)


def opened(row: dict) -> Chunk:
    ends = facts_of(row["facts"], len(row["doc_id"]))[:, -1]
    return Chunk(row["model"], row["words"], row["places"], ends)


def sent(chunk: int, model: str, half: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[dict]:
    """A chunk's sorted keys with their numbers, cut by bucket."""
    cuts = np.searchsorted(keys, np.array([(i << BITS) // buckets for i in range(buckets)] + [1 << BITS], np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[b], cuts[b + 1])
        yield {"bucket": b, "model": model, "chunk": chunk, "half": half, "keys": squeeze_sorted(keys[at]), "numbers": [squeeze(c[at]) for c in columns]}


ASKED = "bucket int, model string, chunk long, half int, keys binary, numbers array<binary>"
ANSWERED = "chunk long, bucket int, model string, numbers array<binary>"
_ASKED = pa.schema([("bucket", pa.int32()), ("model", pa.string()), ("chunk", pa.int64()), ("half", pa.int32()), ("keys", pa.binary()), ("numbers", pa.list_(pa.binary()))])
_ANSWERED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("model", pa.string()), ("numbers", pa.list_(pa.binary()))])


def ask(chunks: DataFrame, send, answer, buckets: int) -> DataFrame:
    """What the buckets answer: ``send`` gives the rows of a chunk, ``answer`` takes one bucket's keys of one
    model (halves, keys, numbers, one array a chunk) and gives each chunk's numbers and the bucket's own."""

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if rows := list(send(row, buckets)):
                    yield pa.RecordBatch.from_pylist(rows, schema=_ASKED)

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, model), group in groupby(rows_of(batches), key=lambda r: (r["bucket"], r["model"])):
            rows = list(group)
            keys = [expand_sorted(r["keys"]) for r in rows]
            told, own = answer([r["half"] for r in rows], keys, [np.stack([expand(x) for x in r["numbers"]]) for r in rows])
            made = [{"chunk": r["chunk"], "bucket": bucket, "model": model, "numbers": [squeeze(x) for x in t]} for r, t in zip(rows, told, strict=True)]
            yield pa.RecordBatch.from_pylist([*made, {"chunk": -1, "bucket": bucket, "model": model, "numbers": [squeeze(own)]}], schema=_ANSWERED)

    dealt = chunks.mapInArrow(released(out), ASKED).repartition(buckets, "bucket").sortWithinPartitions("bucket", "model", "chunk")
    return dealt.mapInArrow(released(back), ANSWERED)


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def send_pairs(row: dict, buckets: int) -> Iterator[dict]:
    c = opened(row)
    yield from sent(row["chunk"], row["model"], row["half"], c.keys, [c.count], buckets)


def answer_pairs(halves: list[int], keys: list[np.ndarray], numbers: list[np.ndarray]):
    """Per chunk: the other half's count of each pair, and both halves' (own first) where it speaks for it."""
    sizes = [len(k) for k in keys]
    half, n = np.repeat(halves, sizes), np.concatenate([x[0] for x in numbers]).astype(np.float64)
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.stack([np.bincount(at, weights=n * (half == g), minlength=len(distinct)) for g in (0, 1)]).astype(np.int64)
    other, own = total[1 - half, at], np.zeros(len(at), np.int64)
    own[first] = total[half[first], np.arange(len(distinct))]
    cuts = np.cumsum(sizes)[:-1]
    told = [[o, w] for o, w in zip(np.split(other, cuts), np.split(own, cuts), strict=True)]
    return told, np.array([*counts_of_counts(total[0]), *counts_of_counts(total[1])])


def answers(row: dict, name: str, width: int) -> np.ndarray:
    """A chunk's answers in the order of its keys, one row for each number."""
    got = sorted(row[name] or [], key=lambda a: a["bucket"])
    return np.concatenate([np.stack([expand(x) for x in a["numbers"]]) for a in got], axis=1).astype(np.int64) if got else np.zeros((width, 0), np.int64)


def send_words(row: dict, buckets: int) -> Iterator[dict]:
    c = opened(row)
    other, own = answers(row, "pairs", 2)
    speaks = own > 0
    v, w, n = c.first_v[speaks], c.first_w[speaks], len(c.words)
    columns = []
    for g in (0, 1):
        k = (own if row["half"] == g else other)[speaks]
        columns += [np.bincount(x, weights=y, minlength=n).astype(np.int64) for x, y in ((v, k), (v, k == 1), (v, k == 2), (v, k > 2), (w, k > 0))]
    yield from sent(row["chunk"], row["model"], row["half"], c.words, columns, buckets)


def answer_words(halves: list[int], keys: list[np.ndarray], numbers: list[np.ndarray]):
    """Per chunk: the other half's sums for its words."""
    sizes = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate(numbers, axis=1).astype(np.float64)
    total = np.stack([np.bincount(at, weights=x, minlength=len(distinct)) for x in n]).astype(np.int64)
    cuts = np.cumsum([0, *sizes])
    told = [list(total[5 * (1 - h) : 5 * (2 - h), at[a:b]]) for h, a, b in zip(halves, cuts, cuts[1:], strict=False)]
    own = [x for second in (total[4], total[9]) for x in (*counts_of_counts(second), int((second > 0).sum()), second.sum())]
    return told, np.array([*own, int(((total[4] > 0) | (total[9] > 0)).sum())])


def discounts(n: list[float]) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts, 0 for a count of 0."""
    n1, n2, n3, n4 = map(float, n)
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9 * 3]
    return np.array([0.0] + [min(max(x, 0.01), k + 0.99) for k, x in enumerate(d)])


def summed(found: DataFrame) -> dict[str, np.ndarray]:
    """The buckets' own numbers added up: one row for each model."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["model"] for r in rows], pa.string()), pa.array([expand(r["numbers"][0]).astype(np.int64) for r in rows], pa.list_(pa.int64()))], names=["model", "n"])

    rows = found.where("chunk = -1").select("model", "numbers").mapInArrow(add, "model string, n array<long>")
    parts = rows.select("model", F.posexplode("n").alias("k", "x")).groupBy("model", "k").agg(F.sum("x").alias("x")).collect()
    out: dict = {}
    for r in parts:
        out.setdefault(r.model, {})[r.k] = r.x
    return {model: np.array([x[k] for k in sorted(x)]) for model, x in out.items()}


def less(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts without their discounts."""
    return n - d[np.minimum(n, 3)]


class Scorer:
    """Probabilities of one language's words under one half's counts, from what its buckets said: counts of
    counts of pairs, and of words by the pairs they end, with how many words and pairs there are."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray, half: int):
        self.pair, self.word = discounts(list(pairs[4 * half : 4 * half + 4])), discounts(list(words[6 * half : 6 * half + 4]))
        once, twice, _, _, types, self.total = (int(x) for x in words[6 * half : 6 * half + 6])
        self.saved, self.size = float(self.word @ [0, once, twice, types - once - twice]), max(1, int(words[12]))

    def words(self, second: np.ndarray) -> np.ndarray:
        """Probability of each word by its continuation count, the rest shared by all words alike."""
        if not self.total:
            return np.full(len(second), 1 / self.size)
        return (less(second, self.word) + self.saved / self.size) / self.total

    def pairs(self, count: np.ndarray, first: np.ndarray, rest: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of the second word after the first; ``rest`` has the first's pairs seen once, twice, more."""
        saved = self.pair[1:] @ rest
        return np.where(first > 0, (less(count, self.pair) + saved * word) / np.maximum(first, 1), word)


def scored(row: dict, scorer: Scorer) -> np.ndarray:
    """The mean log probability of each text's words, 0 for a text without any."""
    ends = facts_of(row["facts"], len(row["doc_id"]))[:, -1]
    if not ends[-1]:
        return np.zeros(len(ends))
    c = opened(row)
    stats = answers(row, "stats", 5)
    p = scorer.pairs(answers(row, "pairs", 2)[0][c.pair], stats[0][c.v], stats[1:4][:, c.v], scorer.words(stats[4])[c.w])
    sums = np.concatenate([[0.0], np.cumsum(np.log(p))])
    return (sums[ends] - sums[np.concatenate([[0], ends[:-1]])]) / np.maximum(np.diff(ends, prepend=0), 1)


def word_scores(docs: DataFrame, facts, names: list[str], scratch: Scratch) -> DataFrame:
    """(doc_id, lang, *names, n_scored, word_logp, shape_logp) per row of ``docs`` (doc_id, lang, text): ``facts``
    of its text, the words that were scored, and the mean log probability of its words and of their
    shapes under the other half's models."""
    spark = session(docs)
    chunks = chunked(docs, facts, scratch)

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(facts_of(r["facts"], len(r["doc_id"]))[-1, -1]) for r in batch.to_pylist()], pa.int64())], names=["n"])

    total = chunks.select("doc_id", "facts").mapInArrow(lengths, "n long").agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-total // BUCKET))
    pairs = scratch.put(ask(chunks, send_pairs, answer_pairs, buckets), "pairs", "none")
    scratch.release()

    def of(found: DataFrame, name: str) -> DataFrame:
        return found.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "numbers")).alias(name))

    known = chunks.join(of(pairs, "pairs"), "chunk", "left")
    stats = scratch.put(ask(known, send_words, answer_words, buckets), "stats", "none")
    scratch.release()
    of_pairs, of_words = summed(pairs), summed(stats)
    shared = spark.sparkContext.broadcast({model: [Scorer(x, of_words[model], h) for h in (0, 1)] for model, x in of_pairs.items()})
    n = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                told, size = facts_of(row["facts"], len(row["doc_id"])), len(row["doc_id"])
                counts = np.diff(told[:, -1], prepend=0)
                logp = scored(row, shared.value[row["model"]][1 - row["half"]]) if counts.any() else np.zeros(size)
                own = told[:, :n].T if row["layer"] == 0 else np.zeros((n, size), np.int64)
                both = [pa.array(logp if row["layer"] == k else [None] * size, pa.float64()) for k in range(len(LAYERS))]
                columns = [pa.array([row["chunk"] >> 1] * size), pa.array(range(size), pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array([row["lang"]] * size, pa.string()), *map(pa.array, own)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts if row["layer"] == 0 else [0] * size, pa.int64()), *both], names=heads)

    schema = ", ".join(["chunk long, at int, doc_id long, lang string", *[f"{x} long" for x in names], "n_scored long, word_logp double, shape_logp double"])
    heads = [x.split()[0] for x in schema.split(", ")]
    rows = known.join(of(stats, "stats"), "chunk", "left").mapInArrow(released(run), schema)
    most = [F.max(c).alias(c) for c in heads[2:]]
    return rows.groupBy("chunk", "at").agg(*most).drop("chunk", "at")
