"""Benchmark decontamination by suffix arrays of the training documents.

Every Arrow batch of documents is one shard of the training corpus. A shard's words are numbered by
the benchmark's vocabulary (words outside it are 0) and its suffixes are sorted by their first
``window`` words. A suffix that meets a 0 before the shortest window is full cannot match any test
suffix, so only the others are sorted; that is exact and keeps the arrays small. Every window of
every benchmark item is a test suffix: binary search gives its range in each shard's array, and so
all verbatim occurrences. Equal windows of several items are searched once. The longest verbatim match of
a document, with its place there and in the benchmark, comes from extending occurrences in the
benchmark block's own suffix array.

Words: A-Z lower-cased, runs of digits, a-z and any character from U+0080 up. An item of fewer
words than the window is one window; items without words, or without an id, have none. Null texts
have no words. Repeated items with one id count once. The benchmark is split into blocks of at most
``block_bytes`` of text; each block is one bounded broadcast and one pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import Scratch, read, released, runs, session, ship

WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class TestSuffixes:
    """One block of benchmark items: their distinct windows as sorted search keys, each with the items that
    own it, and the suffix array of all their words."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]], window: int = 13):
        split = [(i, ws) for i, t in items if i is not None and (ws := words_of(t))]
        self.window = window
        self.vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, ws in split for w in ws))}
        self.wide = np.dtype(">u2") if len(self.vocabulary) < 65_000 else np.dtype(">u4")
        self.items = np.array([i for i, _ in split], np.int64)
        sizes = np.array([len(ws) for _, ws in split], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes + 1) - sizes - 1  # a 0 parts the items
        ids = np.zeros(int((sizes + 1).sum()) + window, np.int64)
        for at, (_, ws) in zip(self.starts.tolist(), split, strict=True):
            ids[at : at + len(ws)] = [self.vocabulary[w] for w in ws]
        counts = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        place = np.repeat(self.starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        length = np.minimum(np.repeat(sizes, counts), window)
        rows = ids[place[:, None] + np.arange(window)] * (np.arange(window) < length[:, None])
        self.low, first, self.group = np.unique(self.keys(rows), return_index=True, return_inverse=True)
        top = np.where(np.arange(window) < length[first][:, None], rows[first], np.iinfo(self.wide).max)
        self.high, self.length = self.keys(top), length[first]
        self.shortest = int(length.min(initial=window))
        pairs = np.unique(np.stack([self.group, np.repeat(self.items, counts)], 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
        lists: dict[tuple[int, ...], int] = {}
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(self.low) + 1))
        self.owners = np.array([lists.setdefault(tuple(pairs[x:y, 1].tolist()), len(lists)) for x, y in zip(cuts, cuts[1:], strict=False)], np.int64)
        self.lists = list(lists)
        self.order = suffix_order(ids[: len(ids) - window])
        self.text = ids[: len(ids) - window].astype(">u4").tobytes()
        del self.group

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Rows of word numbers as byte strings that sort alike; equal lengths, so padding never confuses them."""
        return np.ascontiguousarray(ids, dtype=self.wide).view(f"S{self.window * self.wide.itemsize}").reshape(-1)

    def bound(self, key: bytes, after: bool = False) -> int:
        """How many suffixes come before a run of words (4 bytes each), or before what follows it."""
        n, low, high = len(key), 0, len(self.order)
        while low < high:
            mid = (low + high) // 2
            at = 4 * int(self.order[mid])
            part = self.text[at : at + n]
            if part < key or after and part == key:
                low = mid + 1
            else:
                high = mid
        return low

    def known(self, key: bytes) -> bool:
        """Whether a run of words occurs in an item."""
        low = self.bound(key)
        at = 4 * int(self.order[low]) if low < len(self.order) else 0
        return low < len(self.order) and self.text[at : at + len(key)] == key

    def place(self, key: bytes) -> tuple[int, int]:
        """The least (item, word) where a run of words occurs; one shorter than a window only as a whole item."""
        at = self.order[self.bound(key) : self.bound(key, after=True)]
        k = np.searchsorted(self.starts, at, "right") - 1
        if len(key) < 4 * self.window:
            at, k = at[self.sizes[k] == len(key) // 4], k[self.sizes[k] == len(key) // 4]
        first = np.lexsort((at - self.starts[k], self.items[k]))[0]
        return int(self.items[k[first]]), int(at[first] - self.starts[k[first]])


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    rank, step = np.unique(ids, return_inverse=True)[1] if len(ids) else ids, 1
    while True:
        after = np.full(len(ids), -1, np.int64)
        after[: max(len(ids) - step, 0)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.zeros(len(ids), np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        if not len(ids) or new.max() == len(ids) - 1 or step > len(ids):
            return order
        rank, step = new, 2 * step


class Shard:
    """The suffix array of some documents."""

    def __init__(self, texts: list[list[bytes]], tests: TestSuffixes):
        self.tests, w = tests, tests.window
        get = tests.vocabulary.get
        self.starts = np.cumsum([0] + [len(t) + 1 for t in texts])  # a 0 parts the documents
        self.ids = np.zeros(self.starts[-1] + w, np.int64)
        for at, t in zip(self.starts[:-1], texts, strict=True):
            self.ids[at : at + len(t)] = [get(x, 0) for x in t]
        known = self.ids != 0
        zeros = np.flatnonzero(~known)
        run = zeros[np.searchsorted(zeros, np.arange(len(self.ids) - w))] - np.arange(len(self.ids) - w) if len(self.ids) > w else np.zeros(0, int)
        at = np.flatnonzero(run >= tests.shortest)
        keys = np.zeros(0, f"S{w * tests.wide.itemsize}")
        if len(at):
            keys = tests.keys(self.ids[at[:, None] + np.arange(w)])
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence: (index of the distinct window, position in the shard)."""
        left = np.searchsorted(self.keys, self.tests.low, "left")
        right = np.searchsorted(self.keys, self.tests.high, "right")
        n = right - left
        which = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.suffixes[np.repeat(left, n) + inside]

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def hits(self) -> tuple[list[list[int]], list[np.ndarray], list[tuple | None]]:
        """Per document: the items with occurring windows, the hit word positions, the longest match."""
        which, at = self.search()
        n = len(self.starts) - 1
        change = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.tests.length[which], -1)
        hit = np.cumsum(change) > 0
        items: list[list[int]] = [[] for _ in range(n)]
        places, longest = [np.zeros(0, np.int64)] * n, [None] * n
        if not len(which):
            return items, places, longest
        doc = self.documents(at)
        for d, k in np.unique(np.stack([doc, self.tests.owners[which]], 1), axis=0).tolist():
            items[d] = sorted({*items[d], *self.tests.lists[k]}) if items[d] else list(self.tests.lists[k])
        order = np.lexsort((-self.tests.length[which], at))
        at, which, doc = at[order], which[order], doc[order]
        for d in np.unique(doc).tolist():
            a, b = self.starts[d], self.starts[d + 1]
            places[d] = np.flatnonzero(hit[a : b - 1])
            own = slice(*np.searchsorted(doc, [d, d + 1]))
            longest[d] = self.longest(int(a), int(b) - 1, at[own], self.tests.length[which[own]])
        return items, places, longest

    def longest(self, first: int, end: int, at: np.ndarray, length: np.ndarray) -> tuple[int, int, int, int]:
        """(words, word of the document, item, word of the item) of the longest verbatim match in the document
        at first..end, whose windows start at ``at``: a match is extended by doubled steps, and the next one
        looked at is the first that goes on beyond its end. An item shorter than a window matches whole."""
        words = self.ids[first:end].astype(">u4").tobytes()
        zeros = np.append(np.flatnonzero(self.ids[first:end] == 0), end - first)

        def known(a: int, b: int) -> bool:
            return self.tests.known(words[4 * a : 4 * b])

        full = length == self.tests.window
        best = max(((int(n), first - int(p)) for p, n in zip(at[~full], length[~full], strict=True)), default=(0, 0))
        at, k = at[full], 0
        while k < len(at):
            p = int(at[k]) - first
            stop = int(zeros[np.searchsorted(zeros, p)])
            good, step = p + self.tests.window, 1
            while good < stop:  # the farthest end of a match from p
                if good + step <= stop and known(p, good + step):
                    good, step = good + step, 2 * step
                elif step == 1:
                    break
                else:
                    step //= 2
            best = max(best, (good - p, -p))
            if good >= stop:
                k = int(np.searchsorted(at, first + good))
                continue
            low, high = p + 1, good + 1  # the first start whose match holds the word at good
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if known(mid, good + 1) else (mid + 1, high)
            k = max(k + 1, int(np.searchsorted(at, first + low)))
        return best[0], -best[1], *self.tests.place(words[-4 * best[1] : 4 * (best[0] - best[1])])


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded text, read through the driver one partition at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len((r.text or "").encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    yield held


Found = tuple[int, np.ndarray, list[int], tuple | None]


def one_pass(tests: TestSuffixes, texts: list[str | None], limit: int = 1 << 21) -> Iterator[Found]:
    """(n_words, hit positions, items, longest match) per text."""
    i = 0
    while i < len(texts):
        some, size = [], 0
        while i + len(some) < len(texts) and size < limit:
            some.append(words_of(texts[i + len(some)]))
            size += len(some[-1])
        items, places, longest = Shard(some, tests).hits()
        yield from zip(map(len, some), places, items, longest, strict=True)
        i += len(some)


def joined(found: Found, before: dict | None) -> Found:
    """What one block and those before it found in a text; of equally long matches the first in the text, then the least item and place."""
    if not before:
        return found
    n, hit, items, longest = found
    was = tuple(before["longest"]) if before["longest"] else None
    best = min((m for m in (was, longest) if m), key=lambda m: (-m[0], *m[1:]), default=None)
    return n, np.union1d(hit, np.frombuffer(before["hit"], "<i4")), sorted({*items, *before["items"]}), best


def verdict(n_words: int, n_hit: int, share: int = 20) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, match_words long, match_at long, match_item long, match_item_at long"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 4 << 20, keep_rows: bool = False) -> DataFrame:
    """Without ``keep_rows``: ``RESULT`` per row of ``docs``; ``match_*`` are the longest verbatim match of a
    window or more, its place in the document and in an item, null without one. With it: the rows of
    ``docs`` that are not contaminated, columns unchanged. One block of the benchmark is in the driver
    and in the workers at a time; what a block found is written beside the rows for the next."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    spark = session(docs)
    ship(spark)
    scratch = Scratch(spark, "decontaminate")
    rows = docs if keep_rows else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width, text_at, plain = len(rows.columns), rows.columns.index("text"), rows.schema
    extra = "_found"
    while extra in rows.columns:
        extra += "_"
    state = StructType.fromDDL("hit binary, items array<long>, longest array<long>")
    carried = StructType([*plain.fields, StructField(extra, state)])

    def step(tests, first: bool, last: bool):
        schema = to_arrow_schema(plain if last and keep_rows else StructType.fromDDL(RESULT) if last else carried)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in runs(whole, text_at, 1 << 21)):
                before = [None] * batch.num_rows if first else batch.column(width).to_pylist()
                found = [joined(f, b) for f, b in zip(one_pass(tests.value, batch.column(text_at).to_pylist()), before, strict=True)]
                if not last:
                    told = [{"hit": h.astype("<i4").tobytes(), "items": items, "longest": list(m) if m else None} for _, h, items, m in found]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(told, schema.field(width).type)], schema=schema)
                    continue
                bad = [verdict(f[0], len(f[1])) for f in found]
                if keep_rows:
                    yield pa.RecordBatch.from_arrays(batch.columns[:width], schema=schema).filter(pa.array([not b for b in bad]))
                    continue
                names = [hashlib.sha256(",".join(sorted(map(str, f[2]))).encode()).hexdigest() for f in found]
                columns = [[f[0] for f in found], [len(f[1]) for f in found], [len(f[2]) for f in found], names, bad, *[[f[3][k] if f[3] else None for f in found] for k in range(4)]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True)]], schema=schema)

        return released(run)

    blocks = blocks_of(benchmark, block_bytes)
    block, k = next(blocks), 0
    while True:
        after = next(blocks, None)
        tests = spark.sparkContext.broadcast(TestSuffixes(block, window))
        if not after:
            return rows.mapInArrow(step(tests, k == 0, True), plain if keep_rows else RESULT)
        rows = scratch.put(rows.mapInArrow(step(tests, k == 0, False), carried), f"block{k}")
        tests.destroy()
        block, k = after, k + 1


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
