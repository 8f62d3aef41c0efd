"""Token ids of documents in a bit- or byte-plane file format.

Layout. A token table is a folder of Parquet part files, each row a *segment* of whole documents in
ascending doc_id order: ``payload`` holds the segment's ids as blocks of ``block_ids`` ids, each
block transposed into planes (4 byte planes or 32 bit planes of little-endian unsigned 32-bit ids)
and each plane compressed with zstandard. ``chunks`` is the chunk index (offset and length of every
plane of every block and the ids in the block), ``docs`` the documents with their token counts.
Spark's committer writes the parts, so retried tasks leave no torn files on any shared store.

A segment closes with the document that brings it to ``segment_ids`` ids, so it holds whole documents and
may be longer by the last one. Null text is empty. Null doc_ids come first. Rows with equal doc_id stay
in hash order of the text and are parted by it, and equal rows by the task that read them, so no part
need hold them all.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import Scratch, read, released, runs, session, ship, shuffle_width

SEGMENT_SCHEMA = (
    "part int, seq int, plane string, n_ids long, payload binary, "
    "chunks array<struct<n_ids:int,offsets:array<long>,lengths:array<int>>>, "
    "docs array<struct<doc_id:long,n_tokens:long>>"
)
_tokenizers: dict[str, "WordCache"] = {}


class WordCache:
    """Ids of whole texts. The tokenizer cuts at white space and never merges across it, so each
    white-space word is encoded by the library once and its ids are kept: words in one Arrow array,
    ids in one flat array. Beyond ``limit`` bytes only the words of the latest run of texts stay.

    Words of lower-case letters alone are one piece to the tokenizer, whose last id is an end-of-word
    one; many of them are encoded in one call of the same model without its normaliser, which leaves
    them as they are, and parted at those ids. Texts are lower-cased first, which the tokenizer does
    too, wherever the two orders give one result."""

    def __init__(self, definition: str, limit: int = 48 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.ids, self.ends, self.limit = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self.one(m) for m in ".,"}

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        known: dict[str, bytes] = {"": b""}
        letters: dict[str, None] = {}
        marked = []
        for w in words:
            if w.isalpha() and w.islower() and (w.isascii() or is_normalized("NFC", w)):
                letters[w] = None
            elif w and w[-1] in ".," and (core := w[:-1]).isascii() and core.isalpha() and core.islower():
                marked.append(w)  # a letter and a mark are always two pieces
                letters[core] = None
            elif w:
                known[w] = self.one(w)
        plain = list(letters)
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) != len(some) or len(ids) and ends[-1] != 4 * len(ids):
                known.update((w, self.one(w)) for w in some)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                known[w] = raw[at:end]
                at = end
        known.update((w, known[w[:-1]] + self.marks[w[-1]]) for w in marked)
        return list(map(known.__getitem__, words))

    @staticmethod
    def lowered(text: str) -> str:
        if "<|" in text:  # control tokens are told by case
            return text
        low = text.lower()
        if text.isascii() or "Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low):
            return low
        return text

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Where distinct words stand in the kept ones; new words are learned and added."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        out = found.fill_null(-1).to_numpy().astype(np.int64)
        if new.any():
            missing = words.filter(pa.array(new))
            got = self.learn(missing.to_pylist())
            out[new] = len(self.words) + np.arange(len(got))
            self.words = pa.concat_arrays([self.words, missing])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), "<u4")])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)])
        return out

    def shrink(self, used: np.ndarray) -> None:
        """Keep the used words alone."""
        starts, sizes = self.ends[used], self.ends[used + 1] - self.ends[used]
        self.words, self.ids = self.words.take(pa.array(used)), self.ids[spans(starts, sizes)]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        split = pc.ascii_split_whitespace(pa.array([self.lowered(t) for t in texts], pa.string()))
        words = split.values.dictionary_encode()
        used = self.places(words.dictionary)
        at = used[words.indices.to_numpy()]
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ids = self.ids[spans(starts, sizes)]
        cuts = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()].tolist()
        if self.words.nbytes + self.ids.nbytes + self.ends.nbytes > self.limit:
            self.shrink(used)
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each span, one span after the other."""
    before = np.cumsum(sizes) - sizes
    out = np.repeat(starts - before, sizes)
    out += np.arange(len(out))
    return out


def tokenizer_for(definition: str) -> WordCache:
    name = hashlib.sha256(definition.encode()).hexdigest()
    if name not in _tokenizers:
        _tokenizers[name] = WordCache(definition)
    return _tokenizers[name]


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """Planes of one block: byte k of every id, or bit k of every id packed eight to a byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def pack(ids: np.ndarray, block_ids: int, plane: str, level: int) -> tuple[bytes, list[dict]]:
    """Payload and chunk index of one segment."""
    z, out, at, chunks = zstandard.ZstdCompressor(level=level), [], 0, []
    for i in range(0, len(ids), block_ids):
        block = ids[i : i + block_ids]
        packed = [z.compress(p) for p in to_planes(block, plane)]
        offsets = [at + sum(map(len, packed[:k])) for k in range(len(packed))]
        chunks.append({"n_ids": len(block), "offsets": offsets, "lengths": [len(p) for p in packed]})
        at += sum(map(len, packed))
        out += packed
    return b"".join(out), chunks


def unpack(payload: bytes, chunks: list[dict], plane: str) -> np.ndarray:
    z, out = zstandard.ZstdDecompressor(), [np.zeros(0, "<u4")]
    for c in chunks:
        planes = [z.decompress(payload[o : o + n]) for o, n in zip(c["offsets"], c["lengths"], strict=True)]
        out.append(from_planes(planes, c["n_ids"], plane))
    return np.concatenate(out)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, plane: str = "byte", block_ids: int = 65536, segment_ids: int = 1 << 20, level: int = 3) -> DataFrame:
    """The token table's segments, in ascending doc_id order over (part, seq). ``tokenizer`` is the path of
    a tokenizer file that the driver reads; its content is what workers get."""
    ship(session(docs))
    shared = session(docs).sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("plane", pa.string()), ("n_ids", pa.int64()), ("payload", pa.binary()),
        ("chunks", pa.list_(pa.struct([("n_ids", pa.int32()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]))),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))),
    ])
    end = struct.pack("<I", end_id)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), tokenizer_for(shared.value)
        seq, held, n, owners = 0, [], 0, []

        def segment() -> pa.RecordBatch:
            payload, chunks = pack(np.frombuffer(b"".join(held), "<u4"), block_ids, plane, level)
            row = {"part": part, "seq": seq, "plane": plane, "n_ids": n, "payload": payload, "chunks": chunks, "docs": owners}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for some in runs(batch, 1, 1 << 23):
                for doc_id, raw in zip(some.column(0).to_pylist(), cache.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    held += [raw, end]
                    owners.append({"doc_id": doc_id, "n_tokens": len(raw) // 4 + 1})
                    n += len(raw) // 4 + 1
                    if n >= segment_ids:
                        yield segment()
                        seq, held, n, owners = seq + 1, [], 0, []
        if owners:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_h"), F.spark_partition_id().alias("_p"))
    ordered = rows.repartitionByRange(shuffle_width(session(docs)), "doc_id", "_h", "_p").sortWithinPartitions("doc_id", "_h", "_p").select("doc_id", "text")
    return ordered.mapInArrow(released(encode), SEGMENT_SCHEMA)


def read_tokens(segments: DataFrame) -> DataFrame:
    """Rows (part, seq, doc_id, at, n_tokens, ids_crc32) decoded from the segments; ``at`` counts
    the ids before the document in its segment."""
    ship(session(segments))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["payload"], row["chunks"], row["plane"]).tobytes()
                ends = np.cumsum([0] + [d["n_tokens"] for d in row["docs"]])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(row["docs"]), pa.int32()),
                    "seq": pa.array([row["seq"]] * len(row["docs"]), pa.int32()),
                    "doc_id": pa.array([d["doc_id"] for d in row["docs"]], pa.int64()),
                    "at": pa.array(ends[:-1], pa.int64()),
                    "n_tokens": pa.array([d["n_tokens"] for d in row["docs"]], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                })

    wanted = segments.select("part", "seq", "plane", "payload", "chunks", "docs")
    return wanted.mapInArrow(released(decode), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each segment. One narrow row per segment is numbered; parts
    are summed first, so the only ordered pass over everything has one row per part."""
    from pyspark.sql import Window as W

    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    local = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_local"))
    return local.join(offsets, "part").select("part", "seq", (F.col("_base") + F.col("_local")).alias("base"))


def token_table(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files to the shared folder, read them back, one row per document."""
    segments = Scratch(session(docs), "tokens").put(write_tokens(docs, tokenizer, **options), "segments", "none")
    out = read_tokens(segments).join(segment_starts(segments), ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"), default_tokenizer())
