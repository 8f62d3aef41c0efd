"""Language identification by compression with per-language zstandard raw-content dictionaries.

Training takes whole documents of known language in hash order of their text, at most
``docs_per_lang`` documents and ``dict_bytes`` bytes a language (the documented bound of the
labelled sample), and joins them into one raw-content dictionary per language. A text is lower-cased
and reduced to its letter runs, cut into blocks of ``block`` bytes so that long texts lean on the
dictionary rather than on themselves, and every block is compressed with every dictionary. The
smallest sum wins; the score is the winner's saving against the runner-up, from 0 to 1, and a text
whose score is under ``min_margin`` is rejected. Equal sums go to the language with more labelled
rows, then to the first name.

Null texts and texts without a letter are ``und``, score 0 and rejected. With one learned language
every text with a letter is that language, score 1. Without any, every text is ``und``. Every row is
classified by its text alone, so repeated rows agree. The dictionaries are broadcast together: at most
``max_langs`` of ``dict_bytes`` each; more languages are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import read, released, session, ship

NOT_LETTERS = re.compile(r"[\W\d_]+")
NUMERALS = frozenset(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha())
"""Numerals such as a half or a circled one are word characters but no letters; texts are asked for any first."""
_BLANKED = dict.fromkeys(map(ord, NUMERALS), " ")
UND = "und"


def letters(text: str | None) -> str:
    if not text:
        return ""
    low = text.lower()
    if not low.isascii() and not NUMERALS.isdisjoint(low):
        low = low.translate(_BLANKED)
    return NOT_LETTERS.sub(" ", low).strip()


class Model:
    """Dictionaries by language; pickles as bytes and compiles itself once per worker."""

    def __init__(self, dictionaries: dict[str, bytes], rows: dict[str, int] | None = None, level: int = 5, block: int = 4096, min_margin: float = 0.004):
        self.dictionaries, self.level, self.block, self.min_margin = dictionaries, level, block, min_margin
        self.rows = rows or {}
        self.compressors: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"compressors": None}

    def compiled(self) -> list:
        if self.compressors is None:
            import zstandard as z

            self.compressors = []
            for lang in sorted(self.dictionaries, key=lambda k: (-self.rows.get(k, 0), k)):
                d = z.ZstdCompressionDict(self.dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self.compressors.append((lang, z.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False).compress))
        return self.compressors

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        found = self.compiled()
        plain = letters(text).encode()
        if not plain or not found:
            return UND, 0.0, False
        pieces = [plain[i : i + self.block] for i in range(0, len(plain), self.block)]
        sizes = [sum(len(c(p)) for p in pieces) for _, c in found]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return found[0][0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        score = (second - sizes[best]) / second
        return found[best][0], score, score >= self.min_margin


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = 200, dict_bytes: int = 131_072, max_langs: int = 512, **options) -> Model:
    """Fit on rows with a language. Each task keeps at most ``docs_per_lang`` rows a language before
    the shuffle, so a language with most of the rows is no burden on one task."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") < dict_bytes))
    first = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = known.select("lang", "text").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= docs_per_lang)
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for r in rows.orderBy("lang", "_r").toLocalIterator():
        plain = letters(r.text).encode()
        if plain and size.get(r.lang, 0) + len(plain) < dict_bytes and plain not in held.get(r.lang, ()):
            held.setdefault(r.lang, []).append(plain)
            if len(held) > max_langs:
                raise ValueError(f"more than {max_langs} languages; raise max_langs")
            size[r.lang] = size.get(r.lang, 0) + len(plain) + 1
    counts = {r.lang: r["count"] for r in docs.where(F.col("lang").isin(*held)).groupBy("lang").count().collect()} if held else {}
    return Model({k: b" ".join(v) for k, v in held.items()}, counts, **options)


def trained_on(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: known language, and not of the held-out fold."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) per row of ``docs``."""
    ship(session(docs))
    shared = session(docs).sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.classify(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(released(run), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(session(docs))
    shared, at, schema = session(docs).sparkContext.broadcast(model), docs.columns.index("text"), to_arrow_schema(docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([shared.value.classify(t.as_py())[2] for t in batch.column(at)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns, schema=schema).filter(keep)

    return docs.mapInArrow(released(run), docs.schema)


def op1_zstd_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(trained_on(docs)))
