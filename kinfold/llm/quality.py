"""Quality rules: base counts, and perplexity bands by a modified Kneser-Ney model of the corpus.

The models (``wordmodel``) count all pairs of neighbouring words, and of the words' shapes, in all texts and
score every text by the counts of the half it is not in. The mean log probability of a text's words is
its log perplexity. A language's bands reach from its median some robust deviations (quartile range /
1.349, with a floor) down and up: texts beyond the upper perplexity bounds have words, or are built, as
hardly any other text of their language; those below the lower ones repeat what many others say. Medians
and quartiles are exact, of log probabilities in whole thousandths, so bands do not depend on partitions;
every language, whatever its script, has its own.

Null text has no words and fails the base rules; null language is a language of its own. Repeated rows
count as often as they occur and agree. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import Scratch, read, session
from kinfold.llm.wordmodel import word_scores

SYMBOLS = "#*$%&|<>"
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dups = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dups += bool(line.encode("utf-8", "surrogatepass").split())
            seen.add(line)
    repeat = 0
    if n > 3:
        threes = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(threes)) < len(threes):
            often, until = Counter(threes), 0
            for i, t in enumerate(threes):
                if often[t] > 1:
                    repeat += i + 3 - max(i, until)
                    until = i + 3
    return n, len(text) - spaces, symbols, dups, repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def quartiles(scored: DataFrame, column: str) -> DataFrame:
    """(lang, q) with the quartiles of a log probability among the texts with words, between neighbours in
    proportion. Texts are counted by whole thousandths first, so a language is a few thousand numbers."""
    bins = scored.where("n_scored > 0").groupBy("lang", F.floor(F.col(column) * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy("lang").agg(F.expr("transform(percentile(bin, array(0.25, 0.5, 0.75), n), x -> x / 1000)").alias("q"))


BANDS = {"word_logp": (5.0, 12.0, 0.05), "shape_logp": (9.0, 9.0, 0.05)}
"""Robust deviations below and above a language's median log probability that a text may be, and the least deviation."""


def judge(scored: DataFrame, bands: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """Add perplexity, base_failed and kept. The bands are one row for each language."""
    out, inside = scored, F.lit(True)
    for column, (low, high, floor) in bands.items():
        dev = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(floor))
        limits = quartiles(scored, column).select(F.col("lang").alias("_lang"), (F.col("q")[1] - F.lit(low) * dev).alias("_low"), (F.col("q")[1] + F.lit(high) * dev).alias("_high"))
        out = out.join(F.broadcast(limits), out["lang"].eqNullSafe(F.col("_lang")), "left")
        out = out.withColumn(f"_{column}", F.col(column).between(F.col("_low"), F.col("_high"))).drop("_lang", "_low", "_high")
        inside = inside & F.coalesce(F.col(f"_{column}"), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    perplexity = [F.exp(-F.col(c)).alias(n) for c, n in (("word_logp", "perplexity"), ("shape_logp", "shape_perplexity"))]
    return out.select(*scored.columns, *perplexity, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def rate(docs: DataFrame, bands: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """Counts, perplexity and verdict of every row of ``docs``."""
    scratch = Scratch(session(docs), "quality")
    return judge(scratch.put(word_scores(docs, base_counts, FACTS, scratch), "scored"), bands)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *FACTS, "base_failed", "kept", *[F.round(c, 4).alias(c) for c in ("perplexity", "shape_perplexity")])
