"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic
programming carries the best score and the number of pieces, never the pieces themselves. It gives
the counts of a unigram tokenizer with byte fallback: white space is marked, each word starts with
the mark, a character that is no piece of its own costs the least score less 10 and falls back to
its UTF-8 bytes, and among equally good paths to a character the one whose last piece starts first
wins, since later starts must be strictly better.

The pieces and scores are those of a sentencepiece model file, whose path is a parameter; scores are
whole numbers, so sums are exact in any order. Words are counted once and kept in two generations of
at most ``limit`` words. A line break ends a word's lattice if no piece has one; ASCII spaces alone mark
words, and the model file's own normaliser is not applied.

Null and empty texts have no pieces. Every row is counted by its text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import read, released, session, ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONG = 64
"""Words of more characters are counted anew each time, so that what is kept is bounded in bytes."""
_counters: dict[str, "Counter"] = {}


def load_pieces(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class Counter:
    """Piece counts of texts under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, s in dict(pieces).items():
            self.automaton.add_word(piece, (len(piece), s))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cut_lines = not any("\n" in p for p, _ in pieces)
        self.new: dict[str, tuple[int, float, int]] = {}
        self.old: dict[str, tuple[int, float, int]] = {}
        self.limit = limit

    def viterbi(self, word: str) -> tuple[int, float, int]:
        """(pieces, score, bytes of unknown characters) of the best path through one word. Only the paths to
        the last characters that a piece can span are kept."""
        ring = self.longest + 1
        best: list = [(0, 0.0, 0)] * ring
        found, matches, end = [], self.automaton.iter(word), 0
        following = next(matches, None)
        for end in range(1, len(word) + 1):
            found.clear()
            while following and following[0] == end - 1:
                found.append(following[1])
                following = next(matches, None)
            found.sort(reverse=True)
            top, score, single = None, 0.0, False
            for length, s in found:  # the longest starts first and wins ties
                single = single or length == 1
                before = best[(end - length) % ring]
                if top is None or before[1] + s > score:
                    top, score = before, before[1] + s
            before = best[(end - 1) % ring]
            if not single and (top is None or before[1] + self.unknown > score):
                raw = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best[end % ring] = (before[0] + raw, before[1] + self.unknown, before[2] + raw)
            else:
                best[end % ring] = (top[0] + 1, score, top[2])
        return best[len(word) % ring]

    def words(self, text: str) -> list[str]:
        """Lattices of a text: marked words, cut at line breaks."""
        text = text.replace(" ", MARK)
        text = text if text.startswith(MARK) else MARK + text
        parts = text.split(MARK)[1:]
        return [MARK + p for p in parts]

    def learn(self, word: str) -> tuple[int, float, int]:
        if (found := self.old.get(word)) is None:
            if self.cut_lines and "\n" in word:
                pieces = [self.viterbi(p) for p in word.split("\n")]
                lines = word.count("\n")
                found = (sum(p[0] for p in pieces) + lines, sum(p[1] for p in pieces) + lines * self.unknown, sum(p[2] for p in pieces) + lines)
            else:
                found = self.viterbi(word)
        if len(word) <= LONG:
            if len(self.new) > self.limit:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, float, int]:
        """(n_tokens, score, n_bytes) of a whole text."""
        if not text:
            return 0, 0.0, 0
        words = self.words(text)
        try:
            got = list(map(self.new.__getitem__, words))
        except KeyError:
            new = self.new.get
            got = [new(w) or self.learn(w) for w in words]
        n, score, raw = zip(*got, strict=True)
        return sum(n), sum(score), sum(raw)


def counter_for(name: str, pieces) -> Counter:
    """The worker's counter of a vocabulary, built when it is first asked for."""
    if name not in _counters:
        _counters[name] = Counter(pieces())
    return _counters[name]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, score) per row of ``docs``; no shuffle. The driver reads the pieces from
    the path ``model``; workers get the pieces."""
    ship(session(docs))
    pieces = load_pieces(model)
    name, shared = hashlib.sha256(repr(pieces).encode()).hexdigest(), session(docs).sparkContext.broadcast(pieces)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(name, lambda: shared.value)
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "n_tokens", "n_bytes", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(run), "doc_id long, n_tokens long, n_bytes long, score double")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), default_model())
