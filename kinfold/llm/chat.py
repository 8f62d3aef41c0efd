"""Event-sourced chat reconstruction and rendering.

An event log has (conv_id, seq, kind, turn, role, text). Events of a conversation are folded in
``seq`` order into messages:

* ``message``  a whole message of ``role`` at ``turn`` (a second one at the same turn is a further message),
* ``delta``    text appended to the latest message of that turn; opens one if there is none,
* ``edit``     the latest message of that turn gets this text,
* ``regenerate`` the latest message of that turn is emptied and later messages of the
  conversation are dropped, to be streamed again.

Messages are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``<``,
any number of backslashes and ``|`` gets one backslash more, so no control string can appear in
them and ``unescape`` is exact; line breaks and backslashes of roles are escaped too.

Conversations are hashed to partitions, sorted and streamed, so memory holds one conversation's
messages, not a partition. Null text and null role are empty; null conv_id is one conversation;
null seq comes first; ties in seq keep kind, turn, role and text order. An empty log gives no rows. A
conversation is folded by one task, which holds its messages. In the query, rows of the table with
conv_id -1 are one conversation with the control rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import Scratch, read, released, session, ship

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: Iterable[tuple[str, int | None, str | None, str | None]]) -> list[tuple[str, str]]:
    """(role, text) of the final messages of one conversation's events in order."""
    messages: list[list] = []  # turn, role, pieces
    latest: dict[int | None, int] = {}
    for kind, turn, role, text in events:
        at = latest.get(turn)
        if kind == "message" or at is None and kind in ("delta", "edit"):
            latest[turn] = len(messages)
            messages.append([turn, role or "", [text or ""]])
        elif kind == "delta":
            messages[at][2].append(text or "")
        elif kind == "edit":
            messages[at][2] = [text or ""]
        elif kind == "regenerate" and at is not None:
            messages[at][2] = []
            for m in messages[at + 1 :]:
                if latest.get(m[0], -1) > at:
                    del latest[m[0]]
            del messages[at + 1 :]
    return [(role, "".join(pieces)) for _, role, pieces in messages]


def render(messages: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the code-point spans that count for the loss: the texts of ``learn``."""
    out, at, spans = [], 0, []
    for role, text in messages:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that ``render`` was given."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def format_log(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, formatted, loss array<struct<start,end>>), one per conversation."""
    ship(session(events))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        current, open_ = None, False

        def done() -> dict:
            text, spans = render(fold(held), learn)
            return {"conv_id": current, "formatted": text, "loss": [{"start": a, "end": b} for a, b in spans]}

        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for batch in batches:
            out = []
            for conv, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and conv != current:
                    out.append(done())
                    held = []
                current, open_ = conv, True
                held.append((kind, turn, role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if open_:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    rows = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "kind", F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "turn", "role", "text")
    return ordered.drop("seq").mapInArrow(released(stream), "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what the written text holds, by parsing it and its loss mask."""
    ship(session(formatted))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(released(digest), schema)


def conversation_log(conversations: DataFrame, piece: int = 64) -> DataFrame:
    """The event log that a chat service would have kept of the table's rows, in turn order (then role and
    text). By a hash of its conversation and place, a message is logged whole; as an opening and the
    deltas of its text, ``piece`` characters each; as a draft that is regenerated and streamed again; or as
    deltas of a draft that an edit replaces. Nulls in role and text are empty."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    streamed = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    draft = F.concat(F.lit("(draft) "), F.reverse(F.substring("text", 1, piece)))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    deltas = F.transform(streamed, lambda t: event("delta", t))
    empty = F.lit("")
    ways = [
        F.array(event("message", F.col("text"))),
        F.concat(F.array(event("message", empty)), deltas),
        F.concat(F.array(event("message", draft), event("delta", F.lit(" ...")), event("regenerate", empty)), deltas),
        F.array(event("delta", draft), event("delta", F.lit(" ...")), event("edit", F.col("text"))),
    ]
    way = F.pmod(F.xxhash64("conv_id", "n"), F.lit(len(ways)))
    chosen = ways[0]
    for k in range(1, len(ways)):
        chosen = F.when(way == k, ways[k]).otherwise(chosen)
    events = rows.select("conv_id", "n", "role", F.posexplode(chosen).alias("step", "e"))
    return events.select("conv_id", F.struct("n", "step").alias("seq"), F.col("e.kind").alias("kind"), F.col("n").alias("turn"), "role", F.col("e.text").alias("text"))


def op10_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    formatted = format_log(conversation_log(rows.unionByName(own)))
    return read_back(Scratch(spark, "chat").put(formatted, "formatted"))
