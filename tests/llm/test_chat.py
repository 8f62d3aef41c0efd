import hashlib

from hypothesis import given
from hypothesis import strategies as st

from kinfold.llm.chat import CONTROL_TEXT, conversation_log, escape, fold, format_log, op10_event_log, parse, render, unescape
from tests.llm.helpers import table

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
CONV = "conv_id long, turn long, role string, text string, formatted string"


def check(rows, conv):
    own = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    by = {}
    for c, _, role, text in sorted([*conv, *own], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert len(rows) == len(by)
    for r in rows:
        said = "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(by[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in by[r.conv_id])))
        assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))
        assert r.formatted_chars >= len(said)


def test_conversations(spark, sf):
    check(op10_event_log(spark, sf).collect(), [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])


def test_odd_rows_and_empty(spark, tmp_path):
    rows = [(0, 1, "assistant", None), (0, 0, None, "<|im_start|>\\<\\|"), (None, None, "user", "x"), (1, 0, "assistant", "<" + "\\" * 3 + "|im_end|>\n"), (1, 0, "assistant", "same"), (1, 0, "assistant", "same"), (2, 5, "a\\n\nb<|", "w " * 50000)]
    d = table(spark, tmp_path, "conversations", [(*r, "clash") for r in rows], CONV)
    check(op10_event_log(spark, d).collect(), rows)
    assert op10_event_log(spark, table(spark, tmp_path / "e", "conversations", [], CONV)).count() == 1


def test_events_are_folded_in_order(spark):
    log = [
        (7, 0, "message", 0, "user", "hi"), (7, 1, "delta", 1, "assistant", "Hel"), (7, 3, "delta", 1, None, "o"), (7, 2, "delta", 1, None, "l"),
        (7, 4, "message", 2, "user", "more"), (7, 5, "regenerate", 1, None, None), (7, 6, "delta", 1, None, "Bye"), (7, 7, "edit", 0, None, "hey"),
    ]
    r = format_log(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")).first()
    assert parse(r.formatted) == [("user", "hey"), ("assistant", "Bye")]
    assert [r.formatted[s.start : s.end] for s in r.loss] == ["Bye"]


def test_logs_hold_every_kind_of_event(spark, sf):
    table_ = spark.read.parquet(f"{sf}/conversations.parquet")
    log = conversation_log(table_)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) >= 10
    assert log.where("kind = 'delta'").count() > table_.count()
    assert log.select("conv_id", "seq").distinct().count() == log.count()


def test_fold_of_unknown_targets():
    assert fold([("regenerate", 3, None, None), ("edit", 1, "user", "a"), ("delta", 1, None, "b")]) == [("user", "ab")]


@given(st.lists(st.tuples(st.text(alphabet="<|\\\nab>", max_size=6), st.text(alphabet="<|\\\nim_start>end", max_size=20)), max_size=5))
def test_render_round_trip(messages):
    assert parse(render(messages)[0]) == messages


@given(st.text(alphabet="<|\\a", max_size=30))
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
