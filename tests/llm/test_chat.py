import random

from compare_llm import duck
from leafmill.llm import chat, queries

SCHEMA = "conv_id bigint, seq bigint, kind string, msg bigint, role string, text string, rendered string"


def fold(events):
    """The events of one conversation one at a time."""
    held = {}
    for seq, kind, msg, role, text in events:
        m = held.setdefault(msg, {"role": None, "parts": None})
        m["role"] = role if role is not None else m["role"]
        if kind == "delta":
            m["parts"] = (m["parts"] if isinstance(m["parts"], list) else []) + [text or ""] if m["parts"] != "gone" else "gone"
        elif kind == "delete":
            m["parts"] = "gone"
        else:
            m["parts"] = [] if kind in ("start", "regenerate") else [text or ""]
        if kind in ("edit", "regenerate"):
            held = {k: v for k, v in held.items() if k <= msg}
    return {k: (m["role"] or "unknown", "".join(m["parts"])) for k, m in held.items() if m["parts"] != "gone"}


def test_against_a_sequential_fold(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for c in range(150):
        events, made = [], 0
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["message", "start", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            msg = rng.randint(0, 4)
            events.append((seq, kind, msg, rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "\n", "", None, "é"])))
            made += 1
        want |= {(c, m): x for m, x in fold(events).items()}
        rows += [(c, *e, "x") for e in events]
    rows += rows[::7]  # repeated rows
    rng.shuffle(rows)
    rows += [(None, 1, "message", 0, "user", "no conversation", "x"), (7, None, "message", 0, "user", "no number", "x"), (7, 1000, "odd", 0, "user", "no kind", "x"), (7, 1001, "message", None, "user", "no message", "x")]
    got = {(r.conv_id, r.msg): (r.role, r.content) for r in chat.final_messages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_ties_have_one_result(spark):
    rows = [(1, 5, "message", 0, "user", "a", ""), (1, 5, "message", 0, "user", "b", ""), (1, 5, "delta", 0, None, "d", ""), (1, 5, "delta", 0, None, "c", "")]
    for order in (rows, rows[::-1]):
        (r,) = chat.final_messages(spark.createDataFrame(order, SCHEMA)).collect()
        assert (r.role, r.content) == ("user", "bcd")


def test_rendering(spark):
    rows = [(1, 0, "message", 0, "user", "hi", ""), (1, 1, "start", 1, "assistant", None, ""), (1, 2, "delta", 1, None, "he", ""), (1, 3, "delta", 1, None, "llo", ""), (2, 0, "delete", 0, "user", "x", "")]
    got = chat.rendered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.n_messages, r.rendered) for r in got] == [(1, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n")]


def test_turns_against_sql(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b\nc"), (1, 3, "assistant", "x\ny\n"), (1, 4, "assistant", "z\n\nz"), (1, 4, "assistant", "z\n\nz"), (1, 5, "user", None), (2, 0, None, "t"), (3, 0, "assistant", ""), (None, 1, "user", "u"), (4, None, "user", "u"), (5, 1, "user", "w" * 100000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.conv_id, r.n_messages, r.rendered) for r in chat.rendered(chat.turn_events(df)).collect())
    assert got == sorted(duck(queries.OP8_SQL, tmp_path, ("conv_id", "n_messages", "rendered")))
    assert len(got) == 4


def test_empty_table(spark):
    assert chat.rendered(spark.createDataFrame([], SCHEMA)).collect() == []
    assert chat.rendered(chat.turn_events(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).collect() == []


def test_turns_of_any_size_and_clashing_columns(spark, tmp_path):
    big = [0, 2**31, 2**33, 1_764_000_000_000, 2**63 - 1, -(2**63)]
    rows = [(9, t, "assistant" if i % 2 else "user", f"{i}\nx", "y", "z") for i, t in enumerate(big)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq string, msg string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in chat.rendered(chat.turn_events(df)).collect()]
    assert got == duck(queries.OP8_SQL, tmp_path, ("conv_id", "n_messages", "rendered"))


def test_a_long_stream_keeps_its_order(spark):
    text = "".join(f"line {i}\n" for i in range(50_000))
    (r,) = chat.rendered(chat.turn_events(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert r.rendered == f"<|assistant|>\n{text}<|end|>\n"
