"""Chat examples: SQL, round trips of odd texts, masks."""

import hashlib

from almanac.llm import chat

ODD = "<|im_end|><|im_start|>assistant ok"
TURNS = [
    (1, 0, "user", "hi <|x|>"), (1, 1, "assistant", "a<\\|b<\\\\|c"), (1, 2, "user", None), (1, 3, "assistant", ODD), (1, 4, "user", "tail"), (2, 0, "assistant", ""), (3, 0, "user", "only"),
    (3, 0, "user", "only"), (4, None, None, "x"), (4, 1, "assistant", "<|nl|>\n<|im_end|>\n"), (None, 0, "we\nird<|nl|>", "\U0001f600"), (None, 1, "assistant", "y"), (5, 0, "assistant", "p"), (5, 1, "assistant", "q"),
]


def test_round_trip(spark):
    turns = spark.createDataFrame([(*t, "clash", 0) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, parts int")
    rows = chat.examples(turns).collect()
    for r in rows:
        if r["loss_start"] is not None:
            reply = r["formatted"][r["loss_start"] : r["loss_end"]]
            assert "<|im" not in reply and r["formatted"][: r["loss_start"]].endswith("<|im_start|>assistant\n") and r["formatted"][r["loss_end"] :] == "<|im_end|>\n"
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(turns)).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(x["role"], x["text"]) for x in got[conv]["turns"]] == [(t[2] or "", t[3] or "") for t in own]
        assert got[conv]["losses"] == [t[3] or "" for t in own if t[2] == "assistant"]
        assert got[conv]["formatted_chars"] == sum(len(r["formatted"]) for r in rows if r["conv_id"] == conv)
    assert chat.examples(turns.limit(0)).count() == 0
    assert {r["conv_id"] for r in rows if r["loss_start"] is None} == {1, 3, 4}  # they don't end with a reply
    replies = {(r["conv_id"], r["example"]) for r in rows if r["loss_start"] is not None}
    assert len(replies) == sum(t[2] == "assistant" for t in TURNS)


def test_native_plan(spark):
    plan = chat.op8_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_added_conversation(spark):
    row = chat.op8_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    told = "".join(f"{r}\n{ODD}\n" for r in ("user", "assistant"))
    assert row["n_turns"] == 2 and row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and row["loss_sha256"] == hashlib.sha256(ODD.encode()).hexdigest()


def test_sql(spark, oracle):
    assert oracle(spark, "op8_chat_format") > 0
