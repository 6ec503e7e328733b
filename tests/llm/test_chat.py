from briarlake.llm.chat import format_chats
from briarlake.scratch import Scratch
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, rendered string"


def conversation(number, *texts):
    return [(number, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(texts)]


def formatted(spark, rows):
    return {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()}


def test_snapshots_collapse(spark):
    rows = conversation(1, "a") + conversation(2, "a", "b") + conversation(3, "a", "b", "c") + conversation(4, "a", "x") + conversation(5, "a", "b", "c") + conversation(6, "ab")
    got = formatted(spark, rows)
    assert sorted(got) == [3, 4, 6] and got[3].n_same == 2 and got[3].n_turns == 3
    assert got[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"


def test_odd_rows(spark):
    rows = conversation(1, "a", "b") * 2 + [(None, 0, "user", "z", "x"), (2, 0, "user", None, "x"), (3, 0, "user", "", "x"), (4, None, None, "q", "x"), (4, 0, "user", "r", "x"), (5, 0, "user", "r", "x"), (5, 0, "tool", "s", "x")]
    got = formatted(spark, rows)
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1].n_turns == 2
    assert got[2].rendered == got[3].rendered == "<|im_start|>user\n<|im_end|>\n"
    assert got[4].rendered.startswith("<|im_start|>\nq<|im_end|>") and got[5].rendered.startswith("<|im_start|>tool\ns")
    assert formatted(spark, rows[:0]) == {}


def test_parts_are_not_confused(spark):
    rows = [(1, 0, "us", "era", "x"), (2, 0, "user", "a", "x"), (2, 1, "user", "b", "x"), (3, 0, "user", "a1:b", "x")]
    assert sorted(formatted(spark, rows)) == [1, 2, 3]


def test_long_conversation(spark):
    rows = conversation(1, *[f"t{k}" for k in range(3000)]) + conversation(2, *[f"t{k}" for k in range(2999)])
    got = formatted(spark, rows)
    assert sorted(got) == [1] and got[1].n_turns == 3000 and got[1].rendered.count("<|im_start|>") == 3000


def test_logged_snapshots_collapse(spark):
    from briarlake.llm.queries import op8_chat_formatting, op8_chat_snapshots

    whole = {r.rendered: r.n_same for r in op8_chat_formatting(spark, brute.SMALL).collect()}
    rows = op8_chat_snapshots(spark, brute.SMALL).collect()
    logged = spark.read.parquet(f"{brute.SMALL}/conversations.parquet").groupBy("conv_id").count().count() * 6
    assert {r.rendered for r in rows} == set(whole) and len(rows) == len(whole) < logged
    assert all(r.n_same % whole[r.rendered] == 0 for r in rows) and any(r.n_same > whole[r.rendered] for r in rows)
