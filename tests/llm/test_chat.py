import random
from collections import defaultdict

from pyspark.sql import functions as F

from callsheet.llm import chat

PARTS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|", "|>", "<", "[", "]", "\\", "\\\\", "</s>", "<s>", "[INST]",
         "[/INST]", "<<SYS>>", "<</SYS>>", "I", "s>", "SYS", "a b", "\n", "é", "<\\|", "[\\INST]", "$1", ""]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(7))) for _ in range(n)]


def test_escape_can_be_undone_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in texts(3000)], "t string")
    escaped = chat.escape(F.col("t"))
    for r in df.select("t", escaped.alias("e"), chat.unescape(escaped).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    made = chat.examples(df.selectExpr("*", "1 AS id", "2 AS target"))
    loss = chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))
    got = made.select("*", loss.alias("loss"), chat.turns_of(F.col("text")).alias("turns")).collect()
    found = defaultdict(list)
    for r in got:
        found[r["id"]].append(r)
    assert found.keys() == by_conv.keys()
    for conv, turns in by_conv.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        examples = sorted(found[conv], key=lambda r: r["target"])
        targets = [i for i, (role, _) in enumerate(turns, 1) if role == "assistant"]
        last = [] if targets[-1:] == [len(turns)] else [len(turns)]
        assert [e["target"] for e in examples] == targets + last
        assert [e["is_last"] for e in examples] == [e["target"] == len(turns) for e in examples]
        for e in examples:
            # The context is all the turns before, and only the reply is trainable.
            assert [tuple(t) for t in e["turns"]] == turns[: e["target"]]
            role, text = turns[e["target"] - 1]
            assert e["loss"] == (text if role == "assistant" else "")
            assert e["loss_end"] <= len(e["text"])


def test_examples(spark):
    rng = random.Random(2)
    rows, pool = [], texts(400, 3)
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<|im_sep|>"]), rng.choice(pool)))
    check(spark, rows)


def test_nulls_ties_equal_rows_and_long_texts(spark):
    check(spark, [
        (None, 0, "user", "a"), (None, 1, "assistant", None), (1, None, "user", "first"), (1, 0, "assistant", "x"),
        (1, 0, "assistant", "x"), (1, 0, "assistant", "w"), (1, 1, None, None), (2, 5, "assistant", "l" * 300_000),
        (3, 0, "assistant", ""), (4, 0, "user", ""),
    ])


def test_empty_table(spark):
    check(spark, [])


def test_a_conversation_of_many_turns(spark):
    check(spark, [(1, n, ["user", "assistant"][n % 2], f"turn {n} <|im_end|>") for n in range(400)])
