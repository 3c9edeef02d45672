import hashlib

from pyspark.sql import functions as F

from slotwise.llm import chat
from tests.llm.conftest import clash

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(df):
    out = {}
    for r in chat.format_conversations(df).select(
            "conv_id", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("turns"),
            chat.read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect():
        out[r.conv_id] = ([tuple(t) for t in r.turns], r.loss, r.formatted)
    return out


def test_nulls_ties_repeats_and_control_strings(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (1, 3, "assistant", "b"), (1, None, "system", "first"),
            (2, 0, None, None), (2, 1, "assistant", None), (None, 5, "user", "no id"), (None, 6, "assistant", ""),
            (3, 0, "user<turn>\\", "</turn><turn>x<text>\\<next>\\\\"), (3, 1, "assistant", "<\\<<\\\\</turn>\\"), (3, 1, "assistant", "</turn>"),
            (4, 0, "assistant", "é🙂\n" * 5000)]
    got = read_back(clash(spark.createDataFrame(rows, SCHEMA)))
    assert got[1][0] == [("system", "first"), ("user", "hi"), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert got[1][1] == "abb" and got[1][2].count(chat.TURN) == 3
    assert got[2] == ([("", ""), ("assistant", "")], "", "<turn><text></turn><turn>assistant<text></turn>")
    assert got[None][0] == [("user", "no id"), ("assistant", "")]
    assert got[3][0] == [("user<turn>\\", "</turn><turn>x<text>\\<next>\\\\"), ("assistant", "</turn>"), ("assistant", "<\\<<\\\\</turn>\\")]
    assert got[3][1] == "</turn><\\<<\\\\</turn>\\"
    assert got[4][1] == "é🙂\n" * 5000


def test_digests_and_empty_table(spark):
    row = chat.digests(chat.format_conversations(chat.escape_sample(spark))).first()
    text = "\\### Assistant: </turn> ok"
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(text))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.format_conversations(chat.escape_sample(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_conversation_is_linear(spark):
    rows = spark.range(20_000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"))
    got = chat.digests(chat.format_conversations(rows)).first()
    assert (got.n_turns, got.loss_chars) == (20_000, 90_000)
