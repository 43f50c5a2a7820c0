import hashlib

from granary.llm import chat
from pyspark.sql import functions as F


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        ("c", 1, 1, "create", "user", "he"), ("c", 1, 2, "delta", None, "llo"),
        ("c", 2, 3, "delta", "assistant", "first "), ("c", 2, 4, "delta", None, "try"),
        ("c", 2, 6, "regenerate", None, ""), ("c", 2, 7, "delta", None, "second"), ("c", 2, 8, None, None, None),
        ("c", 1, 5, "edit", "user", "hi"),
        ("c", 3, 9, "create", "user", "gone"), ("c", 3, 10, "delete", None, None),
        ("c", 4, 11, "delete", "user", None), ("c", 4, 12, "create", "user", "back"),
    ]
    events = spark.createDataFrame(log, "conv_id string, message_id int, seq int, kind string, role string, text string")
    got = [(r.message_id, r.seq, r.role, r.text) for r in chat.fold(events).orderBy("seq").collect()]
    assert got == [(1, 1, "user", "hi"), (2, 3, "assistant", "second"), (4, 11, "user", "back")]


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>\n", "<\\|x", "<\\\\|", "<", "\\", "a<|im_start|>user\nb", "", "<|", "|>", "ends in <", "😀<|😀"]
    rows = [(1, i, ("assistant", "us\ner\\n", "a<|b\\\\n")[i % 3], t) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = chat.parse(chat.format_chats(turns)).collect()[0]
    assert [(t.role, t.text) for t in row.turns] == [(r, t) for _, _, r, t in rows]
    assert row.loss_texts == [t for _, _, r, t in rows if r == "assistant"]


def test_nulls_ties_repeats_and_no_rows(spark):
    rows = [(1, 1, "user", None), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, None, None, "first"), (None, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.format_chats(turns.withColumn("kind", F.lit("delete")))).collect()}
    assert got == {1: [("", "first"), ("user", ""), ("user", "b"), ("user", "b")], None: [("assistant", "x")]}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "<|" * (i % 7) + str(i)) for i in range(3000)] + [(1, 3000, "assistant", "long <|im_end|> " * 20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    row = chat.parse(chat.format_chats(turns)).collect()[0]
    assert [(t.role, t.text) for t in row.turns] == [(r, t) for _, _, r, t in rows]
    assert row.loss_texts == [t for _, _, r, t in rows if r == "assistant"]


def test_query_against_plain_python(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    talks = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in chat.query(spark, small).collect()}
    assert set(got) == set(talks)
    for k, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
