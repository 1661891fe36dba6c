import hashlib
import random

import pytest

from windrow.llm import chat

PIECES = ["<turn>", "</turn>", "### Assistant: ", "\\", "\\\\", "\n", "<", "#", ":", "a", "é", "ok ", "</turn>\n", "User"]


@pytest.mark.parametrize("seed", range(5))
def test_round_trip(seed):
    rng = random.Random(seed)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "sys:tem", "", "a\\<"]), "".join(rng.choice(PIECES) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(5))]
        r = chat.render(chat.turn_template, turns)
        assert chat.parse_turns(r.text) == turns and not r.rewrites
        assert [chat.unescape(r.text[a:b]) for a, b in r.masks] == [t for role, t in turns if role == "assistant"]
        assert "".join(r.text[a:b] for a, b in r.spans) == r.text


def test_other_text_is_no_conversation():
    with pytest.raises(ValueError):
        chat.parse_turns("<turn>### user: a</turn>\nmore")


def test_a_template_that_rewrites_history_is_found():
    def last_only(turns):  # earlier answers are cut once another turn follows
        return "".join(f"[{role}|{text if k == len(turns) - 1 or role != 'assistant' else text[:2]}]" for k, (role, text) in enumerate(turns))

    turns = [("user", "hello"), ("assistant", "answer"), ("user", "more"), ("assistant", "final")]
    r = chat.render(last_only, turns)
    assert r.rewrites == [2] and r.text == "[user|hello][assistant|an][user|more][assistant|final]"
    assert r.text[slice(*r.masks[1])] == "final"


def test_a_header_that_counts_turns_rewrites():
    r = chat.render(lambda turns: f"({len(turns)})" + "".join(t for _, t in turns), [("user", "a"), ("assistant", "b")])
    assert r.rewrites == [0, 1] and [r.text[a:b] for a, b in r.masks] == ["b"]


def test_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, "user", None), (2, 5, None, "x"), (None, 0, "user", "p"), (None, 1, "assistant", "q"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "z"), (4, 0, "assistant", "long " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS formatted", "2 AS spans")
    made = chat.format_conversations(df)
    assert made.count() == 6
    back = {(r.conv_id, tuple(zip(r.roles, r.texts))): r.loss_text for r in chat.read_back(made).collect()}
    assert back == {
        (1, (("user", "a"), ("assistant", "b"))): "b", (2, (("user", ""), ("", "x"))): "", (None, (("user", "p"),)): "", (None, (("assistant", "q"),)): "q",
        (3, (("assistant", "z"), ("user", "same"), ("user", "same"))): "z", (4, (("assistant", "long " * 40_000),)): "long " * 40_000,
    }
    digests = {r.conv_id: r for r in chat.read_back(made, digests=True).where("conv_id = 1").collect()}
    assert digests[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and digests[1].formatted_chars == len(chat.turn_template([("user", "a"), ("assistant", "b")]))
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_a_long_conversation_across_batches(spark):
    rows = [(k // 400, k % 400, "assistant" if k % 2 else "user", f"t{k}") for k in range(1200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        made = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.conv_id: r.texts for r in made} == {c: [f"t{k}" for k in range(c * 400, c * 400 + 400)] for c in range(3)}


def test_shared_beginnings():
    import random
    from os.path import commonprefix

    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(2))
        head = a[: rng.randint(0, len(a))]
        for x, y in ((a, b), (a, head + b), (head, a), (a, a)):
            assert chat.shared(x, y) == len(commonprefix([x, y]))


def test_a_long_conversation_takes_seconds():
    import time

    turns = [("user" if i % 2 else "assistant", f"{i} " + "word <x> " * 55) for i in range(1600)]
    start = time.process_time()
    got = chat.render(chat.turn_template, turns)
    assert time.process_time() - start < 12 and len(got.spans) == 1600 and len(got.masks) == 800
