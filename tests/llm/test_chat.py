import hashlib
import random

import pytest
from pyspark.errors import PythonException
from tarn.llm.chat import ChatTemplate, format_turns, op2_chat, read_back

SCHEMA = "conv_id long, turn long, role string, text string, state string"
BITS = ["#", "##", "###", "### ", "</turn>", "</tur", "\\", "): ", "### Assistant: ", "\n", "é", "x", "(", "<", "/turn>"]


@pytest.mark.parametrize("seed", range(200))
def test_round_trip(seed):
    t, rnd = ChatTemplate(), random.Random(seed)
    said = [(rnd.choice(["user", "assistant", "", "odd): ###", "\\"]), "".join(rnd.choices(BITS, k=rnd.randrange(9)))) for _ in range(4)]
    whole = "".join(s for turn in said for s, _ in t.segments(*turn))
    at, got = 0, []
    while at < len(whole):
        role, text, at = t.read_turn(whole, at)
        got.append((role, text))
    assert got == said


def expected(turns):
    turns = [(r or "", x or "") for r, x in turns]
    loss = "".join(x for r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_against_plain_python(spark, tmp_path):
    rnd = random.Random(1)
    convs = {c: [(rnd.choice(["user", "assistant", "tool", None, "système"]), rnd.choice([None, "", "a ### b", "long " * 30_000, "é</turn>"])) for _ in range(rnd.randrange(1, 7))] for c in range(40)}
    convs[None] = [("user", "q"), ("assistant", "a")]
    rows = [(c, k, r, x, "clash") for c, turns in convs.items() for k, (r, x) in enumerate(turns)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op2_chat(spark, str(tmp_path)).collect()}
    convs[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == expected(turns)
    assert got[-7].formatted_chars > 60


def test_turn_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (4, 0, "user", "u"), (4, 1, "user", "u"), (4, 2, "assistant", "a"), (5, None, "user", "u"), (5, 1, "assistant", "z"), (5, 1, "assistant", "z")]
    got = {r.conv_id: (r.valid, r.n_errors) for r in read_back(format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 0), 4: (False, 1), 5: (False, 1)}


def test_only_assistant_texts_carry_loss(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "a")]
    got = format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [[(s.text, s.loss) for s in r.segments] for r in got] == [[("### User: ", False), ("u", False), ("</turn>\n", False)], [("### Assistant: ", False), ("a", True), ("</turn>\n", False)]]


def test_a_formatted_table_that_was_written_is_read_back_whole(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(30) for t in range(8)]
    formatted = format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(map(tuple, read_back(formatted, in_order=True).collect()))
    formatted.repartition(7).write.parquet(f"{tmp_path}/formatted")
    again = spark.read.parquet(f"{tmp_path}/formatted")
    assert sorted(map(tuple, read_back(again).collect())) == want and len(want) == 30
    with pytest.raises(PythonException, match="is due"):
        read_back(again.orderBy("seq"), in_order=True).collect()


def test_empty_table(spark):
    assert read_back(format_turns(spark.createDataFrame([], SCHEMA))).collect() == []


def test_template_is_checked():
    with pytest.raises(ValueError):
        ChatTemplate(control=("###", "</turn>", "x</turn"))
    with pytest.raises(ValueError):
        ChatTemplate(headers={"user": "USER: "})
