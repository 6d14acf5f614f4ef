import random

import pytest

from palisade.functions import constants as K, text as X


def one(rows, value, expr):
    return rows("text string", [(value,)]).select(expr).first()[0]


def test_sections(rows):
    text = "Intro\nPurpose:  keep it \nmore\n\nKey Functions:\n- a --\n\n- b\nPurpose: later"
    assert one(rows, text, X.section("text", "Purpose")) == "keep it \nmore"
    assert one(rows, text, X.section("text", "Missing")) == ""
    assert one(rows, text, X.section_list("text", "Key Functions")) == ["a"]
    assert one(rows, "Dependencies: x, y\n- z", X.section_list("text", "Dependencies")) == ["x, y", "z"]
    assert one(rows, "none", X.section_list("text", "Dependencies")) == []


def test_json_extraction(rows):
    assert one(rows, 'say {"a": {"b": 1}} ok', X.json_object("text")) == '{"a": {"b": 1}}'
    assert one(rows, 'say {"a": } ok', X.json_object("text")) is None
    assert one(rows, "nothing", X.json_object("text")) is None
    assert one(rows, 'x [{"a": 1}] y', X.json_array("text")) == '[{"a": 1}]'


def test_severity_keeps_the_case_of_valid_values(rows):
    got = rows("s string", [("High",), ("low",), ("Critical",), ("",)]).select(X.normalise_severity("s")).collect()
    assert [r[0] for r in got] == ["High", "low", "Medium", "Medium"]


def test_middle_truncation(rows):
    assert one(rows, "a" * 2000, X.truncate_middle("text")) == "a" * 2000
    cut = one(rows, "a" * 1001 + "b" * 1000, X.truncate_middle("text"))
    assert cut == "a" * 1000 + K.MIDDLE_MARK + "b" * 1000


def test_budgeted_truncation(rows):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = rows("text string, tokens int", [(text, 500), (text, 100)])
    cut, kept = [r[0] for r in df.select(X.truncate_to_budget("text", "tokens", 250)).collect()]
    n = int(1000 * (250 / 500) * 0.7)
    assert cut == text[: int(n * 0.6)] + K.MIDDLE_MARK + text[-int(n * 0.4):]
    assert kept == text


def budget_model(prompt: str, context: int, out: int) -> list[str]:
    """Independent model of the parts of a prompt, one piece of a section after the other."""
    room = context - out - 50
    parts, used = [], 0
    for section in prompt.split("\n\n"):
        for piece in [section[k : k + 4 * room] for k in range(0, max(len(section), 1), 4 * room)]:
            size = len(piece) // 4 + 20
            if parts and used + size <= room:
                parts[-1].append(piece)
                used += size
            else:
                parts.append([piece])
                used = size
    return ["\n\n".join(p) for p in parts]


def test_token_budget_against_model(rows):
    rng = random.Random(5)
    prompts = [
        "x" * rng.randint(0, 900) + "".join("\n\n" * rng.randint(1, 2) + "é" * rng.randint(0, 400) for _ in range(rng.randint(0, 8)))
        for _ in range(300)
    ] + ["", "\n\n", "a" * 600, "i" * 700 + "\n\nrest", "i" * 40 + "\n\n" + "b" * 320 + "\n\n" + "c" * 4]
    got = rows("text string", [(p,) for p in prompts]).select("text", X.budget_parts("text", 250, 50).alias("out")).collect()
    for r in got:
        assert r.out == budget_model(r.text, 250, 50)
        assert "".join(r.out).replace("\n\n", "") == r.text.replace("\n\n", "")


def test_token_budget_stays_inside_the_row(rows, plan):
    text = plan(rows("text string", [("a",)]).select(X.budget_parts("text", 250, 50)))
    assert "Exchange" not in text and "Window" not in text and "EvalPython" not in text


@pytest.mark.parametrize("text,tokens", [("", 0), ("abc", 0), ("abcd", 1), ("é" * 9, 2)])
def test_token_count(rows, text, tokens):
    assert one(rows, text, X.token_count("text")) == tokens



def test_nothing_follows_a_json_value(spark):
    texts = ['{"a": 1} {"b": 2}', 'x {"a": [1, {}]} y', '{"a": 1}, {"b": 2}', '{"a": 1},"w":{"b": 2}', '{"a": 1}}, {{"b": 2}', '{"a": 1', "{}", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.json_object("t")).collect()] == [None, '{"a": [1, {}]}', None, None, None, None, "{}", None]
    lists = spark.createDataFrame([(t.replace("{", "[").replace("}", "]").replace('"a": ', "").replace('"b": ', ""),) for t in texts], "t string")
    assert [r[0] for r in lists.select(X.json_array("t")).collect()] == [None, "[1, []]".join("[]"), None, None, None, None, "[]", None]
